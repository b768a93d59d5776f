"""Text by layout."""

import random
import re
from html.parser import HTMLParser

import pytest

from lumenrank.llm import layout

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div>b<div>c</div>": "a\nb\nc",
    "a<b>b</b> <i> c</i>d": "ab cd",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>after": "- x\n- y\n  3. q\n  4. r\n\nafter",
    "<table><tr><th>n<th>value<tr><td>long cell<td>1</table>": "n         | value\nlong cell | 1",
    "<table><tr><td colspan=2>a<td>b<tr><td>1<td>2<td>3</table>": "a |   | b\n1 | 2 | 3",
    "<td>loose": "loose",
    "<p>see<script>if (a<b) '</p>'</script><style>p{}</style>n": "seen",
    "<title>t</title><body hidden>x": "",
    "<p hidden>a</p><p style='display: none'>b</p><p style=\"Visibility:hidden\">c</p><p aria-hidden=true>d</p><p style='color:red'>e": "d\n\ne",
    "<input type=hidden value=x><input type=submit value=Go><img alt=pic>": "Gopic",
    "<pre>a  b\n  c</pre>d": "a  b\n  c\n\nd",
    "&lt;b&gt; &amp; &eacute;&nbsp;x": "<b> & é\xa0x",
    "a<!-- no -->b<!-- open": "ab",
    "1 < 2 and <3": "1 < 2 and <3",
    "</p>x</div></ul>": "x",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<p a='>'>q</p>": "q",
    "<p>a<table><tr><td>b</table>c": "a\n\nb\n\nc",
    "<html><head><title>t</title></head><body><h1>h</h1>x</body></html>\n": "h\n\nx",
    "<textarea>a<b></textarea>": "a<b>",
    "<svg><title>no</title><text>hi</text></svg> <math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>": "hi x=",
    "<select><optgroup label=g><option>A<option>B</select>": "g\nA\nB",
    "<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>": "b",
    "<div hidden style='display:block'>a</div><div hidden><b style='display:block;visibility:visible'>b</b></div>": "a",
    "<dialog>no</dialog><dialog open>yes</dialog><ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>": "yes\nkr",
    "<map><p>in a map<area alt=no></map><object>instead</object>": "in a map\n\ninstead",
    "<table><tr><td rowspan=2>A<td>B<tr><td>C</table>": "A | B\n  | C",
    "<table><tr><td rowspan=0>A<td>B<tr><td>C<tbody><tr><td>D<td>E</table>": "A | B\n  | C\nD | E",
    "<table><tr><td colspan=1000>A<tr><td>B</table>": "A\nB",
    f"<table><tr><td>{'word ' * 20}<td>b<tr><td>c<td>d</table>": "\n".join(["word " * 15 + "word | b", "word word word word".ljust(79) + " |", "c".ljust(79) + " | d"]),
    "<ol reversed><li>a<li value=7>b<li>c</ol><ol type=a start=27><li>z</ol><ol type=I><li>x<li>y</ol>": "3. a\n7. b\n6. c\n\naa. z\n\nI. x\nII. y",
    "<ul><li><p>a</p><p>b</p><li></li><li><pre>x\n y</pre></ul>": "- a\n\n  b\n\n- x\n   y",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert layout.to_text(page) == CASES[page]


def test_all_visible_text_survives():
    """Whatever the nesting, every visible word comes out once and in order, and no hidden one."""
    rng = random.Random(4)
    for _ in range(400):
        page, shown, depth = [], [], []
        for i in range(rng.randrange(40)):
            x = rng.random()
            if x < 0.3:
                tag = rng.choice("p div ul ol li b i span h1 section blockquote".split())
                page.append(f"<{tag}>")
                depth.append(tag)
            elif x < 0.45 and depth:
                page.append(f"</{depth.pop()}>")
            elif x < 0.5:
                page.append(f"<script>hide{i}</script>")
            elif x < 0.55:
                page.append(f"<div hidden>hide{i}</div>")
            else:
                page.append(f" w{i} ")
                shown.append(f"w{i}")
        assert re.findall(r"w\d+|hide\d+", layout.to_text("".join(page))) == shown


def test_deep_and_long():
    assert layout.to_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert layout.to_text("<table><tr><td>" * 3000 + "x").strip() == "x"
    assert layout.to_text("<div>" * 205 + "<div hidden>secret</div>x<template>secret") == "x"
    assert layout.to_text("<div>" * 200_000 + "<b hidden>secret</b>x") == "x"
    assert layout.to_text("<ul><li>" * 2000 + "x").split()[-1] == "x"
    assert layout.to_text("<p><li>" + "<b>" * 50_000 + "<hr>" * 50_000 + "x") == "- x"
    assert layout.to_text("<b" * 20000).startswith("<b")
    assert len(layout.to_text("<p>ab " * 100_000).split()) == 100_000


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (2, None, "x"), (2, "", "x"), (None, "é", "x")], "page_id long, html string, text string")
    assert sorted((tuple(r) for r in layout.extract_text(df).collect()), key=repr) == sorted([(1, "a", 1), (2, "", 0), (2, "", 0), (None, "é", 1)], key=repr)
    assert layout.extract_text(df.where("page_id > 9")).count() == 0


class Words(HTMLParser):
    """The words of a page outside of what never shows, by another parser that keeps no tree."""

    def __init__(self):
        super().__init__()
        self.out, self.shut = [], 0

    def handle_starttag(self, tag, attrs):
        self.shut += tag in ("head", "script", "style", "title")
        if tag not in ("a", "b"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.shut -= tag in ("head", "script", "style", "title")
        if tag not in ("a", "b"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.shut:
            self.out.append(data)


def test_query(spark):
    """Every page of the table: all words that show, in order, one line end or more between blocks."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in layout.op5_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        w = Words()
        w.feed(r.html)
        text = got[r.page_id].text
        assert [x for x in text.split() if x != "-"] == [x for x in "".join(w.out).split() if x != "-"]
        assert got[r.page_id].n_chars == len(text) and not re.search(r"\n{3}|[ \n]\Z| \n", text)
        assert text.count("\n- ") + text.startswith("- ") == r.html.count("<li>")
