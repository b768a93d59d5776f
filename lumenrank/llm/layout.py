"""HTML to text by layout: a tree with implied tags, visibility rules, block spacing, lists and aligned table cells."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the HTML rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe canvas audio video datalist meta link base param source track area noembed noframes rp defs desc metadata symbol annotation annotation-xml".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("html body div article section nav header footer main aside address form li dt dd tr caption thead tbody tfoot td th figcaption details summary legend center dialog hgroup menu search option optgroup".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEAD_ONLY = frozenset("title base link meta style script template noscript".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th".split())
#: Most columns and rows that a cell may span.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

_SECTIONS = frozenset("thead tbody tfoot".split())
#: Opening the first closes all open ones of the second that lie inside the nearest of the third.
IMPLIED = {
    "tr": (frozenset("tr td th caption".split()), _SECTIONS | {"table"}),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    **{x: (_SECTIONS | frozenset("tr td th caption".split()), frozenset({"table"})) for x in _SECTIONS},
    "option": (frozenset({"option"}), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split())),
}
#: Opening the first closes the nearest block but for these, if it is of the second.
ITEMS = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
_WEAK = frozenset("p div address".split())

# Possessive and without "<" inside a tag: an open tag that never closes costs no second look.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^<>]*+>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_NUMBER = re.compile(r"-?[0-9]{1,9}")
#: A cell wider than this is wrapped, so that one long cell doesn't pad the whole column.
CELL_WIDTH = 80
#: Lists nested so deep that their indent passes this are all indented by it.
MAX_INDENT = 200


class Node:
    __slots__ = ("tag", "attrs", "children", "vis", "pre", "text")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.vis, self.pre, self.text = True, False, ""

    def attr(self, name: str) -> str | None:
        """The value of an attribute: "" if it has none, None if it is not there."""
        for m in _ATTR.finditer(self.attrs) if self.attrs else ():
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def number(self, name: str) -> int | None:
        s = (self.attr(name) or "").strip()
        return int(s) if _NUMBER.fullmatch(s) else None


class _Open:
    """The open elements, and where those of each kind stand: no look-up goes through them one by one."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.strong: list[int] = []
        self.push(root)

    def push(self, node: Node) -> None:
        i = len(self.nodes)
        self.nodes.append(node)
        self.at[node.tag].append(i)
        if node.tag in BLOCKS and node.tag not in _WEAK:
            self.strong.append(i)

    def cut(self, i: int) -> None:
        """Close the element at i and all inside it; the root stays."""
        while len(self.nodes) > max(i, 1):
            self.at[self.nodes.pop().tag].pop()
        while self.strong and self.strong[-1] >= len(self.nodes):
            self.strong.pop()

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_inside(self, tags, outer: int) -> int | None:
        found = [self.at[t][k] for t in tags if self.at.get(t) and (k := bisect_right(self.at[t], outer)) < len(self.at[t])]
        return min(found, default=None)


def parse(page: str) -> Node:
    """The tree of a page. Implied html, head and body, implied end tags; stray end tags are dropped, open elements end with the page."""
    root = Node("html")
    open_, at, n = _Open(root), 0, len(page)
    nodes = open_.nodes

    def body() -> None:
        if len(nodes) == 1 or nodes[1].tag == "head":
            open_.cut(1)
            for c in root.children:
                if isinstance(c, Node) and c.tag == "body":
                    open_.push(c)
                    return
            b = Node("body")
            root.children.append(b)
            open_.push(b)

    def text(s: str) -> None:
        if s and (s.strip() or len(nodes) > 1):
            if nodes[-1].tag in ("html", "head") and s.strip():
                body()
            nodes[-1].children.append(html.unescape(s) if "&" in s else s)

    def opened(node: Node) -> None:
        nodes[-1].children.append(node)
        open_.push(node)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in ("html", "body") and open_.at.get(tag):
                i = open_.at[tag][-1]
                # an end tag inside a cell does not close what is outside
                if i and (tag in TABLE_PARTS or i > open_.nearest(("td", "th", "table"))):
                    open_.cut(i)
            continue
        if tag == "html":
            root.attrs = root.attrs or m[3]
            continue
        if tag == "head":
            if len(nodes) == 1 and not root.children:
                opened(Node("head", m[3]))
            continue
        if tag == "body":
            body()
            nodes[1].attrs = nodes[1].attrs or m[3]
            continue
        if len(nodes) == 1 or nodes[1].tag == "head":
            if tag in HEAD_ONLY:
                if len(nodes) == 1 and not root.children:
                    opened(Node("head"))
            else:
                body()
        if tag in CLOSES_P and open_.at.get("p"):
            i = open_.at["p"][-1]
            if i > max(open_.strong[-1] if open_.strong else 0, open_.nearest(_WEAK - {"p"})):
                open_.cut(i)
        if tag in ITEMS and open_.strong and nodes[open_.strong[-1]].tag in ITEMS[tag]:
            open_.cut(open_.strong[-1])
        if tag in IMPLIED:
            closes, scope = IMPLIED[tag]
            i = open_.first_inside(closes, open_.nearest(scope))
            if i is not None:
                open_.cut(i)
            # a cell without a row: the row is implied
            if tag in ("td", "th") and (nodes[-1].tag == "table" or nodes[-1].tag in _SECTIONS):
                opened(Node("tr"))
        node = Node(tag, m[3])
        if tag in RAW:
            nodes[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(page, at)
            s = page[at : end.start() if end else n]
            if s:
                node.children.append(html.unescape(s) if tag in ("textarea", "title") else s)
            at = end.end() if end else n
        elif tag in VOID:
            nodes[-1].children.append(node)
        else:
            opened(node)
    return root


def shown(node: Node, inherited: bool) -> tuple[bool, bool]:
    """(whether an element takes place at all, whether its own text shows): by kind, attribute and inline style.

    What is not displayed hides all inside it; visibility is inherited and may be set back inside. aria-hidden says
    nothing about sight.
    """
    if node.tag in HIDDEN:
        return False, False
    if not node.attrs:
        return node.tag != "dialog", inherited
    low = node.attrs.lower()
    said = {k.lower(): v.lower() for k, v in _DECLARED.findall(node.attr("style") or "")} if "style" in low else {}
    vis = {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility", ""), inherited)
    if "display" in said:
        return said["display"] != "none", vis
    if "hidden" in low and node.attr("hidden") is not None:
        return False, vis
    if node.tag == "input" and (node.attr("type") or "").lower() == "hidden":
        return False, vis
    return node.tag != "dialog" or node.attr("open") is not None, vis


class _Out:
    """Lines with collapsed white space; gap: how many line ends are due before the next text. Text in items is indented; their marks come before its first line."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap, self.space, self.any = 0, False, False
        self.items, self.unwritten, self.indent = [], [], 0

    def block(self, ends: int) -> None:
        self.gap = max(self.gap, ends)
        self.space = False

    def begin(self, mark: str) -> None:
        self.items.append(mark)
        self.unwritten.append(mark)
        self.indent += len(mark)

    def end(self) -> None:
        self.indent -= len(self.items.pop())
        del self.unwritten[-1:]  # an item without text has no mark

    def inline(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space = True
        core = words.strip(" ")
        if core:
            self._due()
            if self.space:
                self.parts.append(" ")
            self.parts.append(core)
            self.space = words[-1] == " "

    def exact(self, s: str) -> None:
        if s:
            self._due()
            self.parts.append(s.replace("\n", "\n" + " " * min(self.indent, MAX_INDENT)) if self.indent else s)
            self.space = False

    def _due(self) -> None:
        if self.gap or self.unwritten:
            if self.any:
                self.parts.append("\n" * max(self.gap, 1))
            self.parts.append(" " * min(self.indent - sum(map(len, self.unwritten)), MAX_INDENT))
            self.parts += self.unwritten
            self.unwritten.clear()
            self.gap, self.space = 0, False
        self.any = True

    def line(self) -> None:
        """A forced line end."""
        if self.any:
            self.gap = min(self.gap + 1, 2)
        self.space = False

    def text(self) -> str:
        return "".join(self.parts)


def _settle(root: Node) -> list[Node]:
    """Take out of the tree what does not show, hand down what is inherited; returns the tables, outer before inner."""
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if node.vis:
                    kept.append(c)
                continue
            there, c.vis = shown(c, node.vis)
            if there:
                c.pre = node.pre or c.tag == "pre"
                kept.append(c)
                todo.append(c)
                if c.tag == "table":
                    tables.append(c)
        node.children = kept
    return tables


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


_ROMAN = list(zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True))


def _roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        k, n = divmod(n, value)
        out += sign * k
    return out


def _mark(kind: str, n: int) -> str:
    """The mark of an item by the type of its list; what letters or Roman numbers cannot say is said in digits."""
    s = _letters(n) if kind in ("a", "A") and n > 0 else _roman(n) if kind in ("i", "I") and 0 < n < 4000 else str(n)
    return f"{s.upper() if kind in ('A', 'I') else s}. "


class _Numbers:
    """The numbers of the items of an ordered list."""

    def __init__(self, node: Node):
        down = node.attr("reversed") is not None
        start = node.number("start")
        items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if down and start is None else 1
        self.kind, self.step = node.attr("type") or "1", -1 if down else 1
        self.next = items if start is None else start

    def mark(self, item: Node) -> str:
        value = item.number("value")
        n = self.next if value is None else value
        self.next = n + self.step
        return _mark(self.kind, n)


def _flow(node: Node, out: _Out) -> None:
    """All that shows inside node; tables inside have their text already. No recursion: nesting may be of any depth."""
    frames = [(iter(node.children), node, _Numbers(node) if node.tag == "ol" else None, "", 0)]
    while frames:
        children, parent, numbers, end, ends = frames[-1]
        c = next(children, None)
        if c is None:
            frames.pop()
            if end:
                out.end()
            if ends:
                out.block(ends)
            continue
        if isinstance(c, str):
            (out.exact if parent.pre else out.inline)(c)
            continue
        tag = c.tag
        if tag == "br":
            out.line()
        elif tag == "hr":
            out.block(2)
        elif tag in ("img", "input"):
            kind = "alt" if tag == "img" else "value" if (c.attr("type") or "text").lower() in ("button", "submit", "reset") else ""
            if kind and c.vis:
                out.inline(c.attr(kind) or "")
        elif tag == "table":
            out.block(2)
            out.exact(c.text)
            out.block(2)
        else:
            if tag == "li":
                ends, end = 1, "item"
                out.block(1)
                out.begin((numbers.mark(c) if numbers else "- ") if c.vis else "")
            else:
                # a list inside an item follows it at once; other paragraphs are set off by an empty line
                ends = 0 if tag not in BLOCKS else 1 if tag not in PARAGRAPHS or (parent.tag == "li" and tag in ("ul", "ol", "dl")) else 2
                end = "item" if tag == "dd" else ""
                if ends:
                    out.block(ends)
                if end:
                    out.begin("  ")
                if tag == "optgroup" and c.vis:
                    out.inline(c.attr("label") or "")
                    out.block(1)
            frames.append((iter(c.children), c, _Numbers(c) if tag == "ol" else None, end, ends))


def _inside(node: Node) -> str:
    out = _Out()
    _flow(node, out)
    return out.text()


def _wrapped(s: str) -> list[str]:
    """s in lines of CELL_WIDTH, or longer where a single word is."""
    if len(s) <= CELL_WIDTH:
        return [s]
    lines, held, n = [], [], -1
    for w in s.split(" "):
        if held and n + 1 + len(w) > CELL_WIDTH:
            lines.append(" ".join(held))
            held, n = [], -1
        held.append(w)
        n += 1 + len(w)
    return [*lines, " ".join(held)]


class _Grid:
    """Cells by row and column; columns that a cell above or beside reaches into are skipped."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, float] = {}

    def section(self) -> None:
        """No cell reaches from one section of a table into the next."""
        self.taken = {}

    def row(self, cells: list[tuple[str, int, int]]) -> None:
        """cells: (text, columns, rows; no rows: to the end of the section)."""
        r, col, row = len(self.rows), 0, {}
        for text, wide, high in cells:
            while self.taken.get(col, 0) > r:
                col += 1
            row[col] = _wrapped(text)
            if wide > 1 or high != 1:
                for k in range(col, col + wide):
                    self.taken[k] = r + high if high else float("inf")
            col += wide
        self.rows.append(row)

    def lines(self) -> Iterator[str]:
        """Rows with text, cells padded to the width of their column and parted by a bar; columns in which no cell starts are not there."""
        widths: dict[int, int] = defaultdict(int)
        for row in self.rows:
            for col, lines in row.items():
                widths[col] = max(widths[col], min(CELL_WIDTH, max(map(len, lines))))
        columns = sorted(widths)
        for row in self.rows:
            if any(x[0] for x in row.values()):
                here = columns[: bisect_right(columns, max(row))]
                for i in range(max(map(len, row.values()))):
                    yield " | ".join((row[c][i] if c in row and i < len(row[c]) else "").ljust(widths[c]) for c in here).rstrip()


def _table(table: Node) -> str:
    """Captions, and the rows as a grid."""
    grid, captions = _Grid(), []

    def cell(x: Node | str) -> tuple[str, int, int] | None:
        s = _SPACE.sub(" ", x if isinstance(x, str) else _inside(x)).strip()
        if isinstance(x, str):
            return (s, 1, 1) if s else None
        wide, high = x.number("colspan"), x.number("rowspan")
        return s, min(max(wide or 1, 1), MAX_COLSPAN), 1 if high is None or high < 0 else min(high, MAX_ROWSPAN)

    def part(nodes: list) -> None:
        for c in nodes:
            if isinstance(c, Node) and c.tag == "tr":
                grid.row([x for x in map(cell, c.children) if x])
            elif isinstance(c, Node) and c.tag in _SECTIONS:
                grid.section()
                part([x for x in c.children if not (isinstance(x, Node) and x.tag in _SECTIONS)])
                grid.section()
            else:
                s = _SPACE.sub(" ", c).strip() if isinstance(c, str) else c.text if c.tag == "table" else _inside(c)
                if s:
                    captions.append(s)

    part(table.children)
    return "\n".join([*captions, *grid.lines()])


def to_text(page: str | None) -> str:
    """All visible text of a page; no page gives no text."""
    if not page:
        return ""
    root = parse(page)
    there, root.vis = shown(root, True)
    if not there:
        return ""
    for table in reversed(_settle(root)):
        table.text = _table(table)
    return "\n".join(line.rstrip() for line in _inside(root).split("\n")).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars) for every row of pages: no shuffle, one page in memory at a time.

    Null and empty pages give an empty text; text without tags comes back with its white space collapsed. Repeated rows each come back;
    other columns are not read; an empty table gives no rows. Nesting may be of any depth; only the indent of items ends at MAX_INDENT.
    Shown are options of selects and what details fold away, as a reader can open them; not shown is what kind, attribute
    or inline style hide (style sheets and scripts are not run).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [to_text(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
