"""Personal data against plain regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest

from lumenrank.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


CASES = ["", "a@b", "a@b.c", "x a.b@c.d.e-f@g.h", "@@a@b.co@d.eu", "a@b.c@d.e", "é@b.de ä.x@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.2.3.04", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y", "41111111111111111111 1", "+1 (366) 555-9807 ok", "+1 2", "+12345678", "+1234567", "+123456789012345678", "++49 30 1234567.", "+49(0)30-123 45 67-", "a" * 5000 + "@" + "b" * 5000, "." * 300 + "@x.y", "1" * 5000 + ".1.1", "12@1.2.3.4 +1.2.3.4567"]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_random():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("ab1234567890.@+-() ñ") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain(text), text


def test_find(spark, docs_of):
    rows = [(1, "mail bob.42@mail8.example.com and +1 (366) 555-9807, 10.0.0.7"), (2, None), (3, ""), (4, "card 4111 1111 1111 1111"), (4, "card 4111 1111 1111 1111"), (None, "ñ 1.2.3.4"), (5, "clean text with 3 numbers 12 and 2024")]
    got = sorted((tuple(r) for r in pii.find_pii(docs_of(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        base = plain(t or "")
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(k == x for k, _, _ in base) for x in pii.BASE), hashlib.sha256(s.encode()).hexdigest(), s))
    assert [r[:6] for r in got] == [r[:6] for r in sorted(want, key=repr)]
    assert all(set(w[6].split(",")) <= set(g[6].split(",")) for g, w in zip(got, sorted(want, key=repr), strict=True))
    assert pii.find_pii(docs_of([])).count() == 0


def test_method_adds_spans(spark, docs_of):
    rows = [f"contact mail u{i}@host.example.com or u{i} [at] host [dot] com, phone (366) 555-98{i:02d}" for i in range(20)]
    got = pii.find_pii(docs_of(rows)).collect()
    assert all(r.n_email == 1 and r.spans.count("email:") == 2 and r.spans.count("phone:") == 1 for r in got)


def test_reliabilities_find_the_bad_labeler():
    """Two labelers agree, one contradicts them: its accuracy comes out lowest."""
    patterns = [("phone 1 1 -1 1 0", 80), ("phone -1 -1 1 -1 0", 60), ("phone 1 1 1 1 0", 10)]
    chance, accuracy = pii.reliabilities(patterns)
    k = pii.KINDS.index("phone")
    assert chance[0] > 0.9 and chance[1] < 0.1 and accuracy[k, 2] < min(accuracy[k, [0, 1, 3]])


def test_redact(spark, docs_of):
    rows = [(1, "to a@b.co now"), (2, None), (3, "n/a")]
    out = pii.redact(docs_of(rows))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "to [EMAIL] now", 2: None, 3: "n/a"}
    assert out.columns == docs_of(rows).columns
    assert pii.redacted("x1234y", [("card", 1, 4), ("phone", 2, 5)]) == "x[CARD]y"
    assert pii.redact(docs_of([])).count() == 0


def test_no_candidates():
    assert not np.any(pii.all_spans("nothing", np.zeros(len(pii._features(["email 1 1 1 1 0"])[0])))[1])


def test_candidates_do_not_hang_on_words_elsewhere():
    """What is a candidate depends on the span alone, not on what stands elsewhere in the text."""
    for text, n in (("ann at example.com", 0), ("ann at example.com here dot there", 0), ("ann at example dot com", 1), ("ann [at] example.com", 1), ("ann (at) example (dot) co", 1)):
        assert len([c for c in pii.candidates(text, []) if c[0] == "email"]) == n, text


def test_secrets(spark, docs_of):
    """Keys that are set or issued are found, long words and numbers are not."""
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [f'here token = "{key(40)}" and on, Donaudampfschiffahrt{i} lies on page 20240101' for i in range(30)] + ["nothing set here at all", "AKIA" + "0123456789ABCDEF"]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs_of(rows)).collect()}
    assert all(got[i] == "secret:14:54" for i in range(30)) and got[30] == ""
    assert pii._iban_ok("DE89370400440532013000") and pii.votes("IBAN DE89 3704 0044 0532 0130 00", ("iban", 5, 32))[:4] == (1, 1, 1, 1)


def test_very_long_texts():
    for text in ("a1" * 2_000_000, "1" * 3_000_000, "x@" * 500_000, "+1 " * 500_000, "1.2." * 500_000, "token = " * 300_000, "DE89 " * 300_000):
        base = pii.base_spans(text)
        pii.candidates(text, base)


def test_query_whole_table(spark):
    """Base columns of every document against the plain patterns; all base spans are among all spans."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op9_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if x in set(written)] == written
        order = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert order == sorted(order)
    assert sum(r.spans.count("secret:") for r in got) > 0
