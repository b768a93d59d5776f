"""Repeated passages against plain code."""

import hashlib
import random
import re

import pytest

from lumenrank.llm import substring as sb


def plain(rows, n=50):
    first = {}
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[j : j + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                keep[j : j + n] = [False] * n
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(docs, **kw):
    return sorted((tuple(r)[:4] for r in sb.remove_repeats(docs, **kw).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_mixtures(spark, docs_of, seed, monkeypatch):
    """Documents glued from shared passages of all lengths around the threshold, in all orders, with edits and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(2))
    passages = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 60, 75, 99, 100, 130)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        text = " ".join(parts)
        if rng.random() < 0.3:
            w = text.split()
            w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        rows.append((rng.randrange(10**6), text))
    rows = list(dict(rows).items())
    rows += [(2 * 10**6 + i, rows[i % 3][1]) for i in range(6)]
    assert got(docs_of(rows)) == plain(rows)
    if not seed:
        monkeypatch.setattr(sb, "PAIRWISE", 1)  # each surrounding extended to every window's length
        assert got(docs_of(rows)) == plain(rows)


def test_matches_are_extended_both_ways(spark, docs_of):
    """From the anchor as far as words go, to the right and to the left, and from one anchor's words to the next's."""
    w = sb.np.arange(200, dtype=sb.np.uint64)
    other = w.copy()
    other[[20, 90]] = 999
    assert list(sb.extended([w, other[10:]], [60, 50], [1, 2], 50)) == [(1, 11, 69)]
    assert list(sb.extended([w, other[10:]], [60, 50], [2, 2], 50)) == []
    rng = random.Random(3)
    some = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    p, q = some(400), some(70)
    rows = [(1, some(30) + p + some(5)), (2, q + some(9)), (5, some(12) + p[3:390] + some(2) + q + some(60)), (6, some(60) + p[:49])]
    docs = docs_of([(i, " ".join(t)) for i, t in rows])
    assert sorted(tuple(r) for r in sb.maximal_repeats(docs).collect()) == [(5, 12, 387), (5, 12 + 387 + 2, 70)]
    runs = sb.anchored_runs(sb.Hasher().words([x.encode() for x in rows[2][1]]))
    assert max(runs[3]) + 49 < 387  # no run is as long as the match


def test_edge_cases(spark, docs_of):
    p = " ".join(f"w{i}" for i in range(50))
    same = " ".join(["go"] * 300)
    rows = [(4, p), (4, p), (2, None), (1, ""), (9, p + " tail"), (7, "head " + p), (None, p), (11, p.replace(" ", "\t\x0b ")), (12, p.upper()), (20, same), (21, same + " go"), (22, " ".join(["go"] * 49)), (30, p + " x")]
    assert got(docs_of(rows)) == plain(rows)


def test_small_windows(spark, docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(40)]
    assert got(docs_of(rows), min_words=12, anchor=4) == plain(rows, 12)


def test_kept_text_and_empty_table(spark, docs_of):
    p = " ".join(f"w{i}" for i in range(60))
    rows = {r.doc_id: r.kept for r in sb.remove_repeats(docs_of([(1, p), (2, "new " + p + " end")])).collect()}
    assert rows == {1: None, 2: "new end"}
    assert sb.remove_repeats(docs_of([])).count() == 0


def test_very_long(spark, docs_of):
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(50_000))
    assert got(docs_of([(1, long), (2, "x " + long)])) == plain([(1, long), (2, "x " + long)])


def test_query_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in sb.op6_substring(spark, sf).collect()), key=repr) == plain(rows)
