"""Greedy string tiling against plain code, and planted leaks."""

import random

import numpy as np
import pytest

from lumenrank.llm import decontaminate as dc


def plain_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    marked_a, marked_b, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        marked_a |= set(range(i, i + n))
        marked_b |= set(range(j, j + n))
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice((3, 6, 30)))]
    item = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
    doc = [rng.choice(words) for _ in range(rng.randrange(60))]
    for _ in range(3):  # pieces of the item, reordered
        i = rng.randrange(len(item))
        at = rng.randrange(len(doc) + 1)
        doc[at:at] = item[i : i + rng.randrange(4, 20)]
    index = dc.Index([(7, " ".join(item))], 5)
    ids = index.ids(doc)
    _, place, where = index.starts(ids, *index.seeded(ids), np.ones(1, bool)) if len(index.seeded(ids)[0]) else (None, *np.zeros((2, 0), int))
    assert dc.tile(index.items[0], ids, place, where) == plain_tiles(item, doc, 5)


def test_one_token_again_and_again():
    """No square of seeds: a long text of one token, an item of the same."""
    index = dc.indexes([(1, "a " * 40 + "b"), (2, "a " * 2000)], 5)
    got = {m[0]: m for m in dc.match(index, "a " * 2_000_000, 0.8)}
    assert got[1][1:] == (40 / 41, 1, 40, 41) and got[2][1:] == (1.0, 1, 2000, 2000)


@pytest.mark.parametrize("seed", range(5))
def test_coverage_by_plain_tiles(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    for _ in range(20):
        doc = " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
        want = {}
        for i, t in items:
            n = len(t.split())
            tiles = plain_tiles(t.split(), doc.split(), min(5, n))
            if tiles and sum(x[2] for x in tiles) >= 0.8 * n:
                want[i] = (sum(x[2] for x in tiles) / n, len(tiles), max(x[2] for x in tiles), n)
        assert {m[0]: m[1:] for m in dc.match(dc.indexes(items, 5), doc, 0.8)} == want


ITEM = "Alpha beta gamma delta epsilon zeta, eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def found(spark, docs, items, **kw):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, bench, **kw).collect()}


def test_leaks_and_clean(spark, docs_of):
    w = ITEM.replace(",", "").split()
    rows = [(1, "before " + ITEM.upper() + " after"), (2, " ".join(w[10:] + ["between"] + w[:10])), (3, " ".join(w[:12])), (4, "quite clean"), (5, None), (6, ""), (7, " ".join(reversed(w))), (8, "fill " * 30000 + ITEM), (1, ITEM), (None, ITEM), (9, " ".join(x + " z" for x in w))]
    rows += [(20, "Too SHORT!"), (21, "not too short")]
    items = [(10, ITEM), (11, "too short"), (12, None), (13, ITEM), (14, "")]
    got = found(spark, docs_of(rows), items)
    assert set(got) == {(d, i) for d in (1, 2, 8, None) for i in (10, 13)} | {(20, 11), (21, 11)}
    assert got[2, 10].n_tiles == 2 and got[2, 10].coverage == 1.0 and got[1, 10].n_tiles == 1
    kept = dc.decontaminate(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9, 21]
    bench = spark.createDataFrame(items, "item_id long, text string")
    joined = dc.contaminated(docs_of(rows), bench, broadcast_chars=0)
    assert sorted(joined.collect(), key=repr) == sorted(dc.contaminated(docs_of(rows), bench).collect(), key=repr)
    other = dc.decontaminate(docs_of(rows), bench, broadcast_chars=0)
    assert sorted(other.collect(), key=repr) == sorted(kept.collect(), key=repr) and other.columns == kept.columns == docs_of(rows).columns


def test_a_join_of_seeds_changes_nothing(spark, docs_of):
    rng = random.Random(2)
    items = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    docs = docs_of([(i, f"x {items[i % 12][1]} y {items[(i * 5) % 12][1]}") for i in range(20)])
    one, many = found(spark, docs, items), found(spark, docs, items, broadcast_chars=100)
    assert one == many and len(one) >= 20


def test_empty_tables(spark, docs_of):
    assert found(spark, docs_of([]), [(1, ITEM)]) == {}
    assert found(spark, docs_of([ITEM]), []) == {}
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs_of([ITEM]), none).count() == 1
    assert found(spark, docs_of([]), [(1, ITEM)], broadcast_chars=0) == {}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, dc.tokens(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, dc.tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for i, item in items:
        grams = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
        for d, doc in docs:
            near = sum(tuple(doc[k : k + 5]) in grams for k in range(len(doc) - 4))
            if near >= 0.8 * len(item) / 5 and sum(n for _, _, n in plain_tiles(item, doc, 5)) >= 0.8 * len(item):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in dc.op1_decontaminate(spark, sf).collect()} == want and want
