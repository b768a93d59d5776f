"""SimHash against plain code."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lumenrank.llm import simhash as sh
from lumenrank.llm.common import connected_components


def plain_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for j, a in enumerate(ids):
        for b in ids[:j]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


TEXTS = [None, "", "  \t\n", "one", "one two", "One TWO", "a b c", "É é ẞ a", "a b c d", "x " * 40000, "w\x0bx\x0cy\x1cz", "a b c", None]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert sh.fingerprint(None if text is None else text.encode()) == plain_fp(text)


def test_components_of_texts(spark, docs_of):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(120)) for _ in range(6)]
    near = []
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "new"
            near.append(" ".join(w))
    texts = TEXTS + base + near + base[:2]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in sh.simhash_components(docs_of(texts)).collect()}
    fps = {i: plain_fp(t) for i, t in enumerate(texts)}
    comp = plain_components(fps)
    assert got == {i: (fps[i], comp[i]) for i in fps}


@pytest.mark.parametrize("seed", range(3))
def test_links_lose_no_pair(spark, seed):
    """Fingerprints around few centres, all distances from 0 on, one dense ball: components as of all pairs."""
    rng = random.Random(seed)
    fps = set()
    for _ in range(5):
        c = rng.getrandbits(64)
        for d in (0, 1, 2, 3, 4, 5, 6, 7) * 6:
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), d)))
        fps |= {c ^ (7 << s) for s in (0, 13, 14, 15, 30, 46, 61)}  # three bits in one block and across two
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    links = sh.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    want = plain_components(dict(enumerate(fps)))
    comp = {r.node: r.component for r in connected_components(links).collect()}
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(comp.get(v, v), []).append(i)
    wanted = {}
    for i, c in want.items():
        wanted.setdefault(c, []).append(i)
    assert sorted(groups.values()) == sorted(wanted.values())


def test_connected_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (60, 1000), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 0 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark, docs_of):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "other words stand here now"), (None, None), (7, "")]
    kept = sh.keep_one(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9]
    assert kept.columns == docs_of(rows).columns
    assert sh.keep_one(docs_of([])).count() == 0
    assert sh.keep_one(docs_of([(None, "x y z"), (1, "q r s t")])).count() == 2


def test_query_whole_table(spark):
    rows = sh.op3_simhash(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {i: plain_fp(t) for i, t in docs.items()}
    comp = plain_components(fps)
    assert {tuple(r) for r in rows} == {(i, f"{fps[i]:016x}", comp[i]) for i in docs}


def test_empty(spark, docs_of):
    assert sh.simhash_components(docs_of([])).count() == 0
    assert sh.simhash_components(docs_of(["", None])).select(F.countDistinct("component_id")).first()[0] == 1
