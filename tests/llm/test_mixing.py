"""Weights, budgets and permutations against plain code."""

import math

import pytest
from pyspark.sql import functions as F

from lumenrank.llm import mixing as mx

SIZES = {"a": 400, "b": 90, "c": 40, None: 10}


@pytest.fixture
def rows(docs_of):
    out, i = [], 0
    for s, n in SIZES.items():
        for _ in range(n):
            out.append((i, " ".join(["w"] * (1 + i % 7)), s))
            i += 1
    return docs_of(out)


def tokens_by_source(df, n="n_tokens"):
    return {r["source"]: r["t"] for r in df.groupBy("source").agg(F.sum(n).alias("t")).collect()}


def weights(natural, a):
    total = sum(natural.values())
    z = sum((t / total) ** a for t in natural.values())
    return {s: (t / total) ** a / z for s, t in natural.items()}


def check(rows, mixture, chosen):
    longest = rows.select(F.max(mx.word_count("text"))).first()[0]
    natural = tokens_by_source(rows.withColumn("n", mx.word_count("text")), "n")
    w, used = weights(natural, chosen.exponent), tokens_by_source(mixture)
    for s, t in natural.items():
        due = round(w[s] * chosen.budget)
        assert due <= used.get(s, 0) < due + longest or used.get(s, 0) == due
    assert chosen.entropy == pytest.approx(-sum(x * math.log(x) for x in w.values()))
    # every pass but the last holds all documents of a source once; the last holds none twice
    per = {}
    for r in mixture.collect():
        per.setdefault((r.source, r.mix_epoch), []).append(r.doc_id)
    count = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    for (s, e), ids in per.items():
        assert len(ids) == len(set(ids))
        if (s, e + 1) in per:
            assert len(ids) == count[s]
    return natural, used


def test_repetition_limit(rows):
    mixture, chosen = mx.mix(rows, max_epochs=3.0)
    natural, used = check(rows, mixture, chosen)
    assert 0 < chosen.exponent < 1
    assert max(used[s] / natural[s] for s in natural) == pytest.approx(3.0, rel=0.2)
    assert used["a"] == natural["a"]  # the largest is passed over once, nothing is lost
    assert {r.doc_id for r in mixture.collect()} == {r.doc_id for r in rows.collect()}


def test_entropy_target(rows):
    natural = tokens_by_source(rows.withColumn("n", mx.word_count("text")), "n")
    goal = 0.5 * (math.log(4) + -sum(x * math.log(x) for x in weights(natural, 1).values()))
    mixture, chosen = mx.mix(rows, max_epochs=None, target_entropy=goal)
    check(rows, mixture, chosen)
    assert chosen.entropy == pytest.approx(goal, abs=1e-4)


@pytest.mark.parametrize("budget", [37, 500, 4000])
def test_budgets(rows, budget):
    mixture, chosen = mx.mix(rows, max_epochs=2.0, budget=float(budget))
    check(rows, mixture, chosen)


def test_order_is_by_blocks_and_changes_by_pass(rows):
    mixture = mx.mix(rows, max_epochs=3.0)[0].where("source = 'b'").orderBy("mix_epoch", "mix_place").collect()
    passes = [[r.doc_id for r in mixture if r.mix_epoch == e] for e in (0, 1)]
    assert sorted(passes[0]) == sorted(passes[1]) or len(passes[1]) < len(passes[0])
    assert passes[0] != passes[1] and passes[0] != sorted(passes[0])
    assert all(r.mix_block == r.mix_place >> 43 for r in mixture)


def test_without_broadcast_the_same(rows, monkeypatch):
    a = sorted(map(tuple, mx.mix(rows, columns=["doc_id"])[0].collect()))
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mx.mix(rows, columns=["doc_id"])[0].collect())) == a


def test_edge_cases(spark, docs_of):
    assert mx.mix(docs_of([]))[0].count() == 0
    assert mx.mix(docs_of([(1, None), (2, "  ")]))[0].count() == 2
    same = mx.mix(docs_of([(1, "a b"), (1, "a b"), (2, None), (None, "c d e")]))[0]
    assert sorted((r.doc_id, r.mix_epoch) for r in same.where("doc_id is not null").collect()) == [(1, 0), (1, 0), (2, 0)] and same.count() == 4
    clash = docs_of(["a b c"]).withColumn("mix_epoch", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    r = mx.mix(clash)[0].first()
    assert r.mix_epoch == 0 and r.n_tokens == 3 and r.src == "x"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mx.op8_mixing(spark, sf)
    want, chosen = mx.mix(docs)
    check(docs, want, chosen)
    assert sorted((r.doc_id, r.mix_epoch, r.mix_place) for r in got.collect()) == sorted((r.doc_id, r.mix_epoch, r.mix_place) for r in want.collect())


def test_null_ids_keep_the_budget(spark, docs_of):
    """Rows without an id have places of their own, so a part of a pass takes a part of them."""
    for null in (False, True):
        rows = [(None if null else i, f"a b c{i}", "one") for i in range(50)]
        mixture, _ = mx.mix(docs_of(rows), budget=75.0)
        n = mixture.agg({"n_tokens": "sum"}).first()[0]
        assert 75 <= n <= 78
