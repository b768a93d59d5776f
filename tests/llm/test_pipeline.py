"""The pipeline, stage by stage, against plain code on the same input."""

import math
import re

import corpus_pipeline as cp
from lumenrank.llm import decontaminate as dc
from lumenrank.llm import toxicity as tx
from test_decontaminate import plain_tiles
from test_jaccard import plain_components

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        read[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{k}"))
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = map(texts, read["toxicity"])
    score = {r.doc_id: r.predicted for r in tx.op2_toxicity(spark, SF).collect()}
    assert after == {i: t for i, t in before.items() if not score[i]}
    before, after = map(texts, read["simhash_near_dedup"])
    comp = plain_components(before)
    assert after == {i: t for i, t in before.items() if comp[i] == i}
    before, after = map(texts, read["benchmark_decontamination"])
    items = [dc.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leak(text):
        w = dc.tokens(text)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near = [i for i in items if sum(tuple(i[k : k + 5]) in own for k in range(len(i) - 4)) >= 0.8 * len(i) / 5 - 1]
        return any(sum(n for _, _, n in plain_tiles(i, w, 5)) >= 0.8 * len(i) for i in near)

    assert set(after) == {i for i, t in before.items() if not leak(t)}
    before, after = map(texts, read["pii"])
    assert set(before) == set(after)
    assert not any(re.search(r"[A-Za-z0-9]@[a-z]+[0-9]*\.example", t) for t in after.values())
    assert all(before[i] == t for i, t in after.items() if not re.search(r"\[(EMAIL|IP|CARD|PHONE|IBAN|SSN|NAME|SECRET)\]", t))
    before, mixed = read["mixing"]
    assert {r.doc_id for r in mixed.collect()} == set(texts(before))


def test_run_is_the_stages(spark):
    a = cp.run(spark, SF)
    assert {"doc_id", "text", "source", "mix_epoch", "mix_place"} <= set(a.columns)
    assert a.count() > 0 and math.isclose(sum({r.source: r.mix_weight for r in a.select("source", "mix_weight").collect()}.values()), 1, abs_tol=1e-9)


def test_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and ids, a long text, a further column: each stage keeps all columns, and what it should."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(40).selectExpr("*", "'x' AS text_sha", "1 AS fp")
    ids = [r.doc_id for r in some.collect()]
    odd = [(None, "text without an id here now", None, None, None), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "same words in two rows of one id", "en", "s", 1), (9003, "same words in two rows of one id", "en", "s", 1), (9003, "other words under the same id here", "en", "s", 1), (9004, "long " * 100_000 + "mail ann@example.com", "en", "s", 1), (None, None, None, None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS text_sha", "1 AS fp")
    some.unionAll(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert set(df.columns) <= set(out.columns)
        out.write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = sorted(((r.doc_id, r.text) for r in df.collect() if r.doc_id is None or r.doc_id not in ids), key=repr)
    kept = [x for x in seen["simhash_near_dedup"] if x[0] in (9003, None) and x[1]]
    assert sorted(kept, key=repr) == sorted([(9003, "same words in two rows of one id"), (9003, "other words under the same id here"), (None, "text without an id here now")], key=repr)
    assert sum(not x[1] for x in seen["simhash_near_dedup"]) == 1  # null and empty texts are one group
    assert [x[1].endswith("mail [EMAIL]") for x in seen["pii"] if x[0] == 9004] == [True]
    assert {x for x in seen["mixing"]} == set(seen["pii"])


def test_run_leaves_little_behind(spark):
    """Of what the stages write only what the last one reads stays."""
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    old = set(os.listdir(root))
    cp.run(spark, SF)
    new = {x.split("-")[1] + "-" + x.split("-")[2] for x in set(os.listdir(root)) - old}
    assert new and all(x.startswith(("mix-", "pipeline-pii")) for x in new), new
