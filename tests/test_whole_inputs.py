"""Queries over whole texts and all rows, against plain code."""

import numpy as np
from pyspark.sql import functions as F

from lumenrank.operators import dedup
from lumenrank.plans import grouping, reporting, subjects

SF = "/root/testdata/sf0.001"


def test_gallery_rows_keep_whole_captions(spark, tmp_path):
    long = "x" * 39 + " a|b\nc " + "y" * 60 + "|"
    spark.createDataFrame([(1, "en", "src"), (2, "en", "src"), (3, "en", "src")], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, long), (1, 1, "later"), (2, 0, "short")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: r.caption for r in reporting.gallery_rows(spark, str(tmp_path)).collect()}
    assert got == {1: long.replace("|", "\\|").replace("\n", " "), 2: "short", 3: ""}


def test_correlation_of_all_rows(spark, tmp_path, monkeypatch):
    """Sparse ids, several parts, a constant vector, one of another length and a null."""
    monkeypatch.setattr(dedup, "PART", 60)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select((F.col("vec_id") * 1000).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("vec_id").limit(300)
    vectors = {r.vec_id: r.embedding for r in e.collect()}
    odd = spark.createDataFrame([(-3, [0.5] * 64), (-2, [1.0, 2.0]), (-1, None)], "vec_id long, embedding array<double>")
    e.unionAll(odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = np.array(sorted(vectors))
    r = np.corrcoef([vectors[i] for i in ids]).round(6)
    want = {(ids[i], ids[j], r[i, j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if r[i, j] >= grouping.MIN_R}
    got = [tuple(x) for x in grouping.vector_correlation_pairs(spark, str(tmp_path)).select("a", "b", "r").collect()]
    assert len(got) == len(want) > 1000
    assert set(got) == want


def test_correlation_shuffles_each_row_once(spark, tmp_path, monkeypatch):
    """However many parts: rows that meet in tiles are read from files, not dealt to every tile."""
    monkeypatch.setattr(dedup, "PART", 25)
    rows = spark.range(500).select((F.col("id") * 3).alias("id"), F.expr("transform(sequence(1, 16), i -> sin(id * i))").alias("v"))
    pairs = dedup.correlated_pairs(rows, "id", "v", 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan
    assert pairs.select("a", "b").distinct().count() == pairs.count() > 500


def test_lookup_of_a_long_burst_is_shared_out(spark, tmp_path, monkeypatch):
    """A burst's rows come from several tasks, each with all names; events alone and without a time are there too."""
    monkeypatch.setattr(grouping, "LOOKUP_BYTES", 20_000, raising=False)
    events = spark.range(403).select(F.col("id").alias("event_id"), F.when(F.col("id") < 402, F.expr("timestamp_micros(id * 1000000 + if(id > 400, 100000000, 0))")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = grouping.burst_lookup(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    names = ",".join(map(str, range(401)))
    assert {r.event_id: (r.representative, r.burst_size, r.members) for r in got} == {i: (6, 401, names) for i in range(401)} | {401: (None, None, None), 402: (None, None, None)}
    assert len(got) == 403 and len({r.task for r in got if r.burst_size}) > 1


def test_gap_ratio_rounds_as_the_sql(spark, tmp_path):
    """161 / 640 is 0.2515625 in its shortest decimals, and a little more in fact."""
    rows = [(24011, 4200, 646, 7, 25.0, 76037.41, 0.03)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.min_gap_ratio for r in subjects.crop_uncertainty(spark, str(tmp_path)).collect()] == [0.251563]
