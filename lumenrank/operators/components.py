"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.sources.shared import remove, shared_path


def _star_min(edges: DataFrame) -> DataFrame:
    """The least neighbour of each u. The key is rebuilt so that the join deals both sides anew and can split a hot u."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + F.lit(0)).alias("k"), "m")


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) of longs; component is the least node of each component.

    Alternates the large-star and small-star steps; each round reads the table of the round before, so neither a
    component nor the graph is ever gathered in one task. Loops and repeated edges are harmless, nulls are dropped,
    an empty graph gives no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    path = shared_path(spark, tag)
    e.write.parquet(path)
    e = spark.read.schema(e.schema).parquet(path)
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
        worst = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("downs")).agg(F.max("ups"), F.max(F.when(F.col("ups") > 0, F.col("downs")))).first()
        if (worst[0] or 0) <= 1 and not worst[1]:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star_min(both), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = large.join(_star_min(large), F.col("u") == F.col("k"))
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        new = shared_path(spark, tag)
        nxt.write.parquet(new)
        e, old, path = spark.read.schema(e.schema).parquet(new), path, new
        remove(spark, old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
