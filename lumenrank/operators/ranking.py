"""Stable ranking, cuts and top-n. ord is the place in the input and settles every tie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenrank.functions import scoring
from lumenrank.sources.shared import materialise


def best_first(score: Column, ord_: Column) -> list[Column]:
    """Sort keys: highest score first, a missing one counts 0, ties in input order."""
    return [F.coalesce(score, F.lit(0.0)).desc(), ord_.asc()]


def numbered(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the order of keys, from 1, without one task that holds all rows.

    Ranges of the order are dealt to tasks and counted; a prefix sum over the counts (one row a task) gives offsets.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = materialise(dealt, "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def numbered_few(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """numbered() for the rows that a limit has left: they fit one task."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*keys)).cast("long"))


def share_cut(df: DataFrame, keys: list[Column], top_n: int, share: float, name: str = "rank") -> DataFrame:
    """The best rows: so many of them as the share says, cut to a whole number, but top_n at least."""
    k = max(top_n, int(df.count() * share))
    return numbered(df, keys, name).where(F.col(name) <= k)


def first_of_group(df: DataFrame, group: list[str], keys: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row in its group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*keys)))


def best_of_group(df: DataFrame, group: str, score: Column, ord_: Column, members: Column) -> DataFrame:
    """(group, best, members, size): the first member of greatest score, and all members in input order.

    The best is a maximum over (score, -ord), so it is combined before rows move.
    """
    out = df.groupBy(group).agg(F.max(F.struct(F.coalesce(score, F.lit(0.0)).alias("s"), (-ord_).alias("o"), members.alias("id"))).alias("b"), F.array_sort(F.collect_list(F.struct(ord_.alias("o"), members.alias("id")))).alias("m"))
    return out.select(group, F.col("b.id").alias("best"), F.col("m.id").alias("members"), F.size("m").cast("long").alias("size"))


def swapped(df: DataFrame, group: str, item: str, is_rep: Column, score: Column, ord_: Column) -> DataFrame:
    """(group, rep, chosen, selected_by): another member replaces the representative only if its score is greater; of equal others the first."""
    key = F.struct(F.coalesce(score, F.lit(0.0)).alias("s"), is_rep.cast("int").alias("r"), (-ord_).alias("o"), F.col(item).alias("id"))
    out = df.groupBy(group).agg(F.max(F.when(is_rep, F.col(item))).alias("rep"), F.max(key).alias("b"), F.count("*").alias("n"))
    by = F.when(F.col("b.id") != F.col("rep"), "technical").when(F.col("n") > 1, "sharpness").otherwise("")
    return out.select(group, "rep", F.col("b.id").alias("chosen"), by.alias("selected_by"))


def crop_gated_top(df: DataFrame, n: int, crop: Column, final: Column, ord_: Column) -> DataFrame:
    """The n best of the items that crop well, filled up with the best others if there are fewer. One sort, kept to n rows a task."""
    return df.withColumn("crop_safe", scoring.crop_safe(crop)).orderBy(F.col("crop_safe").desc(), *best_first(final, ord_)).limit(n)
