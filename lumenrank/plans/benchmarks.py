"""Timed runs of a scorer over the same pictures: one scan, a warm-up, then the runs, and their tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators import ranking, reports
from lumenrank.plans import folder
from lumenrank.sources.shared import materialise

RUN = "name string, run int, duration double, path string, final_score double, line string"


def timed(spark: SparkSession, path: str, work: str, scorers: dict[str, folder.Options], runs: int = 1, pause: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(name, run, duration, path, final_score, line): every item of every run of each named scorer, over one scan of the folder.

    Each scorer first scores one picture, then waits pause seconds. A failed item says so in its line.
    """
    pics = materialise(folder.prepared(spark, path, work), "pictures")
    unique, _ = folder.deduplicated(pics)
    ranked = folder._measured(pics.join(unique.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_semi"), None)
    cut = materialise(ranked.join(pics.select(F.col("path").alias("p"), "ord"), F.col("path") == F.col("p")).drop("p"), "bench")
    out = None
    for name, o in scorers.items():
        folder.judged(cut.orderBy("ord").limit(1), pics, o).count()
        sleep(pause)
        for run in range(1, runs + 1):
            began = time.perf_counter()
            scored = materialise(folder.judged(cut, pics, replace(o)), "bench-run")
            took = time.perf_counter() - began
            line = F.when(F.col("vision").isNull(), F.concat(F.lit("vision scoring failed: "), F.coalesce("error", F.lit("no scorer")))).otherwise(F.col("vision.one_line"))
            rows = scored.select(F.lit(name).alias("name"), F.lit(run).alias("run"), F.lit(took).alias("duration"), "path", "final_score", line.alias("line"))
            out = rows if out is None else out.unionAll(rows)
    return out if out is not None else spark.createDataFrame([], RUN)


def summary(items: DataFrame) -> DataFrame:
    """timed() by name, fastest first: means over runs, and the mean and median score."""
    return reports.bench_modes(items.withColumnRenamed("name", "mode"))


def markdown(items: DataFrame) -> DataFrame:
    """(line_no, line): the table of speeds, then the best item of each first run."""
    speeds = reports.bench_markdown(summary(items), "mode")
    best = ranking.first_of_group(items.where("run = 1"), ["name"], [F.col("final_score").desc(), F.col("path")]).where("place = 1")
    tops = best.select((F.lit(1000) + F.row_number().over(ranking.W.orderBy("name"))).cast("long").alias("line_no"), F.concat(F.lit("- best of "), "name", F.lit(": "), "path", F.lit(" "), F.format_string("%.4f", "final_score")).alias("line"))
    return speeds.unionAll(tops)
