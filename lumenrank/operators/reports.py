"""Rows and sums of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenrank.functions import text
from lumenrank.functions.scoring import WEIGHTS

BINS = 10


def summary(df: DataFrame, score: Column) -> DataFrame:
    """(n, lowest, highest, mean, median, spread) of a score; spread is the population's."""
    s = score
    return df.agg(F.count(s).alias("n"), F.min(s).alias("lowest"), F.max(s).alias("highest"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"), F.stddev_pop(s).alias("spread"))


def metric_means(df: DataFrame) -> DataFrame:
    """The mean of each metric, a missing one counting 0."""
    return df.agg(*(F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in WEIGHTS))


def histogram(df: DataFrame, score: Column, width: int = 30) -> DataFrame:
    """(bin, low, n, bar) over ten equal bins of [0, 1]; the last holds 1 too; empty bins come with 0."""
    spark = df.sparkSession
    counted = df.where(score.between(0, 1)).groupBy(F.least(F.floor(score * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(BINS).select(F.col("id").cast("int").alias("bin"))
    both = bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    most = counted.agg(F.max("n").alias("most"))
    return both.join(F.broadcast(most)).select("bin", (F.col("bin") / BINS).alias("low"), "n", F.coalesce(text.bar(F.col("n") / F.col("most"), width), F.lit("")).alias("bar"))


def report_rows(top: DataFrame, ext: str = ".jpg") -> DataFrame:
    """One row for each of the top items (rank, path, final_score, composite, total, line, uncertain, reasons, members, selected_by, cropped)."""
    name = text.file_name(F.col("path"))
    burst = F.when(F.size("members") > 1, F.struct(F.size("members").cast("long").alias("count"), F.col("selected_by"), F.transform("members", text.file_name).alias("members")))
    out = lambda kind: text.ranked_name(F.col("rank"), kind, text.stem(F.col("path")), ext)
    return top.select(
        "rank",
        name.alias("filename"),
        F.bround("final_score", 4).alias("final_score"),
        F.bround("composite", 4).alias("technical_composite"),
        "total",
        text.markdown_cell(F.col("line")).alias("one_line"),
        F.when(F.col("cropped"), out("cropped")).alias("output_cropped"),
        F.when(F.col("cropped"), out("hd")).alias("output_hd"),
        text.ranked_name(F.col("rank"), "full", text.stem(F.col("path")), F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("output_full"),
        "uncertain",
        "reasons",
        burst.alias("burst"),
    )


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """(line_no, line) of a Markdown table over report rows."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-3, f"## {title}"), (-2, "| Rank | File | Score | Technical | Model | Caption | Output |"), (-1, "| --- | --- | --- | --- | --- | --- | --- |")], "line_no long, line string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("rank").cast("string"), text.markdown_cell(F.col("filename")), F.format_string("%.4f", "final_score"), F.format_string("%.4f", "technical_composite"), F.coalesce(F.col("total").cast("string"), F.lit("")), text.markdown_cell(F.col("one_line")), F.coalesce("output_cropped", F.lit(""))), F.lit(" |"))
    return head.unionAll(rows.select(F.col("rank").cast("long"), cells))


def gallery_stats(rows: DataFrame) -> DataFrame:
    """(n, first_score, mean_final, mean_technical, mean_total, n_uncertain): one row; the first score is that of the least rank."""
    return rows.agg(F.count("*").alias("n"), F.min(F.struct("rank", "final_score")).alias("f"), F.avg("final_score").alias("mean_final"), F.avg("technical_composite").alias("mean_technical"), F.avg("total").alias("mean_total"), F.count_if("uncertain").alias("n_uncertain")).select("n", F.col("f.final_score").alias("first_score"), "mean_final", "mean_technical", "mean_total", "n_uncertain")


def folder_rollup(items: DataFrame, folder: Column, images: Column, ord_: Column) -> DataFrame:
    """(parent, child, galleries, images, thumbnail): for each folder what each child folder holds, all levels down.

    items are galleries: folder is its path, images its count (null counts 0), and ord settles which comes first.
    """
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    rows = items.select(parts.alias("parts"), F.coalesce(images, F.lit(0)).alias("images"), ord_.alias("o")).where("size(parts) > 0")
    steps = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("i"))
    steps = steps.select(F.expr("array_join(slice(parts, 1, i), '/')").alias("parent"), F.expr("parts[i]").alias("child"), "images", "o", F.array_join("parts", "/").alias("path"))
    return steps.groupBy("parent", "child").agg(F.count("*").alias("galleries"), F.sum("images").alias("images"), F.min(F.struct("o", "path")).alias("t")).select("parent", "child", "galleries", "images", F.col("t.path").alias("thumbnail"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """Per model (model, duration, images, failed columns of runs): means, images a minute, and how much slower than the fastest."""
    means = runs.groupBy("model").agg(F.count("*").alias("runs"), F.avg("duration").alias("mean_seconds"), F.avg(F.try_divide(F.col("duration"), F.col("images"))).alias("seconds_an_image"), F.avg(F.try_divide(60 * F.col("images"), F.col("duration"))).alias("images_a_minute"), F.sum("failed").alias("failed"), F.percentile("duration", 0.5).alias("median_seconds"))
    return means.withColumn("times_fastest", F.try_divide(F.col("seconds_an_image"), F.min("seconds_an_image").over(W.partitionBy())))


def breaker(events: DataFrame, group: str, ord_: list[Column], failed: Column, limit: int) -> DataFrame:
    """events with failures_in_row (0 after a success) and open: whether limit failures in a row came before or with it."""
    of_group = W.partitionBy(group).orderBy(*ord_)
    out = events.withColumn("__island", F.sum(F.when(failed, 0).otherwise(1)).over(of_group))
    out = out.withColumn("failures_in_row", F.sum(F.when(failed, 1).otherwise(0)).over(W.partitionBy(group, "__island").orderBy(*ord_)).cast("long"))
    return out.withColumn("open", F.max("failures_in_row").over(of_group) >= limit).drop("__island")


def all_markdown(scored: DataFrame) -> DataFrame:
    """(line_no, line) of the table of all scored items, best first: final, technical and model scores, the seven metrics, and the caption. scored has rank."""
    head = scored.sparkSession.createDataFrame([(-3, "## All analysed"), (-2, "| Rank | File | Final | Technical | Model | " + " | ".join(WEIGHTS) + " |"), (-1, "| --- " * (5 + len(WEIGHTS)) + "|")], "line_no long, line string")
    number = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit(""))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("rank").cast("string"), text.markdown_cell(text.file_name(F.col("path"))), F.format_string("%.4f", "final_score"), F.format_string("%.4f", "composite"), F.coalesce(F.concat(F.col("vision.total").cast("string"), F.lit("/60")), F.lit("")), *(number(m) for m in WEIGHTS)), F.lit(" |"))
    return head.unionAll(scored.select(F.col("rank").cast("long"), cells))


def title(scorer: str | None) -> str:
    """The heading of a report by who scored."""
    return "Selected (technical scores only)" if scorer is None else f"Selected (scored by {scorer})"


def failed_in_bench(line: Column) -> Column:
    """Whether the caption of a benchmark's item says that scoring failed."""
    return text.holds(line, text.BENCH_FAILED)


def bench_modes(items: DataFrame) -> DataFrame:
    """Per mode (column mode) over runs (mode, run, duration, final_score, line of each item): means over runs of duration, seconds an image, images a minute, failures, mean and median score; fastest first."""
    runs = items.groupBy("mode", "run").agg(F.max("duration").alias("duration"), F.count("*").alias("images"), F.count_if(failed_in_bench(F.col("line"))).alias("failed"), F.avg("final_score").alias("mean_score"), F.percentile("final_score", 0.5).alias("median_score"))
    out = runs.groupBy("mode").agg(F.count("*").alias("runs"), F.avg("duration").alias("mean_seconds"), F.avg(F.try_divide("duration", "images")).alias("seconds_an_image"), F.avg(F.try_divide(60 * F.col("images"), F.col("duration"))).alias("images_a_minute"), F.avg("failed").alias("mean_failed"), F.avg("mean_score").alias("mean_score"), F.avg("median_score").alias("median_score"))
    return out.orderBy(F.col("seconds_an_image").asc_nulls_last(), "mode")


def bench_markdown(summary: DataFrame, name: str) -> DataFrame:
    """(line_no, line) of a benchmark's table; summary has name, runs, seconds_an_image, images_a_minute and mean_seconds, and few rows."""
    head = summary.sparkSession.createDataFrame([(-2, "| Name | Runs | Seconds an image | Images a minute | Seconds |"), (-1, "| --- | --- | --- | --- | --- |")], "line_no long, line string")
    place = F.row_number().over(W.orderBy(F.col("seconds_an_image").asc_nulls_last(), name)).cast("long")
    number = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit(""))
    return head.unionAll(summary.select(place, F.concat(F.lit("| "), F.concat_ws(" | ", text.markdown_cell(F.col(name)), F.col("runs").cast("string"), number("seconds_an_image"), number("images_a_minute"), number("mean_seconds")), F.lit(" |"))))


def versions(*names: Column) -> Column:
    """The output files that there are, in this order."""
    return F.filter(F.array(*names), lambda x: x.isNotNull() & (x != ""))
