"""Score caches as tables: look up, what is left to do, and adding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.scoring import COST_PER_ITEM


def technical_key(path: Column) -> Column:
    """The name of the entry beside an item."""
    return F.concat(path, F.lit(".techscore.json"))


def vision_key(path: Column) -> Column:
    return F.concat(path, F.lit(".vision.json"))


def _deduped(cache: DataFrame, keys: list[str]) -> DataFrame:
    """One entry a key: the greatest, so repeated entries never multiply items."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("entry"))


def technical_lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (path, mtime, ...) with scores and hit: an entry counts only if its time is the item's own, to the bit, and it holds scores."""
    known = _deduped(cache.where("scores is not null"), ["path", "mtime"]).select("path", "mtime", F.col("entry.scores").alias("scores"))
    return items.join(known, ["path", "mtime"], "left").withColumn("hit", F.col("scores").isNotNull())


def vision_lookup(items: DataFrame, cache: DataFrame, strict: bool) -> DataFrame:
    """items (source_sha256, prompt_sha256, model, ...) with vision and hit: by content and prompt, and by model too if strict."""
    keys = ["source_sha256", "prompt_sha256", *(["model"] if strict else [])]
    known = _deduped(cache.where("vision is not null").select(*keys, "vision"), keys).select(*keys, F.col("entry.vision").alias("vision"))
    return items.join(known, keys, "left").withColumn("hit", F.col("vision").isNotNull())


def to_do(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The items that the cache lacks."""
    return items.join(cache.select(*keys).distinct(), keys, "left_anti")


def cost(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """(items, uncached, cost) of scoring what the cache lacks."""
    seen = items.join(cache.select(*keys).distinct().withColumn("seen", F.lit(1)), keys, "left")
    return seen.agg(F.count("*").alias("items"), F.count_if(F.col("seen").isNull()).alias("uncached")).withColumn("cost", F.col("uncached") * F.lit(COST_PER_ITEM))


def added(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with fresh entries in place of old ones of the same key."""
    return cache.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*cache.columns))


def cached_then_fresh(hits: DataFrame, fresh: DataFrame, ord_: str = "ord") -> DataFrame:
    """Both, by name, in the order of ord_: unlike a plain concatenation, ties do not depend on what was cached."""
    return hits.unionByName(fresh).orderBy(ord_)


def vision_entries(scored: DataFrame, items: DataFrame, model: str, prompt_sha256: Column) -> DataFrame:
    """Cache entries (key, source_sha256, model, prompt_sha256, vision) of what was scored: path and vision, of items (path, source_sha256). Failed items have none."""
    rows = scored.where("vision is not null").select("path", "vision").join(items.select("path", "source_sha256"), "path")
    return rows.select(vision_key(F.col("path")).alias("key"), "source_sha256", F.lit(model).alias("model"), prompt_sha256.alias("prompt_sha256"), "vision")


def fresh(sources: DataFrame, work: DataFrame) -> DataFrame:
    """sources (path, mtime, ...) with reusable: whether work (path, mtime) has a copy that is not older."""
    known = work.groupBy("path").agg(F.max("mtime").alias("__made"))
    return sources.join(known, "path", "left").withColumn("reusable", F.coalesce(F.col("__made") >= F.col("mtime"), F.lit(False))).drop("__made")
