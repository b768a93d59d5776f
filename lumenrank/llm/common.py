"""Helpers shared by the training-data operators: shared-folder tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.components import connected_components
from lumenrank.sources.shared import materialise, remove, scratch, shared_path

__all__ = ["connected_components", "materialise", "remove", "scratch", "shared_path", "split_by_sketch"]

#: Longs of a sketch for each key in it, and in all at most: what is broadcast never exceeds 16 bytes a long.
SKETCH_SHARE, SKETCH_MOST = 0.25, 1 << 20


def split_by_sketch(df: DataFrame, hashed: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be in keys, all others). keys has one column h, of long hashes such as hashed; nulls are in neither.

    The sketch is a bitmap of pmod(hash, its bits), sized by the number of keys, 16 bits each, up to SKETCH_MOST longs.
    It only says which rows cannot match, so a join of the first part with keys loses nothing; beyond that size it rules
    out fewer rows and is still right.
    """
    longs = int(max(1, min(SKETCH_MOST, keys.count() * SKETCH_SHARE)))
    place = lambda h: F.pmod(h, F.lit(64 * longs))
    slot, bit = F.expr("p div 64"), F.expr("shiftleft(1L, cast(p % 64 as int))")
    bits = keys.select(place(F.col("h")).alias("p")).groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))
    marked = df.withColumn("p", place(hashed)).join(F.broadcast(bits), slot == F.col("slot"), "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.where(x).drop("p", "slot", "bits") for x in (hit, ~hit))
