"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenrank.llm.common import materialise

#: No document is repeated more often than this, on average over its source.
MAX_EPOCHS = 4.0
#: Halvings of the exponent's interval that one job evaluates, and jobs.
LEVELS, JOBS = 5, 5
#: A source's documents are dealt into 2**BITS blocks, and those into as many again.
BITS = 10
SEED = 17
#: The plan has one row a source. Up to so many rows it is broadcast; beyond, documents are dealt by source and hot sources split by Spark.
BROADCAST_SOURCES = 100_000


@dataclass
class Temperature:
    """The exponent, the entropy of the weights in nats, and the tokens that the mixture may have."""

    exponent: float
    entropy: float
    budget: float


def word_count(text: str) -> Column:
    """Tokens as counted here: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _at(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of share**a, sum of share**a * ln share) for each exponent a: one small job, whatever the number of sources."""
    sums = [x for i, a in enumerate(exponents) for x in (F.sum(F.pow("share", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"l{i}"))]
    row = shares.agg(*sums).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]


def choose(shares: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None) -> Temperature:
    """Bisect the exponent in [0, 1] over shares (share > 0, tokens of each source).

    With target_entropy: the largest exponent whose weights have that entropy or more (0 if none has). With
    max_epochs: the least exponent at which no source needs more passes than that; it wins over the entropy. budget
    None: the tokens at which the source of largest share is passed over once, so that every document is used.
    """
    ends = shares.agg(F.sum("tokens"), F.min("share"), F.max("share")).first()
    total, low, high = float(ends[0]), ends[1], ends[2]

    def entropy(a: float, z: float, log_sum: float) -> float:
        return math.log(z) - a * log_sum / z

    def budget_at(a: float, z: float) -> float:
        return budget if budget is not None else total * high * z / high**a

    def passes(a: float, z: float) -> float:
        return budget_at(a, z) * low ** (a - 1) / (z * total)

    def bisect(good_above: bool, good) -> float:
        """The end of the good exponents: the least if they lie above, else the largest."""
        lo, hi = 0.0, 1.0
        at_lo, at_hi = _at(shares, [lo, hi])
        if good_above and good(lo, *at_lo):
            return lo
        if not good_above and good(hi, *at_hi):
            return hi
        for _ in range(JOBS):
            n = 1 << LEVELS
            points = [lo + (hi - lo) * i / n for i in range(1, n)]
            known = dict(zip(range(1, n), _at(shares, points), strict=True))
            i, j = 0, n
            while j - i > 1:
                mid = (i + j) // 2
                if good(points[mid - 1], *known[mid]) == good_above:
                    j = mid
                else:
                    i = mid
            lo, hi = lo + (hi - lo) * i / n, lo + (hi - lo) * j / n
        return hi if good_above else lo

    a = 1.0
    if target_entropy is not None:
        a = bisect(False, lambda x, z, s: entropy(x, z, s) >= target_entropy)
    if max_epochs is not None:
        # the budget decides how often even the natural shares repeat: then nothing below 1 helps
        least = bisect(True, lambda x, z, s: passes(x, z) <= max_epochs)
        a = max(a, least) if target_entropy is not None else least
    [(z, s)] = _at(shares, [a])
    return Temperature(a, entropy(a, z, s), budget_at(a, z))


def _place(epoch: Column) -> Column:
    """Where a document stands in a pass over its source: a keyed permutation that moves blocks as wholes, blocks within them, and documents."""
    key = F.xxhash64("src", epoch, F.lit(SEED))
    return F.col("h").bitwiseXOR(key).bitwiseAND(F.lit((1 << 63) - 1))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (all columns of docs), src, n_tokens and h, the place of a document before any permutation; without an id its text gives the place."""
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), src.alias("src"), word_count(text_col).alias("n_tokens"), F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.lit(SEED))).otherwise(F.xxhash64(F.col(text_col).cast("string"), F.lit(SEED + 1))).alias("h"), F.col(id_col).cast("long").alias("id"))


def _plan(rows: DataFrame, max_epochs: float | None, target_entropy: float | None, budget: float | None) -> tuple[DataFrame | None, Temperature]:
    """Per source: s, weight, full passes, and end, the last place that the pass after them takes."""
    sources = rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"))
    sources = materialise(sources.where("tokens > 0"), "mix-sources")
    whole = sources.agg(F.sum("tokens").alias("t")).first()["t"]
    if not whole:
        return None, Temperature(1.0, 0.0, 0.0)
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(whole)))
    chosen = choose(shares, max_epochs, target_entropy, budget)
    [(z, _)] = _at(shares, [chosen.exponent])
    weight = F.pow("share", F.lit(chosen.exponent)) / F.lit(z)
    plan = shares.select("src", "tokens", weight.alias("weight")).withColumn("due", F.round(F.col("weight") * F.lit(chosen.budget)).cast("long"))
    plan = materialise(plan.select("src", "weight", F.expr("due div tokens").cast("int").alias("full"), F.expr("due % tokens").alias("rest")), "mix-plan")
    of = plan.select(F.col("src").alias("s"), "full", "rest")
    # Where the last pass ends: in which block, in which block of that one, and at which document.
    last = rows.where("n_tokens > 0").join(of, F.col("src") == F.col("s")).where("rest > 0").select("src", "id", "n_tokens", "rest", _place(F.col("full")).alias("place"))
    of_source = W.partitionBy("src")
    for level in (1, 2):
        block = F.shiftright("place", 63 - level * BITS)
        sums = last.groupBy("src", "rest", block.alias("block")).agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(of_source.orderBy("block")))
        cut = sums.where("upto >= rest and upto - n < rest").select(F.col("src").alias("s"), F.col("block").alias("cut"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))
        last = last.drop("rest").join(materialise(cut, "mix-cut"), (F.col("src") == F.col("s")) & (block == F.col("cut"))).select("src", "id", "n_tokens", F.col("left").alias("rest"), "place")
    places = last.groupBy("src", "rest", "place").agg(F.sum("n_tokens").alias("n"))
    upto = places.withColumn("before", F.sum("n").over(of_source.orderBy("place")) - F.col("n"))
    end = materialise(upto.where("before < rest").groupBy("src").agg(F.max("place").alias("end")).select(F.col("src").alias("s2"), "end"), "mix-end")
    return plan.join(end, F.col("src") == F.col("s2"), "left").select(F.col("src").alias("s"), "weight", "full", "end"), chosen


_ADDED = ("n_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_place")


def mix(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", columns: list[str] | None = None) -> tuple[DataFrame, Temperature]:
    """(mixture, temperature). mixture: columns of docs (all by default) with n_tokens, mix_weight, mix_epoch, mix_block and mix_place for each use of each row.

    A source's weight is its share of all tokens to the power of the exponent, normalised; its budget is weight * the
    whole budget. It is passed over as often as that holds all its tokens; the last pass takes whole blocks in the
    order of that pass's permutation, then part of one block, and ends with the document that reaches the budget. To
    be read by (mix_epoch, mix_place): the place orders a pass. A null source is a source of its own. Documents
    without tokens (null, empty) are used once per full pass. Repeated ids share a place and are taken together; rows without an id are placed by their text.
    Columns of docs that bear the name of an added one are replaced. An empty table gives no rows. A hot source is cut
    by sums over its 2**BITS blocks and theirs, never sorted as a whole.
    """
    small = _rows(docs, id_col, text_col, source_col)
    plan, chosen = _plan(materialise(small.drop("row"), "mix-rows"), max_epochs, target_entropy, budget)
    rows = _rows(docs.select(*(f"`{c}`" for c in (columns or docs.columns)), *(F.col(c) for c in {id_col, text_col, source_col} - set(columns or docs.columns))), id_col, text_col, source_col)
    if plan is None:
        used = rows.withColumns({"weight": F.lit(0.0), "epoch": F.lit(0)})
    else:
        plan = materialise(plan, "mix-ends")
        small = plan.count() <= BROADCAST_SOURCES
        used = rows.join(F.broadcast(plan) if small else plan, F.col("src") == F.col("s"), "left")
        passes = F.coalesce("full", F.lit(1)) + F.when((F.col("n_tokens") > 0) & (_place(F.col("full")) <= F.col("end")), 1).otherwise(0)
        used = used.withColumn("passes", passes).where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    kept = [F.col("row").getField(c).alias(c) for c in (columns or docs.columns) if c not in _ADDED]
    place = _place(F.col("epoch"))
    return used.select(*kept, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("mix_weight"), F.col("epoch").alias("mix_epoch"), F.shiftright(place, 63 - 2 * BITS).cast("int").alias("mix_block"), place.alias("mix_place")), chosen


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id", "source"])
    return mixture
