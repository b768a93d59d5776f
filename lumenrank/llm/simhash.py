"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenrank.llm.common import connected_components, materialise

SHINGLE, SEED, RADIUS = 3, 42, 3
#: The fingerprint is punctured at one of so many blocks of WIDTH bits.
BLOCKS, WIDTH = 4, 16
_LOW = np.uint64((1 << WIDTH) - 1)
_FLIPS = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
#: A wider radius, for callers that check what they find: of WIDE differing bits at most 2 lie in one of the (first bit, bits) blocks.
WIDE, WIDE_BLOCKS = 8, ((0, 22), (22, 21), (43, 21))
#: Runs of up to so many fingerprints are compared pair by pair, larger ones by a search.
SHORT_RUN = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles of a UTF-8 text; ASCII white space parts words; no words give zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    ones, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(grams), step):  # bounded memory for very long texts
        h = np.fromiter(map(xxh64_intdigest, grams[at : at + step], repeat(seed)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(grams), bitorder="little")
    return int(bits.view("<u8")[0])


def simhash_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes: a bit is 1 if set in over half of them; of no hashes zero."""
    ones, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _tid(text: Column) -> Column:
    """A hash that tells apart different texts under one doc_id."""
    return F.xxhash64(text.cast("string"))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tid, text) of every row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _tid(F.col(text_col)).alias("tid"), F.col(text_col).cast("string").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, fp): one row per row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "tid", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, tid long, fp long")


def _turned(fp: np.ndarray, block: int) -> np.ndarray:
    """fp turned so that the block to erase comes lowest."""
    s = np.uint64(WIDTH * block)
    return (fp >> s) | (fp << np.uint64((64 - WIDTH * block) % 64)) if block else fp


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and block: the punctured fingerprint and all its one-bit variants. The erased bits of the key say which block and kind it is."""
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(every), 512):
            fp = every[at : at + 512]
            keys = []
            for block in range(BLOCKS):
                kept = _turned(fp, block) & ~_LOW
                keys.append((kept | np.uint64(2 * block + 1))[:, None])
                keys.append((kept | np.uint64(2 * block))[:, None] ^ (np.uint64(1) << np.arange(WIDTH, 64, dtype=np.uint64))[None, :])
            key = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, key.shape[1]).view(np.int64))], ["key", "fp"])


def _hub_links(run: np.ndarray, hub: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Links among fingerprints of one run (key) by hub, the value that a one-bit variant has in the erased block.

    All with one hub lie in one ball of radius 1, so a star stands for all their pairs; two hubs one bit apart
    bring together distances of up to 3. Links found: linear in the rows, never all pairs.
    """
    order = np.lexsort((fp, hub, run))
    code, fp = (run[order].astype(np.int64) << WIDTH) | hub[order].astype(np.int64), fp[order]
    first = np.r_[True, code[1:] != code[:-1]]
    heads, codes = fp[first], code[first]
    lead = heads[np.cumsum(first) - 1]
    out = [np.stack([lead[~first], fp[~first]])]
    for flip in _FLIPS.astype(np.int64):
        to = codes ^ flip
        at = np.minimum(np.searchsorted(codes, to), len(codes) - 1)
        hit = (codes[at] == to) & (codes < to)
        out.append(np.stack([heads[hit], heads[at[hit]]]))
    return out


def _links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Verified links among rows sorted by key, whole runs of equal keys only."""
    new = np.r_[True, key[1:] != key[:-1]]
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    if not many.any():
        return np.zeros((2, 0), np.uint64)
    key, fp, run = key[many], fp[many], run[many]
    tag = key & _LOW
    value = np.zeros_like(fp)
    for block in range(BLOCKS):
        here = (tag >> np.uint64(1)) == block
        value[here] = _turned(fp[here], block) & _LOW
    out = []
    ball = (tag & np.uint64(1)) == 0
    if ball.any():
        out += _hub_links(run[ball], value[ball], fp[ball])
    if not ball.all():  # equal outside the block: the balls meet inside it
        r, v, f = run[~ball], value[~ball], fp[~ball]
        hubs = np.concatenate([v[:, None], v[:, None] ^ _FLIPS[None, :]], axis=1)
        out += _hub_links(np.repeat(r, WIDTH + 1), hubs.ravel(), np.repeat(f, WIDTH + 1))
    pairs = np.concatenate(out, axis=1)
    pairs = pairs[:, (pairs[0] != pairs[1]) & (np.bitwise_count(pairs[0] ^ pairs[1]) <= RADIUS)]
    return np.unique(np.sort(pairs, axis=0), axis=1) if pairs.shape[1] else pairs


def _met(batches: Iterator[pa.RecordBatch], links: Callable[[np.ndarray, np.ndarray], np.ndarray] = _links) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key; holds one batch and the run that may go on. A run of near_links has at most 48 * 2**16 rows."""

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["a", "b"])

    key, fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for b in batches:
        key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)])
        fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if cut:
            yield out(np.ascontiguousarray(links(key[:cut], fp[:cut])))
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield out(np.ascontiguousarray(links(key, fp)))


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) whose components are those of all pairs at RADIUS or less.

    RADIUS 3 is odd, so half of it is no whole number of bits. A pair within 3 is within 2 once a block that holds a
    differing bit is erased; so each fingerprint, punctured at each of BLOCKS blocks, emits its ball of radius 1, and
    balls meet in the middle. 196 keys a fingerprint rather than the 2,081 of a whole ball of radius 2; no pair is lost.
    """
    spread = fps.select("fp").mapInArrow(_variants, "key long, fp long")
    return spread.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_met, "a long, b long")


def _wide_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and wide block: the block's value and all its one-bit variants, the block's number above them."""
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(every), 2048):
            fp = every[at : at + 2048]
            keys = []
            for block, (low, bits) in enumerate(WIDE_BLOCKS):
                value = ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1) | np.uint64(block << 22)).astype(np.int32)[:, None]
                keys += [value, value ^ (np.int32(1) << np.arange(bits, dtype=np.int32))[None, :]]
            key = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, key.shape[1]).view(np.int64))], ["key", "fp"])


def _wide_run(fp: np.ndarray) -> np.ndarray:
    """Trees over the components of one run under WIDE bits. A fingerprint is compared only with those not reached yet, so a dense run of n costs about n comparisons."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    left = fp
    while len(left):
        found, left = [left[:1]], left[1:]
        for some in found:  # grows meanwhile
            for x in some:
                hit = np.bitwise_count(left ^ x) <= WIDE
                if hit.any():
                    found.append(left[hit])
                    a.append(np.full(len(found[-1]), x))
                    b.append(found[-1])
                    left = left[~hit]
                if not len(left):
                    break
    return np.stack([np.concatenate(a), np.concatenate(b)])


def _wide_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links at WIDE bits or fewer among rows sorted by key, whole runs of equal keys only; they hold each run's components together."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[start, len(key)])
    after = np.repeat(start + n, n) - np.arange(len(key)) - 1  # rows of the run that follow
    out = [np.zeros((2, 0), np.uint64)]
    here, d = np.flatnonzero(np.repeat(n <= SHORT_RUN, n)), 1
    while len(here := here[after[here] >= d]):
        near = here[np.bitwise_count(fp[here] ^ fp[here + d]) <= WIDE]
        out.append(np.stack([fp[near], fp[near + d]]))
        d += 1
    out += [_wide_run(fp[s : s + k]) for s, k in zip(start[n > SHORT_RUN], n[n > SHORT_RUN], strict=True)]
    pairs = np.concatenate(out, axis=1)
    return np.unique(np.sort(pairs, axis=0), axis=1) if pairs.shape[1] else pairs


def wide_links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) whose components are those of all pairs at WIDE bits or fewer.

    Ball hashing as in near_links, at a wider radius: two fingerprints within 8 bits differ in at most 2 bits of one of
    the three blocks, where their balls of radius 1 meet. 67 keys a fingerprint; no pair is lost. Keys of 21 bits bring
    together more that lies apart, N / 100,000 or so a key of N fingerprints, which the whole fingerprint then rules out.
    """
    spread = fps.select("fp").mapInArrow(_wide_variants, "key int, fp long")
    return spread.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_met, links=_wide_links), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, fp, component_id, grp) for every row of docs: component_id is the least doc_id reachable over links of RADIUS bits or fewer.

    Null and empty texts have fingerprint zero and link like any other; texts of fewer than SHINGLE words are one
    shingle. Repeated rows each come back; a null doc_id never becomes a component_id unless its group has no other.
    Other columns of docs are not read. An empty table gives no rows.
    """
    return components_of(materialise(fingerprints(docs, id_col, text_col), "simhash-fps"), near_links)


def components_of(fps: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, tid, fp, component_id, grp) for every row of fps (doc_id, tid, fp), a table; links gives (a, b) among its distinct fp.

    grp is the least fp of a component: it tells apart components whose least doc_id is the same, as repeated ids may have it.
    """
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    comps = connected_components(links(reps), "simhash-cc")
    full = materialise(reps.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("comp")), "simhash-comps")
    least = full.groupBy("comp").agg(F.min("rep").alias("component_id")).select((F.col("comp") + F.lit(0)).alias("k"), "component_id")
    of_fp = materialise(full.join(least, F.col("comp") == F.col("k")).select(F.col("fp").alias("k"), "component_id", F.col("comp").alias("grp")), "simhash-ids")
    return fps.join(of_fp, F.col("fp") == F.col("k"), "left").select("doc_id", "tid", "fp", "component_id", "grp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", components: Callable[..., DataFrame] = simhash_components) -> DataFrame:
    """docs with one row of each group of near-duplicates, as components finds them; all columns stay, whatever their names.

    Kept is the row of the least doc_id; of different texts under that id the one of least hash; of rows that are equal
    in both any one. Null ids come after all others. An empty table gives no rows.
    """
    groups = components(docs, id_col, text_col).groupBy("grp", "doc_id", "tid").agg(F.count("*").alias("n"))
    kept = groups.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid", "n")).alias("x"))
    kept = materialise(kept.select(F.col("x.doc_id").alias("kept_id"), F.col("x.tid").alias("kept_tid"), F.col("x.n").alias("n")), "kept")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[f"`{id_col}`"].cast("long").alias("id"), _tid(docs[f"`{text_col}`"]).alias("tid"))
    same = lambda k: F.col("id").eqNullSafe(k["kept_id"]) & (F.col("tid") == k["kept_tid"])
    one, more = kept.where("n = 1"), kept.where("n > 1")
    out = rows.join(one, same(one), "left_semi")
    if not more.isEmpty():
        out = out.unionAll(rows.join(more, same(more), "left_semi").dropDuplicates(["id", "tid"]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
