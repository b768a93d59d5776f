"""Repeated passages by seed and extend: winnowed anchors join, matches extend both ways, long repeats go."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenrank.llm.common import materialise, split_by_sketch

#: A repeat has so many words at least.
MIN_WORDS = 50
#: Words of an anchor; every passage of MIN_WORDS holds at least one anchor that its words alone choose.
ANCHOR = 8
#: Up to so many different surroundings of one anchor are extended pair by pair; of more each is extended to every window's length and looked up.
PAIRWISE = 64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Hasher:
    """Hashes of words and of stretches of words. Word hashes are kept for frequent reuse, within a bound."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.seen = keep, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxh64_intdigest(w)
            out.append(h)
        return np.array(out, _U)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which stretch() reads the hash of any stretch."""
    return np.concatenate([np.zeros(1, _U), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=_U)])


def stretch(sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of the words [start, start + length): the same for equal words wherever they stand."""
    inverse = _powers(_INVERSE, len(sums))
    return _mixed((sums[start + length] - sums[start]) * inverse[start] + np.asarray(length).astype(_U) * _U(0xD6E8FEB86659FD93))


def anchored_runs(hashes: np.ndarray, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of all words of the run, first window, windows, words before the anchor) of each run of windows that choose the same anchor.

    Each window of min_words chooses the least of its anchor-word stretches, the last of equals; a document of fewer words has none.
    """
    n = len(hashes) - min_words + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    sums = prefix(hashes)
    grams = stretch(sums, np.arange(len(hashes) - anchor + 1), anchor)
    width = min_words - anchor + 1
    place = np.empty(n, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 14) + width - 1], width)[: min(1 << 14, n - at), ::-1]
        place[at : at + len(part)] = np.arange(at, at + len(part)) + (width - 1 - part.argmin(axis=1))
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[start, n])
    return grams[place[start]], stretch(sums, start, count + (min_words - 1)), start, count, place[start] - start


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _seeds(docs: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """Per document: words, digest of all of them, and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            n, sha, runs = [], [], [[], [], [], [], []]
            sizes = [0]
            for t in b.column(2).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                n.append(len(words))
                sha.append(_digest(words))
                found = anchored_runs(hasher.words(words), min_words, anchor) if len(words) >= min_words else anchored_runs(np.zeros(0, _U), min_words, anchor)
                for all_of, x in zip(runs, found, strict=True):
                    all_of.append(x)
                sizes.append(sizes[-1] + len(found[0]))
            a, h, *places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in runs)
            fields = [pa.array(a.astype(_U).view(np.int64)), pa.array(h.astype(_U).view(np.int64)), *(pa.array(x.astype(np.int32)) for x in places)]
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["anchor", "whole", "start", "windows", "at"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], ["doc_id", "tid", "n_words", "sha", "runs"])

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, n_words long, sha string, runs array<struct<anchor: long, whole: long, start: int, windows: int, at: int>>")


def _contexts(docs: DataFrame, min_words: int) -> DataFrame:
    """The words of the runs named in column runs: (anchor, whole, doc_id, at, words, wins). words are hashes of 8 bytes each; of a run of a hot anchor wins, the hashes of its windows, come instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for doc_id, t, runs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                hashes = hasher.words(t.split())
                hot = [np.arange(r["start"], r["start"] + r["windows"]) for r in runs if r["hot"]]
                hot = iter(np.split(stretch(prefix(hashes), np.concatenate(hot), min_words).view(np.int64), np.cumsum([len(x) for x in hot])) if hot else ())
                words = [None if r["hot"] else hashes[r["start"] : r["start"] + r["windows"] + min_words - 1].tobytes() for r in runs]
                wins = [next(hot) if r["hot"] else None for r in runs]
                cols = [pa.array([r[k] for r in runs], t) for k, t in (("anchor", pa.int64()), ("whole", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([doc_id] * len(runs), pa.int64()), pa.array([r["at"] for r in runs], pa.int32()), pa.array(words, pa.binary()), pa.array(wins, pa.list_(pa.int64()))], ["anchor", "whole", "doc_id", "at", "words", "wins"])

    return docs.mapInArrow(run, "anchor long, whole long, doc_id long, at int, words binary, wins array<long>")


def extended(words: list[np.ndarray], at: list[int], docs: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(place in the lists, first word, words): the maximal matches of min_words and more of each run with runs of smaller documents, which share the anchor that stands at[i] words into run i.

    Every match is extended from the anchor to the left and to the right as far as words are equal.
    """
    n = len(words)
    left, right = max(at), max(len(w) - a for w, a in zip(words, at, strict=True))
    # padding differs from row to row and from all words, so no match runs into it
    mat = np.empty((n, left + right), np.uint64)
    real = np.zeros((n, left + right), bool)
    for i, (w, a) in enumerate(zip(words, at, strict=True)):
        mat[i, left - a : left - a + len(w)] = w
        real[i, left - a : left - a + len(w)] = True
    doc = np.array(docs)
    for i in range(n):
        others = np.flatnonzero(doc < doc[i])
        if not len(others):
            continue
        same = (mat[others] == mat[i]) & real[others] & real[i]
        back = np.logical_and.accumulate(same[:, :left][:, ::-1], axis=1).sum(axis=1)
        ahead = np.logical_and.accumulate(same[:, left:], axis=1).sum(axis=1)
        long = back + ahead >= min_words
        for x, y in sorted(set(zip(back[long].tolist(), ahead[long].tolist(), strict=True))):
            yield i, at[i] - x, x + y


def _extend(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (anchor, whole, doc_id, at, words) sorted by anchor, PAIRWISE of one anchor at most: (anchor, whole, offset, windows) of what is repeated of each run."""

    def out(anchor: int, rows: list[tuple]) -> pa.RecordBatch:
        whole, docs, at, words = zip(*rows, strict=True)
        found = list(extended([np.frombuffer(w, _U) for w in words], list(at), list(docs), min_words))
        cols = [[anchor] * len(found), [whole[i] for i, _, _ in found], [x for _, x, _ in found], [n - min_words + 1 for _, _, n in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["anchor", "whole", "offset", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            for anchor, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != held and rows:
                    yield out(held, rows)
                    rows = []
                held = anchor
                rows.append(tuple(row))
        if rows:
            yield out(held, rows)

    return run


def keep_mask(n: int, ranges: list[tuple[int, int]], min_words: int) -> np.ndarray:
    """Which of n words no repeated window covers; ranges: (first window, windows)."""
    edge = np.zeros(n + 1, np.int64)
    for start, windows in ranges:
        edge[start] += 1
        edge[start + windows - 1 + min_words] -= 1
    return np.cumsum(edge[:-1]) == 0


def _finished(docs: DataFrame, min_words: int) -> DataFrame:
    """Documents with their maximal repeats, column ranges, taken out: (doc_id, tid, n_removed, kept_sha, text if wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, sha, kept_text = [], [], []
            for t, ranges in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (t or b"").split()
                keep = keep_mask(len(words), [(r["start"], r["windows"]) for r in ranges], min_words)
                kept = [words[i] for i in np.flatnonzero(keep)]
                removed.append(len(words) - len(kept))
                sha.append(_digest(kept))
                kept_text.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "tid", "n_removed", "kept_sha", "kept"])

    return docs.mapInArrow(run, "doc_id long, tid long, n_removed long, kept_sha string, kept string")


def _repeats(docs: DataFrame, min_words: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """(per document: words and digest; per affected document: its ranges of repeated windows)."""
    seeded = materialise(_seeds(docs, min_words, anchor), "sub-seeds")
    runs = seeded.where("doc_id is not null").select("doc_id", "tid", F.explode("runs").alias("r")).select("doc_id", "tid", "r.*")
    # Seeds join: the least and the greatest document of each run of words; an anchor is open if its runs first stand in several documents.
    whole = runs.groupBy("anchor", "whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    mixed = whole.groupBy("anchor").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.count("*").alias("n")).where("lo < hi").select((F.col("anchor") + F.lit(0)).alias("m"), (F.col("n") > PAIRWISE).alias("hot"))
    met = whole.join(mixed, F.col("anchor") == F.col("m"), "left").where("last > first or m is not null")
    met = materialise(met.select(F.col("anchor").alias("a"), F.col("whole").alias("w"), "first", F.col("m").isNotNull().alias("open"), F.coalesce("hot", F.lit(False)).alias("hot")), "sub-met")
    # A run that an earlier document holds as a whole is repeated from end to end: both ends of the match are the run's.
    # The first document that holds it may share part of it with documents where the anchor stands in other words.
    hits = runs.join(met, (F.col("anchor") == F.col("a")) & (F.col("whole") == F.col("w"))).where("doc_id > first or open")
    hits = materialise(hits.select("doc_id", "tid", "anchor", "whole", "start", "windows", "at", "hot", (F.col("doc_id") > F.col("first")).alias("covered")), "sub-hits")
    once = hits.where("not covered").groupBy("anchor", "whole").agg(F.min(F.struct("doc_id", "tid", "start", "windows", "at", "hot")).alias("r"))
    opened = once.select("anchor", "whole", "r.*").groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t")).agg(F.collect_list(F.struct("anchor", "whole", "start", "windows", "at", "hot")).alias("runs"))
    texts, _ = split_by_sketch(docs, F.xxhash64("doc_id"), hits.where("not covered").select(F.xxhash64("doc_id").alias("h")).distinct())
    texts = texts.dropDuplicates(["doc_id", "tid"]).join(opened, (F.col("doc_id") == F.col("d")) & (F.col("tid") == F.col("t"))).select("doc_id", "text", "runs")
    found = materialise(_contexts(texts, min_words), "sub-contexts")
    pairs = found.where("words is not null").select("anchor", "whole", "doc_id", "at", "words").repartition("anchor").sortWithinPartitions("anchor")
    late = pairs.mapInArrow(_extend(min_words), "anchor long, whole long, offset int, windows int")
    single = found.where("words is null").select("anchor", "whole", "doc_id", F.posexplode("wins").alias("offset", "win"))
    least = single.groupBy("anchor", "win").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    least = least.select((F.col("anchor") + F.lit(0)).alias("a"), (F.col("win") + F.lit(0)).alias("w"), "first")
    hot = single.join(least, (F.col("anchor") == F.col("a")) & (F.col("win") == F.col("w"))).where("doc_id > first").select("anchor", "whole", "offset", F.lit(1).alias("windows"))
    late = late.unionAll(hot).groupBy(F.col("anchor").alias("a"), F.col("whole").alias("w")).agg(F.collect_list(F.struct("offset", "windows")).alias("parts"))
    late = hits.where("not covered").select("doc_id", "tid", "anchor", "whole", "start").join(late, (F.col("anchor") == F.col("a")) & (F.col("whole") == F.col("w")))
    late = late.select("doc_id", "tid", "start", F.explode("parts").alias("p")).select("doc_id", "tid", (F.col("start") + F.col("p.offset")).alias("start"), "p.windows")
    covered = hits.where("covered").select("doc_id", "tid", "start", "windows").unionAll(late)
    ranges = covered.groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t")).agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
    return seeded, materialise(ranges, "sub-ranges")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text, and tid, which tells apart different texts under one doc_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("tid"), "text")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of docs: each word in a window of min_words that also starts in a document with a smaller doc_id is taken out.

    Words are parted by ASCII white space and kept unchanged. kept is the text that is left, null where nothing was taken out (or texts=False). Windows are those
    of the input, not of what is left. Null texts have no words; a text repeated only within its document stays; rows
    that share a doc_id are one document; rows with a null doc_id stay whole and take nothing from others. An empty
    table gives no rows. Exact but for collisions of 64-bit hashes.
    """
    docs = _rows(docs, id_col, text_col)
    seeded, ranges = _repeats(docs, min_words, anchor)
    texts, _ = split_by_sketch(docs, F.xxhash64("doc_id"), ranges.select(F.xxhash64("d").alias("h")).distinct())
    done = _finished(texts.join(ranges, (F.col("doc_id") == F.col("d")) & (F.col("tid") == F.col("t"))).select("doc_id", "tid", "text", "ranges"), min_words)
    done = (done if texts else done.drop("kept").withColumn("kept", F.lit(None).cast("string"))).withColumnsRenamed({"doc_id": "d", "tid": "t"})
    done = done.dropDuplicates(["d", "t"])
    out = seeded.select("doc_id", "tid", "n_words", "sha").join(done, (F.col("doc_id") == F.col("d")) & (F.col("tid") == F.col("t")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "kept")


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words): stretches of min_words and more all of whose windows stand in documents with smaller doc_ids, as long as can be; start counts words.

    Matches that go on from one anchor's words to the next's are one stretch. Texts, ids and empty tables as in remove_repeats.
    """
    _, ranges = _repeats(_rows(docs, id_col, text_col), min_words, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for doc_id, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start, end = None, -1
                for r in sorted(of, key=lambda r: r["start"]):
                    if start is None or r["start"] > end:
                        if start is not None:
                            out.append((doc_id, start, end - start + min_words - 1))
                        start, end = r["start"], r["start"]
                    end = max(end, r["start"] + r["windows"])
                out.append((doc_id, start, end - start + min_words - 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["doc_id", "start", "n_words"])

    return ranges.select("d", "ranges").mapInArrow(run, "doc_id long, start long, n_words long")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")
