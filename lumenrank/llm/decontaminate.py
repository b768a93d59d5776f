"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenrank.llm.common import materialise, split_by_sketch

#: A tile has so many tokens at least; so has a seed.
MIN_TILE = 5
#: A document holds an item if tiles cover so much of the item's tokens.
COVERAGE = 0.8
#: Benchmarks of up to so many characters of text are broadcast as an index; larger ones are joined by their seeds.
BROADCAST_CHARS = 4 << 20
#: Places of a document that are looked up at once, a bound on memory for very long texts.
CHUNK = 1 << 17

_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SIEVE_BITS = 20


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _TOKEN.findall(text.lower()) if text else []


def running_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all stretches of size ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * _BASE + ids[j : j + n]
    return h * _BASE


def _prefix(ids: np.ndarray) -> np.ndarray:
    """Sums from which _stretch reads the Karp-Rabin hash of any stretch."""
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(ids), _BASE)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * powers[:-1], dtype=np.uint64)])


def _stretch(sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(sums), _INVERSE)]))
    return (sums[start + length] - sums[start]) * inverse[start]


class Index:
    """The seeds of benchmark items of min_tile tokens and more: the places of each hash, by the token before them."""

    def __init__(self, items: list[tuple[int, str]], min_tile: int = MIN_TILE):
        self.min_tile, self.vocabulary, self.names, self.items = min_tile, {}, [], []
        hashes, owner, place, before = [], [], [], []
        for name, text in items:
            words = tokens(text)
            if not min_tile <= len(words):
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            h = running_hashes(ids, min_tile)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.items)))
            place.append(np.arange(len(h)))
            before.append(np.concatenate([np.full(1, -1), ids[: len(h) - 1].astype(np.int64)]))
            self.names.append(name)
            self.items.append(ids)
        flat, own, at, prev = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owner, int), (place, int), (before, np.int64)))
        self.hashes, rank = np.unique(flat, return_inverse=True)
        # ids are 1 and up, 0 is a word of no item; the start of an item, coded last, follows no word
        self.width = len(self.vocabulary) + 2
        code = rank.reshape(-1) * self.width + np.where(prev < 0, self.width - 1, prev)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.place = code[order], own[order], at[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.hashes >> np.uint64(64 - _SIEVE_BITS)] = True

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))

    def seeded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the document, ranks of their hashes) of all shared seeds."""
        h = running_hashes(ids, self.min_tile)
        at = np.flatnonzero(self.sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        if not len(at):
            return at, at
        rank = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[rank] == h[at]
        return at[same], rank[same]

    def hopeful(self, ranks: np.ndarray, coverage: float) -> np.ndarray:
        """Which items' seeds cover enough of them: tiles are made of seeds and cannot cover more."""
        out = np.zeros(len(self.items), bool)
        ranks = np.unique(ranks)
        lo, hi = np.searchsorted(self.code, ranks * self.width), np.searchsorted(self.code, (ranks + 1) * self.width)
        rows = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)]) if len(ranks) else np.zeros(0, int)
        owner, place = self.owner[rows], self.place[rows]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, int)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            k = owner[x]
            cover = self.min_tile + np.minimum(np.diff(place[x:y]), self.min_tile).sum()
            out[k] = cover >= coverage * len(self.items[k])
        return out

    def starts(self, ids: np.ndarray, at: np.ndarray, ranks: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in it, place in the document) of the seeds of wanted items that cannot be extended to the left.

        A run of shared tokens has one such seed, so texts that repeat a token give no square of seeds.
        """
        out = []
        for x in range(0, len(at), CHUNK):
            where, rank = at[x : x + CHUNK], ranks[x : x + CHUNK] * self.width
            prev = np.where(where > 0, ids[np.maximum(where, 1) - 1], np.uint64(0)).astype(np.int64)
            lo, hi = np.searchsorted(self.code, rank), np.searchsorted(self.code, rank + self.width)
            # all places but those after the same known word
            mid, end = (np.where(prev > 0, np.searchsorted(self.code, rank + prev, side), lo) for side in ("left", "right"))
            for a, b in ((lo, mid), (end, hi)):
                n = b - a
                row = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                keep = wanted[self.owner[row]]
                out.append((self.owner[row][keep], self.place[row][keep], np.repeat(where, n)[keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def runs(item: np.ndarray, doc: np.ndarray, place: np.ndarray, where: np.ndarray, min_tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the item, place in the document, tokens) of the longest matches from these starts, by bisection over Karp-Rabin hashes; matches under min_tile are left out."""
    a, b = _prefix(item), _prefix(doc)
    lo, hi = np.zeros(len(place), int), np.minimum(len(item) - place, len(doc) - where)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = _stretch(a, place, mid) == _stretch(b, where, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    keep = lo >= min_tile
    return place[keep], where[keep], lo[keep]


def tile(item: np.ndarray, doc: np.ndarray, place: np.ndarray, where: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling from starts of matches: (place in item, place in document, tokens) of each tile.

    The longest match whose tokens are all unmarked is marked, again and again, until none of min_tile tokens is left;
    of equal ones the first in the item, then in the document. A match that is part marked comes back as what is left.
    """
    p, w, n = runs(item, doc, place, where, min_tile)
    order = np.lexsort((w, p, -n))
    p, w, n = p[order], w[order], n[order]
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    left: list[tuple[int, int, int]] = []
    k = 0
    while k < len(p) or left:
        if left and (k >= len(p) or left[0] < (-n[k], p[k], w[k])):
            size, x, y = heapq.heappop(left)
            size = -size
        else:
            size, x, y = int(n[k]), int(p[k]), int(w[k])
            k += 1
        free = ~(in_item[x : x + size] | in_doc[y : y + size])
        if free.all():
            if not np.array_equal(item[x : x + size], doc[y : y + size]):  # equal hashes are not yet equal tokens
                free &= item[x : x + size] == doc[y : y + size]
            else:
                in_item[x : x + size] = in_doc[y : y + size] = True
                out.append((x, y, size))
                if in_item.all():
                    break
                rest = np.concatenate([np.zeros(1, int), np.cumsum(~in_item)])
                keep = rest[p[k:] + n[k:]] - rest[p[k:]] >= min_tile
                p, w, n, k = p[k:][keep], w[k:][keep], n[k:][keep], 0
                continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(int), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= min_tile:
                heapq.heappush(left, (s - e, x + s, y + s))
    return out


def indexes(items: list[tuple[int, str]], min_tile: int) -> list[Index]:
    """An index of the items of min_tile tokens and more, and one for each smaller number of tokens: a short item's only seed is all of it."""
    by_size: dict[int, list[tuple[int, str]]] = {}
    for name, text in items:
        if n := len(tokens(text)):
            by_size.setdefault(min(n, min_tile), []).append((name, text))
    return [Index(of, size) for size, of in sorted(by_size.items())]


Match = tuple[int, float, int, int, int]


def match(found_by: list[Index], text: str | None, coverage: float) -> list[Match]:
    """(item, share of its tokens under tiles, tiles, longest tile, tokens of the item) for each item that text holds."""
    words, out = tokens(text), []
    for index in found_by:
        ids = index.ids(words)
        at, ranks = index.seeded(ids)
        if not len(at):
            continue
        wanted = index.hopeful(ranks, coverage)
        if not wanted.any():
            continue
        owner, place, where = index.starts(ids, at, ranks, wanted)
        for k in np.flatnonzero(wanted):
            item, mine = index.items[k], owner == k
            tiles = tile(item, ids, place[mine], where[mine], index.min_tile)
            covered = sum(n for _, _, n in tiles)
            if tiles and covered >= coverage * len(item):
                out.append((index.names[k], covered / len(item), len(tiles), max(n for _, _, n in tiles), len(item)))
    return out


_SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int, item_tokens int"
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _small(benchmark: DataFrame, most: int) -> list[tuple[int, str]] | None:
    """The items, if they have most characters or fewer."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.char_length("text") + 8)).first()[0] or 0) > most:
        return None
    return [(r[0], r[1]) for r in items.collect()]


def _seeds(texts: DataFrame, sizes: list[int] | None, min_tile: int) -> DataFrame:
    """(k, size, n, seeds) of rows (k, text): the distinct hashes of all stretches of size tokens, and how many stretches there are.

    sizes None: of the one size that the text has as an item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(text)
                ids = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
                for size in sizes if sizes is not None else [min(len(words), min_tile)] if words else []:
                    h = running_hashes(ids, size)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([size], pa.int32()), pa.array([len(words)], pa.int64()), pa.array([np.unique(h).view(np.int64)], pa.list_(pa.int64()))], ["k", "size", "n", "seeds"])

    return texts.select("k", "text").mapInArrow(run, "k long, size int, n long, seeds array<long>")


def _joined(docs: DataFrame, benchmark: DataFrame, coverage: float, min_tile: int) -> DataFrame:
    """(dk, ik, coverage, n_tiles, longest_tile, item_tokens) of documents (dk, text) and items (ik, text), keyed by the hashes of their texts, by a join of their seeds.

    Tiles that cover enough of an item hold a share 1 / min_tile of that many seeds at least, so one of its rarest seeds
    is among them; only those are joined. Nothing is gathered on the driver, and a text moves once for each item it may hold.
    """
    items = materialise(benchmark.select(F.col("ik").alias("k"), "text").dropDuplicates(["k"]), "tile-items")
    of_item = materialise(_seeds(items, None, min_tile).select("k", "size", "n", F.explode("seeds").alias("h")), "tile-item-seeds")
    sizes = [r[0] for r in of_item.select("size").distinct().collect()]  # min_tile numbers at most
    texts = docs.select(F.col("dk").alias("k"), "text")
    of_doc = _seeds(texts, sizes, min_tile).select(F.col("k").alias("dk"), F.col("size").alias("s"), F.explode("seeds").alias("g"))
    of_doc, _ = split_by_sketch(of_doc, F.col("g"), of_item.select("h").distinct())
    of_doc = materialise(of_doc.distinct(), "tile-doc-seeds")
    often = of_doc.groupBy("g", "s").agg(F.count("*").alias("docs"))
    ranked = of_item.join(often, (F.col("h") == F.col("g")) & (F.col("size") == F.col("s")), "left")
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(F.coalesce("docs", F.lit(0)), "h")))
    # seeds are counted by kind here: those that repeat in an item only make the rarest set larger
    rare = ranked.where(F.col("docs").isNotNull() & (F.col("place") <= F.col("n") - F.col("size") + 2 - F.ceil(F.col("n") * coverage / F.col("size")))).select("k", "h", "size")
    pairs = rare.join(of_doc, (F.col("h") == F.col("g")) & (F.col("size") == F.col("s"))).select("dk", F.col("k").alias("ik")).distinct()
    pairs = materialise(pairs, "tile-pairs")
    asked = pairs.select(F.col("dk").alias("asked")).distinct()
    some, _ = split_by_sketch(texts, F.col("k"), asked.select(F.col("asked").alias("h")))
    some = some.join(asked, F.col("k") == F.col("asked"), "left_semi").dropDuplicates(["k"]).withColumnRenamed("text", "doc_text")
    rows = pairs.join(some, F.col("dk") == F.col("k")).drop("k").join(items, F.col("ik") == F.col("k")).select("dk", "ik", "doc_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dk, ik, doc, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield _batch([(dk, *m) for m in match(indexes([(ik, item)], min_tile), doc, coverage)])

    return rows.mapInArrow(run, _SCHEMA).withColumnsRenamed({"doc_id": "dk", "item_id": "ik"})


def _key(text: str):
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, broadcast_chars: int = BROADCAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile, item_tokens): every document with every item it holds, whole or reordered.

    Whole texts of any length are tiled against whole items. An item of fewer than min_tile tokens is held where all its
    tokens stand in a row; items without tokens, null and empty texts hold nothing; repeated rows and repeated items each
    come back; a null id stays null; other columns are not read; empty tables give no rows. Benchmarks of up to
    broadcast_chars characters are broadcast and no document moves; larger ones are joined by seeds, with the same result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = _small(benchmark, broadcast_chars)
    if held is None:
        docs = docs.withColumn("dk", _key("text"))
        items = _items(benchmark).withColumn("ik", _key("text"))
        found = materialise(_joined(docs, items, coverage, min_tile), "tiles")
        found = found.join(items.select("item_id", F.col("ik").alias("i")), F.col("ik") == F.col("i"))
        some, _ = split_by_sketch(docs.select("doc_id", "dk"), F.col("dk"), found.select(F.col("dk").alias("h")).distinct())
        return found.join(some.withColumnRenamed("dk", "d"), F.col("dk") == F.col("d")).select(*_NAMES)
    index = docs.sparkSession.sparkContext.broadcast(indexes(held, min_tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in match(index.value, t, coverage)])

    return docs.mapInArrow(run, _SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, broadcast_chars: int = BROADCAST_CHARS, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; all columns stay, whatever their names.

    An item of fewer than min_tile tokens, which many a clean text holds by chance, only drops documents that have no
    other tokens. Null and empty texts stay, repeated rows go or stay together, empty tables drop nothing. Nothing moves
    between tasks while the benchmark has broadcast_chars characters or fewer; beyond, only documents that may go.
    """
    at, held = docs.columns.index(text_col), _small(benchmark, broadcast_chars)
    if held is not None:
        index = docs.sparkSession.sparkContext.broadcast(indexes(held, min_tile))

        def leaks(text: str | None) -> bool:
            found = match(index.value, text, coverage)
            return any(m[4] >= min_tile for m in found) or (bool(found) and len(tokens(text)) in {m[4] for m in found})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not leaks(t) for t in b.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), _key(text_col).alias("dk"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    found = _joined(rows, _items(benchmark).withColumn("ik", _key("text")), coverage, min_tile)
    short = found.where(F.col("item_tokens") < min_tile).select("dk", "item_tokens")
    long = found.where(F.col("item_tokens") >= min_tile).select("dk")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [len(tokens(t)) == n for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.select([0]).filter(pa.array(same, pa.bool_()))

    short = rows.select(F.col("dk").alias("d"), "text").join(short, F.col("d") == F.col("dk")).select("dk", "text", "item_tokens").mapInArrow(whole, "dk long")
    gone = materialise(long.unionAll(short).distinct().select(F.col("dk").alias("gone")), "tile-gone")
    some, others = split_by_sketch(rows, F.col("dk"), gone.select(F.col("gone").alias("h")))
    kept = others.unionAll(some.join(gone, F.col("dk") == F.col("gone"), "left_anti"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
