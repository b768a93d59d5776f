"""Toxicity by compression distance: windows of text under a zstandard dictionary of ordinary text alone, and with one of toxic text behind it.

Departure from the plainest form: two dictionaries trained on whole windows of their classes and compared with each other
mostly tell apart which ordinary words each happens to hold (the README has figures), so the toxic one is trained on what
toxic windows have beyond ordinary ones, and both sides of the comparison know the same ordinary text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.common import materialise

#: The labelled sample: documents a class to train on, documents to calibrate on, and training windows a class at most.
TRAIN_DOCS, CALIBRATION_DOCS = 2500, 3000
TOXIC_WINDOWS, ORDINARY_WINDOWS = 6000, 12000
#: Bytes of a training window, and of a window that is scored.
TRAIN_BYTES, WINDOW_BYTES = 512, 64
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 2048
#: Stretches of so many bytes are compared between the classes; one is toxic if it occurs in MIN_PLACES surroundings and is CONTRAST times as frequent as in ordinary text.
GRAMS, MIN_PLACES, CONTRAST = (5, 8), 4, 20.0
_AROUND = 3
#: The same piece trains the toxic dictionary so often at most: variety counts, not how often a copied text was copied.
PIECE_REPEATS, PIECE_BYTES = 8, 24
#: Literals stay uncompressed and matches have 6 bytes or more, so that the length of a window says what the dictionary matched.
PARAMETERS = {"window_log": 17, "chain_log": 14, "hash_log": 14, "search_log": 4, "min_match": 6, "target_length": 1, "strategy": zs.STRATEGY_FAST, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
FOLDS = 5
STEPS = (1, 2, 3, 4, 6)
N_FEATURES = len(STEPS) + 4 + 4

_BASE = np.uint64(0x9E3779B97F4A7C15)


def windows(text: str | None, size: int) -> list[bytes]:
    """Whole words of the lower-case text in windows of size bytes or a little more; words longer than size are cut between characters, so no window has 2 * size bytes and more."""
    out, held, n = [], [], 0
    for w in (text or "").lower().encode("utf-8", "replace").split():
        while len(w) > size:
            cut = size
            while w[cut] & 0xC0 == 0x80:
                cut -= 1
            if held:
                out.append(b" ".join(held) + b" ")
                held, n = [], 0
            out.append(w[:cut])
            w = w[cut:]
        held.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" ".join(held) + b" ")
            held, n = [], 0
    if held:
        out.append(b" ".join(held) + b" ")
    return out


def _grams(a: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(0, len(a) - size + 1), np.uint64)
    for j in range(size):
        h = h * _BASE + (a[j : j + len(h)].astype(np.uint64) + np.uint64(1))
    return h


_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])


def _in_word(a: np.ndarray, size: int) -> np.ndarray:
    """Where a stretch holds letters only, but for its first byte."""
    ok = np.ones(max(0, len(a) - size + 1), bool)
    for j in range(1, size):
        ok &= _LETTER[a[j : j + len(ok)]]
    return ok


def _places(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches inside words, and in how many different surroundings each occurs: copies of one text count once."""
    end = len(a) - size - _AROUND + 1
    wide, ok = _grams(a, size + 2 * _AROUND), _in_word(a, size)[_AROUND:end]
    _, first = np.unique(wide[ok], return_index=True)
    return np.unique(_grams(a, size)[_AROUND:end][ok][first], return_counts=True)


def _flat(of: list[bytes]) -> np.ndarray:
    gap = b" " * 8
    return np.frombuffer(gap + gap.join(of) + gap, np.uint8)


def toxic_pieces(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic windows that ordinary text lacks: what the toxic dictionary is trained on."""
    t, o = _flat(toxic), _flat(ordinary)
    marks = []
    for size in GRAMS:
        gram, n = _places(t, size)
        other, m = _places(o, size)
        if not len(gram):
            marks.append(gram)
            continue
        at = np.minimum(np.searchsorted(other, gram), max(0, len(other) - 1))
        seen = np.where(other[at] == gram, m[at], 0) if len(other) else np.zeros(len(gram))
        marks.append(gram[(n >= MIN_PLACES) & (n / n.sum() > CONTRAST * (seen + 0.5) / max(1, m.sum()))])
    out, counts = [], Counter()
    for w in toxic:
        a = np.frombuffer(b" " + w, np.uint8)
        cover = np.zeros(len(a) + 1, int)
        for size, mark in zip(GRAMS, marks, strict=True):
            at = np.flatnonzero(np.isin(_grams(a, size), mark) & _in_word(a, size))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
        edges = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(cover[:-1]) > 0).astype(int), 0]))
        for x, y in zip(edges[::2], edges[1::2], strict=True):
            piece = a[x : min(y, x + PIECE_BYTES)].tobytes()
            counts[piece] += 1
            if counts[piece] <= PIECE_REPEATS:
                out.append(piece)
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on samples; where there is too little to train on, the samples themselves."""
    try:
        b = zs.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]
    # behind the entropy tables, which end with the three first offsets
    at = b.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")
    return b[at + 12 :] if at >= 0 else b


@dataclass
class Model:
    """Two dictionaries and the calibrated weights; without dictionaries the score is the same for every text."""

    ordinary: bytes = b""
    toxic: bytes = b""
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    rate: float = 0.5

    def scorer(self) -> Callable[[str | None], np.ndarray]:
        """text -> features, for one task."""
        if not self.toxic:
            return lambda text: np.zeros(N_FEATURES)
        kind = zs.ZstdCompressionParameters(**PARAMETERS)

        def compressor(content: bytes) -> Callable[[bytes], bytes]:
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=kind)
            return zs.ZstdCompressor(dict_data=d, compression_params=kind).compress

        # Both know ordinary text; one knows toxic text too, the other has nothing in its place.
        with_toxic, without = compressor(self.ordinary + self.toxic), compressor(self.ordinary + bytes(len(self.toxic)))

        def features(text: str | None) -> np.ndarray:
            gain = np.array([len(without(w)) - len(with_toxic(w)) for w in windows(text, WINDOW_BYTES)] or [0])
            top = np.sort(gain)[::-1]
            reach = [(gain >= k).sum() for k in STEPS]
            return np.array([*np.log1p(reach), *(r / len(gain) for r in reach[:4]), top[0], top[:3].sum(), gain.mean(), np.log1p(len(gain))])

        return features

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        x = np.clip(x, self.low, self.high)  # texts far longer than any in the sample count as its longest
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Ridge logistic regression of the labels on the features, which sets the threshold on window gains at a score of 0.5."""
    if len(set(y.tolist())) < 2:
        return
    model.low, model.high = x.min(axis=0), x.max(axis=0)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.1 * np.r_[0, w[1:]]
        w -= np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 0.1 * np.eye(len(w)), grad)
    model.weights = w


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Dictionaries and weights from a bounded sample of the labelled rows that are not held out.

    The sample: at most TRAIN_DOCS documents a class, cut to TOXIC_WINDOWS and ORDINARY_WINDOWS windows, and
    CALIBRATION_DOCS others, each the first in the order of a hash of the id, so any run draws the same. Whole texts of the
    drawn documents are cut into windows; of a stretch that toxic windows have beyond ordinary ones the first PIECE_BYTES
    train the toxic dictionary, PIECE_REPEATS times at most. Of several labels of a document the greatest counts; null
    labels and labels without a document are left out. Too few labels give a model without dictionaries.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id", F.lit(1)))
    drawn = known.where("pmod(h, 4) = 0").orderBy("h", "id").limit(CALIBRATION_DOCS).withColumn("role", F.lit(2))
    for toxic in (0, 1):
        drawn = drawn.unionAll(known.where(f"pmod(h, 4) <> 0 and toxic = {toxic}").orderBy("h", "id").limit(TRAIN_DOCS).withColumn("role", F.lit(toxic)))
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic", "role")
    sample = materialise(sample, "toxicity-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(windows(text, TRAIN_BYTES), pa.binary())], ["w"])

    def drawn_windows(toxic: int, most: int) -> list[bytes]:
        w = sample.where(f"role = {toxic}").select("text").mapInArrow(cut, "w binary").distinct()
        return [bytes(r[0]) for r in w.orderBy(F.xxhash64("w"), "w").limit(most).collect()]

    ordinary, toxic = drawn_windows(0, ORDINARY_WINDOWS), drawn_windows(1, TOXIC_WINDOWS)
    pieces = toxic_pieces(toxic, ordinary) if ordinary and toxic else []
    model = Model(trained(ordinary, ORDINARY_BYTES), trained(pieces, TOXIC_BYTES)) if pieces else Model()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for b in batches:
            x = [features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    rows = sample.where("role = 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCS).select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").collect()
    y = np.array([r[1] for r in rows], float)
    model.rate = float((y.sum() + 1) / (len(y) + 2))
    if pieces and len(rows):
        calibrate(model, np.array([r[0] for r in rows]), y)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; every window of every text, of any length, is compared.

    score only depends on the text; null and empty texts have no windows and get the score of a text that gains
    nothing. Repeated rows each come back; a null doc_id is not held out. Where the sample lacks a class, every score
    is the smoothed share of toxic labels. Other columns are not read; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for b in batches:
            s = model.scores(np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay, whatever their names, and nothing moves between tasks.

    The decision is on the text alone: repeated rows go or stay together, null and empty texts score as texts that gain
    nothing. Where the sample lacks a class all stay or go with the share of toxic labels. An empty table gives no rows.
    """
    model, at = fit(docs, labels, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for b in batches:
            s = model.scores(np.array([features(t) for t in b.column(at).to_pylist()]).reshape(-1, N_FEATURES))
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
