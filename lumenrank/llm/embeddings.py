"""Near-duplicate vectors by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.common import connected_components, materialise

#: Links are cosines of so much and more.
MIN_COSINE = 0.93
#: Projections, and the share of pairs right at MIN_COSINE that one projection's window must hold.
PROJECTIONS, IN_WINDOW = 32, 0.9
#: A pair right at MIN_COSINE reaches the needed count with so much chance; closer pairs reach it more often.
RECALL = 0.99
#: Vectors are dealt into cells of the first projection and into parts of about so many rows; a task compares two parts.
PART_ROWS = 1024
#: The first projection's window in standard deviations of a pair at MIN_COSINE; it is cut into so many cells.
REACH, CELLS = 4.5, 4
SEED = 20240229


def normal_quantile(p: float) -> float:
    """x with P(|N(0, 1)| < x) = p, by bisection."""
    lo, hi = 0.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < p else (lo, mid)
    return lo


def calibrated_count(m: int, p: float, recall: float) -> int:
    """The largest count c with P(Binomial(m, p) >= c) >= recall."""
    tail, c = 0.0, m + 1
    while tail < recall and c:
        c -= 1
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
    return c


def settings(min_cosine: float) -> tuple[float, float, int]:
    """(distance of unit vectors at min_cosine, half width of a window, needed count)."""
    far = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    return far, far * normal_quantile(IN_WINDOW), calibrated_count(PROJECTIONS, IN_WINDOW, RECALL)


def lines(dim: int) -> np.ndarray:
    """The projection lines: Gaussian, the same in every task and run."""
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, vectors) of the vectors that can link: in double precision, finite, not zero."""
    out, rows = [], []
    for i, v in enumerate(batch.column("embedding").to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max() if np.isfinite(x).all() else 0.0
            if top > 0:
                out.append(x)
                rows.append(i)
    return np.array(rows, int), out


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """How many projections hold each b within half of each a: every line's values are sorted, and the window centred on each query marks a stretch of them."""
    count = np.zeros((len(a), len(b)), np.uint8)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        values = b[order, j]
        lo, hi = np.searchsorted(values, a[:, j] - half, "left"), np.searchsorted(values, a[:, j] + half, "right")
        at = np.arange(len(b))
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        back = np.empty_like(order)
        back[order] = at
        count += inside[:, back]
    return count


def _compare(pair: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links of one pair of parts: per vector its number of links to the other part (copies counted), and a spanning forest of the links."""
    left, right = pair[pair.side <= 1], pair[pair.side >= 1]  # side 1: a part against itself
    same = bool((pair.side == 1).any())
    empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})
    if left.empty or right.empty:
        return empty
    _, half, need = settings(min_cosine)
    x, y = (np.array(s.embedding.tolist(), np.float64) for s in (left, right))
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    x, y = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y))
    basis = lines(x.shape[1])
    cand = collisions(x @ basis, y @ basis, half) >= need
    if same:
        cand &= np.tri(len(x), k=-1, dtype=bool).T
    i, j = np.nonzero(cand)
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        ok[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= min_cosine
    i, j = i[ok], j[ok]
    ids, n = [s.rep.to_numpy(np.int64) for s in (left, right)], [s.n.to_numpy(np.int64) for s in (left, right)]
    links_l, links_r = np.bincount(i, n[1][j], len(x)), np.bincount(j, n[0][i], len(y))
    rep = np.r_[ids[0][links_l > 0], ids[1][links_r > 0]]
    links = np.r_[links_l[links_l > 0], links_r[links_r > 0]].astype(np.int64)
    # A spanning forest keeps the component of every link with fewer rows than vectors.
    name = np.r_[ids[0], ids[0] if same else ids[1]]
    root = dict(zip(name.tolist(), name.tolist(), strict=True))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for p, q in zip(ids[0][i].tolist(), ids[1][j].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    return pd.DataFrame({"rep": rep, "links": links, "to": np.array([find(r) for r in rep.tolist()], np.int64)})


def near_vectors(vecs: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vecs (vec_id, embedding, label).

    Vectors link when labels are equal and not null and the cosine in double precision is min_cosine or more. Null,
    zero and non-finite vectors and those of another length link with nothing. Equal vectors of a label are one class
    with a count; classes are dealt by cell of the first projection and by parts of PART_ROWS, so neither a label nor a
    dense cell is ever one task. A null vec_id is kept as a row with no links. Rows that repeat a vec_id all come back; if
    their vectors differ they share a component and the sum of their links. An empty table gives no rows.
    """
    far, _, _ = settings(min_cosine)
    step = REACH * far / CELLS
    every = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    every = every.withColumn("label", F.concat("label", F.lit(":"), F.size("embedding").cast("string")))  # vectors of one length meet
    fit = every.where("vec_id is not null and label is not null and size(embedding) > 0")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis: dict[int, np.ndarray] = {}
        for b in batches:
            rows, x = _unit(b)
            cell = []
            for v in x:
                if len(v) not in basis:
                    basis[len(v)] = lines(len(v))[:, 0]
                line = basis[len(v)]
                v = v / np.abs(v).max()
                cell.append(math.floor(float(v @ line) / math.sqrt(float(v @ v)) / step))
            b = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], [*b.schema.names, "cell"])

    placed = fit.mapInArrow(project, "vec_id long, embedding array<double>, label string, cell long")
    placed = materialise(placed.withColumn("digest", F.xxhash64("label", "embedding")), "vec-placed")
    # Equal vectors: one class. The digest only deals them out; equality decides.
    classes = materialise(placed.groupBy("digest", "label", "embedding", "cell").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vec-classes")
    parts = materialise(classes.groupBy("label", "cell").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")), "vec-parts")
    # Each cell meets itself and the CELLS cells above it; each pair of parts meets once.
    mine = classes.join(parts.select(F.concat("label").alias("l"), (F.col("cell") + 0).alias("c"), "parts"), (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c"))).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("l", "c")
    steps = F.explode(F.expr(f"sequence(-{CELLS}, {CELLS})")).alias("off")
    near = parts.select("label", "cell", "parts").select("*", steps).select(F.col("label").alias("pl"), (F.col("cell") - F.col("off")).alias("pc"), "off", F.col("parts").alias("others"))
    around = materialise(near.join(parts.select(F.col("label").alias("pl2"), F.col("cell").alias("pc2")), (F.col("pl") == F.col("pl2")) & (F.col("pc") == F.col("pc2")), "left_semi").groupBy("pl", "pc").agg(F.collect_list(F.struct("off", "others")).alias("around")), "vec-around")
    met = mine.join(around, (F.col("label") == F.col("pl")) & (F.col("cell") == F.col("pc"))).select("label", "cell", "part", "rep", "n", "embedding", F.explode("around").alias("o"))
    met = met.select("label", "cell", "part", "rep", "n", "embedding", F.col("o.off").alias("off"), F.explode(F.expr("sequence(0L, o.others - 1)")).alias("other"))
    # (lower cell, its part, upper cell, its part): the row is on one side, or on both.
    met = met.select(
        "label",
        F.least("cell", F.col("cell") + F.col("off")).alias("c1"),
        F.abs("off").alias("up"),
        F.when(F.col("off") > 0, F.col("part")).when(F.col("off") < 0, F.col("other")).otherwise(F.least("part", "other")).alias("p1"),
        F.when(F.col("off") > 0, F.col("other")).when(F.col("off") < 0, F.col("part")).otherwise(F.greatest("part", "other")).alias("p2"),
        F.when(F.col("off") > 0, 0).when(F.col("off") < 0, 2).when(F.col("part") == F.col("other"), 1).when(F.col("part") < F.col("other"), 0).otherwise(2).alias("side"),
        "rep",
        "n",
        "embedding",
    )
    found = met.groupBy("label", "c1", "up", "p1", "p2").applyInPandas(lambda pair: _compare(pair, min_cosine), "rep long, links long, to long")
    found = materialise(found, "vec-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), "vec-cc")
    of_class = materialise(
        classes.join(links.select((F.col("rep") + 0).alias("r1"), "links"), F.col("rep") == F.col("r1"), "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select(F.col("digest").alias("d"), F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "vec-result",
    )
    linked = placed.join(of_class, (F.col("digest") == F.col("d")) & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    alone = every.where("vec_id is null or label is null or embedding is null or size(embedding) = 0").select("vec_id")
    bad = every.where("vec_id is not null and label is not null and size(embedding) > 0").where(
        "exists(embedding, x -> x is null or isnan(x) or x in (double('inf'), double('-inf'))) or forall(embedding, x -> x is not null and x = 0)"
    ).select("vec_id")
    single = alone.unionAll(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(single).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
