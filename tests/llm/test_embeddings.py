"""Near vectors against all pairs."""

import numpy as np
import pytest

from lumenrank.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, cell string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "x", "x") for i, v, lab in rows], SCHEMA)


def plain(rows, cosine=0.93):
    ok = lambda v: v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
    n, ids = {}, sorted(i for i, _, _ in rows)
    root = {i: i for i in ids}
    unit = {i: np.array(np.array(v, np.float32), float) / np.linalg.norm(np.array(np.array(v, np.float32), float)) for i, v, _ in rows if ok(v)}
    lab = {i: c for i, _, c in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in ids:
        n[i] = 0
        for j in ids:
            if i != j and i in unit and j in unit and lab[i] is not None and lab[i] == lab[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, n[i], find(i), find(i) == i) for i in ids}


def test_edge_cases(spark):
    v = [1.0, 2.0, -1.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 4, 1), (7, [1.0, None, 2.0, 3.0], 1), (8, [1.0, float("nan"), 2.0, 3.0], 1), (9, [float("inf"), 0.0, 0.0, 0.0], 1), (10, [1e-30, 2e-30, -1e-30, 5e-31], 1), (11, [1.0, 2.0], 1), (12, [], 1), (13, [3e38, 3e38, -3e38, 3e38], 3), (14, [1.0, 1.0, -1.0, 1.0], 3), (15, [-x for x in v], 1)]
    assert {tuple(r) for r in em.near_vectors(table(spark, rows)).collect()} == plain(rows)
    assert em.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in em.near_vectors(table(spark, [(None, v, 1)])).collect()] == [(None, 0, None, False)]


@pytest.mark.parametrize("seed", range(2))
def test_recall_and_no_false_links(spark, seed, monkeypatch):
    """Clusters of all tightnesses, one dense one, in small parts: links found are true, and 0.9 of all are found."""
    monkeypatch.setattr(em, "PART_ROWS", 16)
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        for _ in range(60 if c == 0 else 8):
            rows.append((len(rows), (centre + rng.standard_normal(32) * rng.choice([0.05, 0.15, 0.3])).tolist(), int(rng.integers(2)) if c else 0))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]
    got = {r.vec_id: r for r in em.near_vectors(table(spark, rows)).collect()}
    want = {i: (n, comp) for i, n, comp, _ in plain(rows)}
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(got[i].n_links for i in want) >= 0.9 * sum(n for n, _ in want.values()) > 0
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.9 * len(want)


def test_count_is_calibrated():
    far, half, need = em.settings(0.93)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    lines = em.lines(64)
    hits = (np.abs(a @ lines - b @ lines) <= half).sum(1) >= need
    assert hits.mean() > 0.97


def test_collisions_by_windows():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((7, 5)), rng.standard_normal((9, 5))
    want = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.7).sum(2)
    assert (em.collisions(a, b, 0.7) == want).all()
