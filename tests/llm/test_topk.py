"""Threshold algorithm against every inner product."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import threshold_topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, _key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, asks, k):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for q, query in kept:
        if q is None or not asks(q) or (q, tuple(query)) in done:
            continue
        done.add((q, tuple(query)))
        limit = 2**63 - 1
        found = [(max(-limit, min(limit, sum(a * b for a, b in zip(query, v)))), i) for i, v in kept if i != q]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def run(spark, rows, k=5):
    found = threshold_topk.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("seed,shape", [(1, "dense"), (2, "sparse"), (3, "skewed"), (4, "few values")])
def test_equals_brute_force(spark, monkeypatch, seed, shape):
    monkeypatch.setattr(threshold_topk, "BLOCK_ROWS", 150)
    monkeypatch.setattr(threshold_topk, "FIRST_DEPTH", 4)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(700, 12))
    if shape == "sparse":
        v *= rng.random(v.shape) < 0.2
    if shape == "skewed":
        v *= 3.0 ** -np.arange(12)
    if shape == "few values":
        v = rng.integers(-1, 2, v.shape) / 4
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    assert run(spark, rows) == brute(rows, lambda q: q % 10 == 0, 5)


def test_stops_early():
    """On skewed lists a query is answered from a small part of the rows."""
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(4000, 6)) * 8.0 ** -np.arange(6))
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            if np.ndim(self) == 2:
                scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    block = threshold_topk.Block(np.arange(4000), np.zeros(4000, bool), rows)
    block.rows = rows.view(Counted)
    places, scores = block.top(rows[7], None, 5)
    assert scores.tolist() == np.sort(rows @ rows[7])[::-1][:5].tolist()
    assert sum(scored) < 400


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (10, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (20, [nan, 1.0]), (3, [inf, 0.0]), (4, []), (30, []), (5, [1.0]), (6, [1.0, 2.0, 3.0]),
            (None, [0.5, -0.25]), (None, [9.0, 9.0]), (7, [0.5, -0.25]), (7, [0.5, -0.25]), (40, [0.0, 0.0]), (-10, [-0.001, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [2.0, 1.0])]
    assert run(spark, rows, 7) == brute(rows, lambda q: q % 10 == 0, 7)


def test_large_components(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[1e9, 3.0], [1e9, -5.0], [-1e9, 1.0], [1e30, -1e30], [1e38, 1e38], [0.0, 1.0], [2e7, 2e7]])]
    assert run(spark, rows) == brute(rows, lambda q: q % 10 == 0, 5)


def test_ties_and_few_rows(spark):
    rows = [(i, [0.25, 0.5]) for i in range(60)]
    assert run(spark, rows) == brute(rows, lambda q: q % 10 == 0, 5)
    assert run(spark, rows[:3]) == brute(rows[:3], lambda q: q % 10 == 0, 5)
    assert run(spark, rows[:1]) == [] and run(spark, []) == []
