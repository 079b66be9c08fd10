"""Collision-counting search against brute force."""

from __future__ import annotations

import math

import numpy as np
from gleaner.llm import neighbours
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k: int = 5):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            scores = [(-float((q * x).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), j) for b, (j, x) in enumerate(good) if b != a and len(x) == len(q)]
            out[i] = sorted(scores)[:k]
    return out


def search(spark, rows):
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


def test_recall_and_order(spark):
    random = np.random.default_rng(1)
    centres = random.standard_normal((10, 32))
    points = (centres[random.integers(0, 10, 3000)] + 0.7 * random.standard_normal((3000, 32))).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(points)]
    got, want = search(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    same = [q for q in want if [j for _, j in got[q]] == [j for _, j in want[q]]]
    assert np.allclose([s for q in same for s, _ in got[q]], [s for q in same for s, _ in want[q]])


def test_odd_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, None, "a"), (3, [], "a"), (4, [0.0, 0.0], "a"), (5, [1.0, None], "a"), (6, [float("nan"), 1.0], "a")]
    rows += [(7, [float("inf"), 1.0], "a"), (8, [3.0, 0.0], "a"), (9, [1.0, 1.0, 1.0], "a"), (50, [0.0, 1.0], None), (50, [0.0, 1.0], None), (None, [1.0, 0.0], "a")]
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect()
    first = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert first == [(1, 1, 1.0), (2, 8, 1.0), (3, 50, 0.0), (4, 50, 0.0)]
    assert sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 50) == sorted([(1, 50), (2, 0), (3, 1), (4, 8)] * 2)


def test_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], "x") for i in range(400)]
    got = search(spark, rows)
    assert [j for _, j in got[0]] == [1, 2, 3, 4, 5] and [j for _, j in got[100]] == [0, 1, 2, 3, 4]
    assert search(spark, [(1, [1.0], "x")]) == {}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_later_queries_do_less_and_find_the_same():
    """Points without clusters, where windows get wide: a search that starts at the radius
    the first ones ended with visits a fraction of the entries, and loses nothing."""
    points = np.random.default_rng(3).standard_normal((4000, 64))
    index = neighbours.Index(points, np.arange(4000), np.arange(4000))
    visited = []
    count = index.hits
    index.hits = lambda *stretches: (visited.append(sum(int((b - a).sum()) for a, b in stretches)), count(*stretches))[1]
    pilots = [index.nearest(points[i], i, 5)[1] for i in range(neighbours.PILOTS)]
    first, hits = float(np.median(pilots)), 0
    visited.clear()
    for i in range(100, 200):
        found, radius = index.nearest(points[i], i, 5, first)
        scores = points @ points[i] / np.linalg.norm(points, axis=1)
        scores[i] = -2
        hits += len({j for j, _ in found} & set(np.argsort(-scores)[:5].tolist()))
        assert radius <= 2 and len(found) == 5
    assert hits >= 0.98 * 500
    assert sum(visited) <= 0.5 * 100 * neighbours.M * 4000
