"""Nearest neighbours by collision counting over single projections.

Vectors and queries are dealt into blocks of bounded size, and each pair of
blocks is one task. A task projects its unit vectors on M random lines and sorts
each line once: one array a projection, no buckets. A query looks at windows
centred on its own projections; virtual rehashing widens all windows by the same
factor, so only the newly reached ends of each array are counted, or what is left
outside of them, if that is less. A vector whose collisions pass the threshold is
verified with the exact cosine. A query's search of a block ends once its k-th
verified distance is within the current radius: a vector within that radius has then
49 of 64 collisions on average and fails to reach ``NEEDED`` in about 1 case of 200,
which the measured recall counts. Once k are verified, no radius beyond the k-th
distance is needed. The first queries of a pair of blocks start with a small radius,
the others with the median that these ended with; a query with nearer neighbours
than that verifies more vectors, never fewer.
No radius exceeds 2, the largest distance of unit vectors; a query that gets there
(a block of fewer than k vectors, or of opposite ones) verifies what is left.
Nothing is capped.

Work: queries are a fixed share of all rows, so every block of vectors meets every
block of queries and the number of comparisons is quadratic in the rows, as the task
itself is; an index is built once a pair of blocks, for ``QUERY_BLOCK`` queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, take no part; vectors of another dimension
than the query's are no candidates; huge and tiny components are scaled by a power
of two, which changes no cosine; repeated rows are candidates of their own; ties go
to the smaller vec_id; an empty table gives no rows; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship

M = 64
HALF_WIDTH = 1.2  # of a window at radius 1, in standard deviations of a projected unit distance
NEEDED = 40  # of M collisions; a vector within the radius makes 49 +- 3.4
WIDEN = 1.3
FIRST_RADIUS = 0.1
PILOTS = 9  # queries that start there
BLOCK, QUERY_BLOCK = 16_384, 4_096
FOUND = "query_row long, query_id long, vec_id long, score double"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings the largest component to 0.5-1: squares
    neither overflow nor vanish, and a cosine keeps all its bits."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ascontiguousarray(np.ldexp(vectors, -exponent[:, None]))


class Index:
    """The sorted projections of one block."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, seed: int = 7):
        self.vectors, self.ids, self.rows = scaled(vectors), ids, rows
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.lines = np.random.default_rng(seed).standard_normal((M, vectors.shape[1]))
        projected = ((self.vectors / self.norms[:, None]) @ self.lines.T).T
        order = np.argsort(projected, axis=1, kind="stable")
        # the arrays one behind the other, each moved beyond the one before it: a single search finds all windows
        self.bound = float(np.abs(projected).max()) + 1.0
        self.moved = np.arange(M) * 4 * self.bound
        self.sorted = (np.take_along_axis(projected, order, axis=1) + self.moved[:, None]).ravel()
        self.order = order.ravel()
        self.begin = np.arange(M) * len(ids)

    def scores(self, which: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Cosines, summed row by row in double precision: equal vectors score equally."""
        held = self.vectors[which]
        held *= query
        return held.sum(axis=1) / (self.norms[which] * norm)

    def place(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sorted, np.clip(values, -self.bound, self.bound) + self.moved)

    def hits(self, *stretches: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How often each vector lies in the stretches (starts, ends) of the arrays."""
        parts = [self.order[a:b] for starts, ends in stretches for a, b in zip(starts.tolist(), ends.tolist()) if a < b]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids)) if parts else np.zeros(len(self.ids), np.int64)

    def nearest(self, query: np.ndarray, row: int, k: int, radius: float = FIRST_RADIUS) -> tuple[list[tuple[int, float]], float]:
        """The k best found, as (vec_id, score), and the radius that was needed."""
        n = len(self.ids)
        query = scaled(query[None])[0]
        norm = float(np.sqrt((query * query).sum()))
        centres = self.lines @ (query / norm)
        counts = np.zeros(n, np.int64)
        verified = self.rows == row
        low = high = self.place(centres)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        while True:
            a, b = self.place(centres - HALF_WIDTH * radius), self.place(centres + HALF_WIDTH * radius)
            if M * n - (b - a).sum() < (low - a).sum() + (b - high).sum():
                counts = M - self.hits((self.begin, a), (b, self.begin + n))
            else:
                counts += self.hits((a, low), (high, b))
            low, high = a, b
            candidates = np.flatnonzero((counts >= NEEDED) & ~verified)
            if radius > 2:  # beyond the largest distance of unit vectors
                candidates = np.flatnonzero(~verified)
            if len(candidates):
                verified[candidates] = True
                found = np.append(found, candidates)
                scores = np.append(scores, self.scores(candidates, query, norm))
                if len(found) > k:  # what is beyond the k best never returns
                    enough = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                    found, scores = found[enough], scores[enough]
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            last = float(np.sqrt(max(0.0, 2 - 2 * scores[k - 1]))) if len(found) >= k else np.inf
            if radius > 2 or last <= radius:
                return [(int(i), float(s)) for i, s in zip(self.ids[found], scores)], min(last, radius)
            radius = min(radius * WIDEN, last)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy()
    return flat.reshape(len(column), -1)


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            index = Index(_matrix(vectors.column("v")), vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy())
            rows, asked, needed = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy(), []
            matrix, first = _matrix(queries.column("v")), FIRST_RADIUS
            for i in np.argsort(rows).tolist():
                best, radius = index.nearest(matrix[i], int(rows[i]), k, first)
                if len(needed) < PILOTS:
                    needed.append(radius)
                    first = float(np.median(needed)) if len(needed) == PILOTS else FIRST_RADIUS
                for vec_id, score in best:
                    for column, x in zip(out, (int(rows[i]), int(asked[i]), vec_id, score)):
                        column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each query row."""
    spark = vectors.sparkSession
    ship(spark)
    chosen = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"), is_query.alias("query"))
    rows = materialize(
        chosen.where(F.coalesce(usable(F.col("v")), F.lit(False)) & F.col("vec_id").isNotNull())
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("dim", F.size("v")),
        "vectors",
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("query")).first()
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1

    def dealt(name: str, many: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(many)).cast("int").alias(name)

    def every(name: str, many: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)

    left = rows.select("row", "vec_id", "v", "dim", dealt("block", blocks), every("part", query_blocks))
    right = rows.where("query").select("row", "vec_id", "v", "dim", dealt("part", query_blocks), every("block", blocks))
    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), FOUND)
    # k rows a query and block
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
