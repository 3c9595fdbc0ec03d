"""Nearest neighbours by collision counting over single projections.

Each of ``TABLES`` tables projects the unit vectors on one Gaussian direction and sorts the values.  A query
opens a window around its own value in every table; a vector collides once per table whose window holds it.
Windows grow with a radius R, their width always ``WIDTH * R`` (virtual rehashing: the arrays stay as they
are).  A vector at distance R falls into a window with a known chance, so one with at least
``threshold`` collisions is verified by its exact cosine, and the search ends once ``k`` verified vectors lie
within R.  A vector within R is missed with chance ``MISS`` at most, one much nearer hardly ever.

The arrays of a chunk of rows are sorted in the task that holds the chunk; every row is in them.  A window is
an interval of ranks, found by binary search, and a collision is a rank inside it.  Radii grow over a small
first chunk; the best so far are carried on, and later chunks are opened at once at the radius still needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloflow.llm.common import written
from sloflow.llm.query_blocks import Best, against_all, matrix, usable

TABLES = 200
WIDTH = 3.0
#: Chance to miss a vector exactly at the radius.
MISS = 0.03
#: Radii of the virtual rehashing; 2 is the largest distance of unit vectors, and then all rows collide.
RADII = (*(0.25 * 1.4**i for i in range(6)), 2.0)
#: Rows of the first chunk and of the others.
FIRST, CHUNK = 256, 2048
SEED = 12
#: Room for the rounding of projections.
_ROUNDING = 1e-5
_TILE = 64
_ROWS = "row long, vec_id long, query boolean, size int, vector binary, unit binary"


def threshold(tables: int = TABLES, width: float = WIDTH, miss: float = MISS) -> int:
    """The collisions that a vector at distance R has at least, but for a chance of ``miss``."""
    normal = NormalDist()
    chance = 2 * normal.cdf(width / 2) - 1
    return max(1, int(tables * chance + normal.inv_cdf(miss) * (tables * chance * (1 - chance)) ** 0.5))


def dots(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of columns ``p`` of x and ``q`` of y, each component added in turn, so equal vectors give equal sums."""
    found = np.zeros(len(p))
    for a, b in zip(x, y, strict=True):
        found += a[p] * b[q]
    return found


def lengths(x: np.ndarray) -> np.ndarray:
    every = np.arange(x.shape[1])
    return np.sqrt(dots(x, every, x, every))


def _tame(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, divided by a power of two: that changes no cosine."""
    largest = np.abs(x).max(1)
    power = np.frexp(largest)[1]
    odd = (power > 400) | (power < -400)
    return np.where(odd[:, None], np.ldexp(x, -np.where(odd, power, 0)[:, None]), x)


def _prepared(vectors: DataFrame, query: Column) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(usable("embedding") & F.exists("embedding", lambda v: v != 0)).withColumn("row", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(3)).to_numpy()
            for d in np.unique(size).tolist():
                own = batch.take(pa.array(np.flatnonzero(size == d)))
                x = _tame(own.column(3).flatten().to_numpy().reshape(-1, d))
                unit = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype("<f4")
                binary = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<f8"), unit)]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array(np.full(len(x), d, np.int32)), *binary], names=["row", "vec_id", "query", "size", "vector", "unit"]
                )

    return rows.select("row", "vec_id", "query", "embedding").mapInArrow(work, _ROWS)


def _directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, TABLES)).astype(np.float32)


class _Search:
    """One block of queries, and chunks of rows that pass by."""

    def __init__(self, queries: pa.Table, k: int):
        self.k, self.needed = k, threshold()
        self.best = Best(queries.num_rows, k, -np.inf)
        self.query_row = queries.column("row").to_numpy()
        self.query_id = queries.column("vec_id")
        size = queries.column("size").to_numpy()
        self.of = {}
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            part = queries.take(pa.array(at))
            vectors = np.ascontiguousarray(matrix(part.column("vector"), "<f8", d).T)
            self.of[d] = (at, vectors, lengths(vectors), matrix(part.column("unit"), "<f4", d) @ _directions(d))
        self.begun: set[int] = set()

    def rows(self, chunk: pa.Table) -> None:
        size = chunk.column("size").to_numpy()
        for d in np.unique(size).tolist():
            if d not in self.of:
                continue
            own, start = chunk.take(pa.array(np.flatnonzero(size == d))), 0
            while start < own.num_rows:
                count = CHUNK if d in self.begun else FIRST
                self._chunk(*self.of[d], own.slice(start, count).combine_chunks(), d)
                self.begun.add(d)
                start += count

    def _chunk(self, slots: np.ndarray, asked: np.ndarray, asked_length: np.ndarray, at: np.ndarray, chunk: pa.Table, d: int) -> None:
        vectors = np.ascontiguousarray(matrix(chunk.column("vector"), "<f8", d).T)
        length = lengths(vectors)
        row, ids = chunk.column("row").to_numpy(), chunk.column("vec_id").combine_chunks()
        known, number = ids.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        values = (matrix(chunk.column("unit"), "<f4", d) @ _directions(d)).T
        order = np.argsort(values, axis=1)
        arrays = np.take_along_axis(values, order, 1)
        rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.uint16)[None], 1)
        radii = np.array(RADII)
        for i in range(0, len(slots), _TILE):
            own = np.arange(i, min(i + _TILE, len(slots)))
            own_row = self.query_row[slots[own]]
            verified = own_row[:, None] == row  # its own row is no candidate
            # The distance of the k-th best so far, if there are as many, else all radii in turn.
            far = np.sqrt(np.maximum(0, 2 - 2 * self.best.bar[slots[own]]))
            settled = np.isfinite(far)
            level = np.zeros(len(own), np.int64)
            busy = np.arange(len(own))
            while len(busy):
                last = level[busy] == len(RADII) - 1
                radius = np.where(settled[busy], far[busy], radii[level[busy]])
                reach = np.where(last & ~settled[busy], np.inf, radius * (WIDTH / 2) + _ROUNDING)
                p, q = np.nonzero((self._collisions(arrays, rank, at[own[busy]], reach) >= self.needed) & ~verified[busy])
                verified[busy[p], q] = True
                p = own[busy[p]]
                score = dots(asked, p, vectors, q) / (asked_length[p] * length[q])
                self.best.add(slots[p], score, number[q], row[q], known[q])
                found = np.sqrt(np.maximum(0, 2 - 2 * self.best.bar[slots[own[busy]]]))
                done = settled[busy] | last | (found <= radius)
                level[busy] += 1
                busy = busy[~done]

    @staticmethod
    def _collisions(arrays: np.ndarray, rank: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Tables in which each row lies in the window of each query."""
        count = np.zeros((len(centres), rank.shape[1]), np.uint8)
        offset, inside = np.empty(count.shape, np.uint16), np.empty(count.shape, bool)
        low, high = (centres - reach[:, None]).T, (centres + reach[:, None]).T
        for t in range(len(arrays)):
            first = np.searchsorted(arrays[t], low[t], "left").astype(np.uint16)
            wide = np.searchsorted(arrays[t], high[t], "right").astype(np.uint16) - first
            # As unsigned numbers, one comparison for both ends of the window.
            np.subtract(rank[t], first[:, None], out=offset)
            np.less(offset, wide[:, None], out=inside)
            np.add(count, inside, out=count, casting="unsafe")
        return count

    def result(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_row[b.slot]), self.query_id.take(pa.array(b.slot)).combine_chunks(), pa.array(b.id, mask=~b.known), pa.array(b.row), pa.array(b.score)],
            names=["query_row", "query_id", "vec_id", "row", "score"],
        )


def nearest(vectors: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` (vec_id, embedding) where ``query`` holds: query_id, rank, vec_id, score.

    Nearness is the cosine in double precision, largest first, ties to the smaller vec_id (null last), then in order of
    reading.  Vectors that are null, empty, zero or have null or non-finite components take no part; vectors of
    different sizes never meet.  A row is no candidate of itself, but a repeated row is one of its copy.  A query
    with fewer than ``k`` candidates gets all of them: its radius grows until all rows collide.  Other columns are not
    looked at; no queries or no rows give an empty table.
    """
    table = written(_prepared(vectors, query), "search-vectors")
    rows = table.drop("query")
    ddl = "query_row long, query_id long, vec_id long, row long, score double"
    found = against_all(table.where("query").drop("query"), rows, ["row"], lambda queries: _Search(queries, k), ddl)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
