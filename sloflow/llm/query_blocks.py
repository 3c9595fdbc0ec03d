"""A set of query vectors against all vectors, in blocks: every pair meets once, in a cell of two blocks.

Queries and rows are dealt into blocks by a hash of their row number.  A cell holds one block of queries and
streams one block of rows past them, so a task holds ``QUERY_BLOCK`` queries and one chunk of rows at a time,
whatever the tables' sizes.  Copies of a vector are dealt like any others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that a task holds at once.
QUERY_BLOCK = 16_384
#: Rows that one cell reads, between the least and the most.
ROW_BLOCK = (1_024, 65_536)


class Cell(Protocol):
    """What happens in one cell: ``rows`` gets the chunks, ``result`` gives one batch or None."""

    def rows(self, chunk: pa.Table) -> None: ...

    def result(self) -> pa.RecordBatch | None: ...


def usable(name: str) -> Column:
    """Whether the array column is not null and has neither null nor non-finite components."""
    x = F.col(name)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad, F.lit(False))


def against_all(
    queries: DataFrame, rows: DataFrame, order: list[str], begin: Callable[[pa.Table], Cell], ddl: str, chunk_rows: int = 4096
) -> DataFrame:
    """``begin(queries)`` for each cell with queries, and its ``rows`` and ``result``.

    Both tables have a column ``row``, the number that deals them out; a column that only one of them has is null
    for the other.  ``order`` sorts the rows of a cell.  Without queries or rows the result is empty.
    """
    spark = rows.sparkSession
    n_queries, n_rows = queries.count(), rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_q = max(1, math.ceil(n_queries / QUERY_BLOCK))
    least, most = ROW_BLOCK
    of_r = max(1, math.ceil(n_rows / most), min(math.ceil(2 * tasks / of_q), math.ceil(n_rows / least)))
    zero = F.lit(0)
    # Different seeds: else a query block of few rows would meet its own rows in few row blocks.
    asked = queries.withColumns({"of_q": F.pmod(F.xxhash64("row"), F.lit(of_q)).cast("int"), "of_r": F.explode(F.sequence(zero, F.lit(of_r - 1))), "kind": zero})
    there = rows.withColumns({"of_r": F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(of_r)).cast("int"), "of_q": F.explode(F.sequence(zero, F.lit(of_q - 1))), "kind": F.lit(1)})
    together = asked.unionByName(there, allowMissingColumns=True)
    keys = ["of_q", "of_r", "kind"]
    # As many partitions as cells: they are few, large and of one size.
    dealt = together.repartition(max(1, min(of_q * of_r, 100_000)), "of_q", "of_r").sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(_visit(begin, chunk_rows), ddl)


def _visit(begin: Callable[[pa.Table], Cell], chunk_rows: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        asked: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        cell: Cell | None = None

        def pass_on() -> None:
            nonlocal cell
            if waiting and asked:
                cell = cell or begin(pa.Table.from_batches(asked).combine_chunks())
                cell.rows(pa.Table.from_batches(waiting).combine_chunks())
            waiting.clear()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal cell
            pass_on()
            found = cell.result() if cell else None
            if found is not None and found.num_rows:
                yield found
            asked.clear()
            cell = None

        for batch in batches:
            if not batch.num_rows:
                continue
            q, r, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("of_q", "of_r", "kind"))
            new = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (kind[1:] != kind[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if at != (q[a], r[a]):
                    yield from close()
                    at = (q[a], r[a])
                if kind[a] == 0:
                    asked.append(batch.slice(a, b - a))
                    continue
                waiting.append(batch.slice(a, b - a))
                if sum(x.num_rows for x in waiting) >= chunk_rows:
                    pass_on()
        yield from close()

    return visit


def matrix(column: pa.ChunkedArray | pa.Array, kind: np.dtype | type, width: int) -> np.ndarray:
    """The binary cells of a column, all of ``width`` values, as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class Best:
    """The ``k`` best per slot by falling score, ties to the smaller id, null ids last, then by row."""

    def __init__(self, slots: int, k: int, least: float):
        self.k, self.slots = k, slots
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.asarray(least).dtype)
        self.id, self.row, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: The k-th score of a slot, or ``least`` where it has fewer.
        self.bar = np.full(slots, least)
        self.least = least

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, known: np.ndarray) -> None:
        fit = score >= self.bar[slot]
        if not fit.any():
            return
        columns = [np.concatenate([old, new[fit]]) for old, new in zip((self.slot, self.score, self.id, self.row, self.known), (slot, score, id_, row, known), strict=True)]
        slot, score, id_, row, known = columns
        order = np.lexsort((row, id_, ~known, -score, slot))
        slot = slot[order]
        starts = np.searchsorted(slot, slot, side="left")
        place = np.arange(len(slot)) - starts
        kept = order[place < self.k]
        self.slot, self.score, self.id, self.row, self.known = (c[kept] for c in columns)
        full = slot[place == self.k - 1]
        self.bar[full] = columns[1][order[place == self.k - 1]]
