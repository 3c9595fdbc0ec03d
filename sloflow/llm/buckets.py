"""Buckets of candidate rows: complete buckets from a sorted partition, and large ones dealt over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import written

#: Rows of a bucket that one task compares with each other; a larger one is cut into blocks.
BLOCK_ROWS = 4096
#: Rows of complete buckets that are looked at together.
TOGETHER = 200_000


def dealt(rows: DataFrame, keys: list[str], spread: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with columns of_a and of_b (blocks this copy is compared for) and own (block of the row).

    A bucket, the rows with equal ``keys``, of up to ``block_rows`` rows stays whole: blocks 0 and 0.  A larger one
    is cut into blocks by ``spread``, and each pair of blocks becomes a task of its own, so a row is copied
    once per block of its bucket and every pair of rows still meets exactly once: in the pair of their
    blocks.  The large buckets, at most rows / block_rows of them, are counted before they are broadcast.
    """
    large = written(rows.groupBy(*keys).count().where(F.col("count") > block_rows), "large-buckets")
    n_large = large.count()
    zero = F.lit(0)
    if not n_large:
        return rows.withColumns({"of_a": zero, "of_b": zero, "own": zero})
    sized = large.select(*keys, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    sized = F.broadcast(sized) if n_large <= 100_000 else sized
    own = F.pmod(spread, F.col("blocks")).cast("int")
    return (
        rows.join(sized, keys, "left")
        .withColumn("own", F.coalesce(own, zero))
        .withColumn("other", F.explode(F.sequence(zero, F.coalesce(F.col("blocks") - 1, zero))))
        .withColumns({"of_a": F.least("own", "other"), "of_b": F.greatest("own", "other")})
        .drop("blocks", "other")
    )


def whole_buckets(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete buckets, and where each bucket starts, from batches that are sorted by ``keys``."""
    waiting: list[pa.Table] = []
    rows = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        table = pa.concat_tables(waiting).combine_chunks()
        last = int(starts(table)[-1])
        if last:
            ready = table.slice(0, last)
            yield ready, starts(ready)
        waiting = [table.slice(last)]
        # An open bucket is looked at again only after as many new rows.
        rows = 0 if last else rows - TOGETHER
    if waiting:
        table = pa.concat_tables(waiting).combine_chunks()
        yield table, starts(table)


def by_bucket(rows: DataFrame, keys: list[str], order: list[str], work: Callable, ddl: str) -> DataFrame:
    """``work`` over the partitions of ``rows``, where the rows of each bucket are together and sorted."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, ddl)
