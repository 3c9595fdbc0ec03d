"""What the training-data operators share: tables, batches of bounded size, written intermediate results."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sloflow.session import configure, materialize

#: UTF-8 bytes of text that a Python worker takes at once; a single longer text is a batch of its own.
BATCH_BYTES = 4_000_000

__all__ = ["BATCH_BYTES", "column_or_null", "first_by_hash", "ready", "slices", "table", "text_batches", "texts_of", "written"]


def ready(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for rows that are whole documents."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    _importable(spark)
    return spark


def _importable(spark: SparkSession) -> None:
    """Python workers that see this folder find the package as the driver does, wherever they were started."""
    folder = str(Path(__file__).resolve().parents[2])
    known = [x for x in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if folder not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*known, folder])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a Parquet copy in the shared folder: computed once, and safe from lost executors."""
    return materialize(df, name)


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column, or typed nulls where the table has none of that name."""
    return F.col(f"`{name}`").cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def first_by_hash(df: DataFrame, kind: str, number: str, most: int) -> DataFrame:
    """Per value of ``kind`` up to ``most`` rows of ``df`` in the order of a hash of ``number``, with column place.

    The counts per kind tell below which hash value the rows are sought, with room for chance, so no task
    sorts more than about ``2 * most + 200`` rows of a kind; with very few hashes there may be less than ``most``.
    """
    counts = df.groupBy(kind).agg(F.count("*").alias("_n"))
    share = (F.lit(2.0 * most) + 200) / F.col("_n")
    near = df.withColumn("_turn", F.xxhash64(number)).join(F.broadcast(counts), kind).where(F.col("_turn").cast("double") <= share * 2.0**64 - 2.0**63)
    order = Window.partitionBy(kind).orderBy("_turn", number)
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_turn", "_n")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` has at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, column):
        yield batch, texts_of(batch, column)
