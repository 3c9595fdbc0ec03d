"""Ordered look-back over keys of any size.

"The latest earlier row of this key" and "the running sum of this key" are usually written as one
window per key.  A key that holds a large share of the rows would then be one task.  Here each key
is cut into chunks along its order: rows are reduced to one summary per (key, chunk) before any
shuffle of them, the small summaries carry values from chunk to chunk, and the row-level window
covers a single chunk only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"
_CARRY = "__carry_"


def time_chunk(ts: Column, seconds: float = 60.0) -> Column:
    """Chunk number of a timestamp; make chunks short enough for the rows of the largest key."""
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000)))


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the carried columns on (key, chunk); a NULL key is a key of its own."""
    renamed = carry.withColumnsRenamed({name: f"__r_{name}" for name in [*keys, _CHUNK]})
    condition = None
    for name in [*keys, _CHUNK]:
        part = df[name].eqNullSafe(renamed[f"__r_{name}"])
        condition = part if condition is None else condition & part
    return df.join(renamed, condition, "left").drop(*[f"__r_{n}" for n in [*keys, _CHUNK]])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[Column, Column | None]],
    chunk: Column,
) -> DataFrame:
    """For each row, values of the latest strictly earlier row of the same key.

    ``values`` maps an output name to ``(value, condition)``: only rows where the condition holds
    (all rows for None) are looked at, and the result is NULL if there is none.  ``chunk`` must not
    decrease along ``order``, and ``order`` must be total within a key.
    """
    position = F.struct(*[F.col(name) for name in order])
    staged = df.withColumn(_CHUNK, chunk)
    boxed = {
        name: F.when(F.lit(True) if condition is None else condition, F.struct(value.alias("v")))
        for name, (value, condition) in values.items()
    }
    summary = staged.groupBy(*keys, _CHUNK).agg(
        *[
            F.max_by(box, F.when(box.isNotNull(), position)).alias(_CARRY + name)
            for name, box in boxed.items()
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        _CHUNK,
        *[F.last(_CARRY + name, ignorenulls=True).over(earlier).alias(_CARRY + name) for name in values],
    )
    within = (
        Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = _attach(staged, carried, keys)
    found = joined.withColumns(
        {
            name: F.coalesce(F.last(box, ignorenulls=True).over(within), F.col(_CARRY + name))["v"]
            for name, box in boxed.items()
        }
    )
    return found.drop(_CHUNK, *[_CARRY + name for name in values])


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    chunk: Column,
) -> DataFrame:
    """For each row, sums over the rows of its key up to and including it."""
    staged = df.withColumn(_CHUNK, chunk)
    summary = staged.groupBy(*keys, _CHUNK).agg(
        *[F.sum(value).alias(_CARRY + name) for name, value in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        _CHUNK,
        *[F.sum(_CARRY + name).over(earlier).alias(_CARRY + name) for name in sums],
    )
    within = (
        Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = _attach(staged, carried, keys)
    return joined.withColumns(
        {
            name: F.coalesce(F.col(_CARRY + name), F.lit(0)) + F.coalesce(F.sum(value).over(within), F.lit(0))
            for name, value in sums.items()
        }
    ).drop(_CHUNK, *[_CARRY + name for name in sums])
