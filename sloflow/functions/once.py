"""Keep derived columns from being computed more than once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns``, for expensive columns that are filtered on later.

    Catalyst pushes a filter below a projection by copying the filtered column's expression into the
    filter, and again through every projection below.  With chains of map and regex expressions the
    copies multiply.  The one-row ``inline_outer`` is a place the filter does not pass.
    """
    kept = [name for name in df.columns if name not in columns]
    box = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(box)))


def exploded(df: DataFrame, name: str, rows: Column) -> DataFrame:
    """One row per array element, and none for an empty or NULL array.

    The plain ``explode`` would first filter on the array's size, which evaluates it twice.
    """
    return df.withColumn(name, F.explode_outer(rows)).filter(F.col(name).isNotNull())
