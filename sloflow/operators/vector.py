"""Vectors: DataFrames of label columns, an evaluation time ``ts`` and a ``value``.

A label that is NULL, empty or has no column is the same thing: an absent label.  A table without
``ts`` holds constants that are valid at every time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.regex import anchored, expand, matches

_INFINITY = float("inf")


def label_names(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in ("ts", "value")]


def label(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.coalesce(df[name], F.lit(""))
    if "labels" in df.columns:
        return F.coalesce(strmap.lookup(df["labels"], name), F.lit(""))
    return F.lit("")


def select_series(df: DataFrame, matchers: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Keep rows whose labels fit all ``(name, operator, text)``; operators ``= != =~ !~``.

    Patterns must match the whole label, and an absent label is an empty text.
    """
    for name, operator, text in matchers:
        found = label(df, name)
        if operator in ("=", "!="):
            condition = found == text
        elif operator in ("=~", "!~"):
            condition = matches(found, anchored(text))
        else:
            raise ValueError(f"unknown matcher {operator!r}")
        df = df.filter(condition if operator in ("=", "=~") else ~condition)
    return df


def ieee_div(numerator: Column, denominator: Column) -> Column:
    """Division of doubles that gives infinities and NaN instead of an error."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d == 0, n * F.lit(_INFINITY)).otherwise(F.try_divide(n, d))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": ieee_div,
}


def _ordered(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Comparisons with NaN are false."""
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & test(a, b)


COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "==": _ordered(lambda a, b: a == b),
    "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
}


def _keys(left: DataFrame, right: DataFrame, on: Sequence[str] | None) -> list[str]:
    if on is not None:
        return list(on)
    return sorted(set(label_names(left)) | set(label_names(right)))


def _same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in on:
        condition = condition & (label(left, name) == right[f"__on_{name}"])
    if "ts" in left.columns and "__on_ts" in right.columns:
        condition = condition & (left["ts"] == right["__on_ts"])
    return condition


def _one_side(df: DataFrame, on: Sequence[str], include: Sequence[str]) -> DataFrame:
    """One row per key; a second row of a key makes the query fail."""
    keys = [label(df, name).alias(f"__on_{name}") for name in on]
    if "ts" in df.columns:
        keys.append(df["ts"].alias("__on_ts"))
    extra = [F.any_value(label(df, name)).alias(f"__inc_{name}") for name in include]
    one = df.groupBy(*keys).agg(
        F.any_value("value").alias("__value"), F.count("*").alias("__rows"), *extra
    )
    checked = F.when(
        F.col("__rows") > 1,
        F.raise_error(F.lit("many rows on the one side of a vector match")).cast("double"),
    ).otherwise(F.col("__value"))
    return one.withColumn("__value", checked).drop("__rows")


def vmatch(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | None = None,
    group: str | None = None,
    include: Sequence[str] = (),
) -> DataFrame:
    """Pair rows of equal ``on`` labels (all labels for None) at the same time.

    ``group="left"`` allows many left rows per right row, ``"right"`` the reverse; the labels
    ``include`` are copied from the "one" side.  The other side's value is in ``other``.
    """
    if group == "right":
        swapped = vmatch(right, left, on, "left", include)
        kept = [c for c in swapped.columns if c not in ("value", "other")]
        return swapped.select(*kept, F.col("other").alias("value"), F.col("value").alias("other"))
    keys = _keys(left, right, on)
    one = _one_side(right, keys, include)
    if group is None:
        left = _unique_left(left, keys)
    joined = left.join(one, _same(left, one, keys), "inner")
    labels = [n for n in label_names(left) if n not in include]
    return joined.select(
        *[left[n] for n in labels],
        *[F.col(f"__inc_{n}").alias(n) for n in include],
        *([left["ts"]] if "ts" in left.columns else [F.col("__on_ts").alias("ts")] if "__on_ts" in one.columns else []),
        left["value"],
        F.col("__value").alias("other"),
    )


def _unique_left(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A one-to-one match keeps only the matched labels."""
    one = _one_side(left, keys, ())
    return one.select(
        *[F.col(f"__on_{n}").alias(n) for n in keys],
        *([F.col("__on_ts").alias("ts")] if "ts" in left.columns else []),
        F.col("__value").alias("value"),
    )


def varith(
    left: DataFrame,
    operator: str,
    right: DataFrame | float,
    on: Sequence[str] | None = None,
    group: str | None = None,
    include: Sequence[str] = (),
) -> DataFrame:
    """``left operator right`` for a vector or number on the right."""
    compute = ARITHMETIC[operator]
    if not isinstance(right, DataFrame):
        return left.withColumn("value", compute(F.col("value"), F.lit(float(right))))
    paired = vmatch(left, right, on, group, include)
    return paired.withColumn("value", compute(F.col("value"), F.col("other"))).drop("other")


def vcompare(
    left: DataFrame,
    operator: str,
    right: DataFrame | float,
    on: Sequence[str] | None = None,
    group: str | None = None,
    include: Sequence[str] = (),
) -> DataFrame:
    """Keep the left rows for which the comparison holds, with their value."""
    holds = COMPARISONS[operator]
    if not isinstance(right, DataFrame):
        return left.filter(holds(F.col("value"), F.lit(float(right))))
    paired = vmatch(left, right, on, group, include)
    return paired.filter(holds(F.col("value"), F.col("other"))).drop("other")


def _key_table(df: DataFrame, on: Sequence[str]) -> DataFrame:
    keys = [label(df, name).alias(f"__on_{name}") for name in on]
    if "ts" in df.columns:
        keys.append(df["ts"].alias("__on_ts"))
    return df.select(*keys)


def vand(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Left rows with a partner on the right."""
    keys = _keys(left, right, on)
    table = _key_table(right, keys)
    return left.join(table, _same(left, table, keys), "left_semi")


def vunless(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Left rows without a partner on the right."""
    keys = _keys(left, right, on)
    table = _key_table(right, keys)
    return left.join(table, _same(left, table, keys), "left_anti")


def vor(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Left rows and those right rows that have no partner on the left."""
    return left.unionByName(vunless(right, left, on), allowMissingColumns=True)


def largest(value: Column) -> Column:
    """Maximum that is NaN only where all values are; Spark takes NaN for the largest number."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": largest,
    "min": F.min,
    "avg": F.avg,
    "count": lambda value: F.count(value).cast("double"),
    "group": lambda value: F.any_value(F.lit(1.0)),
}


def vagg(
    df: DataFrame,
    function: str,
    by: Sequence[str] | None = None,
    without: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregate over the series that agree in the ``by`` labels, or in all labels but ``without``."""
    if without is not None:
        by = [name for name in label_names(df) if name not in without]
    times = ["ts"] if "ts" in df.columns else []
    keys = [label(df, name).alias(name) for name in by or ()]
    return df.groupBy(*keys, *times).agg(AGGREGATES[function](F.col("value")).alias("value"))


def label_replace(
    df: DataFrame, target: str, replacement: str, source: str, regex: str
) -> DataFrame:
    """Set a label from another one where the pattern matches its whole text."""
    pattern = anchored(regex)
    found = label(df, source)
    current = label(df, target)
    return df.withColumn(
        target, F.when(matches(found, pattern), expand(replacement, found, pattern)).otherwise(current)
    )


def label_values(
    df: DataFrame, name: str, matchers: Sequence[tuple[str, str, str]] = ()
) -> DataFrame:
    """Distinct non-empty values of a label."""
    chosen = select_series(df, matchers)
    return chosen.select(label(chosen, name).alias(name)).filter(F.col(name) != "").distinct()


def clamp_max(df: DataFrame, limit: float) -> DataFrame:
    return df.withColumn(
        "value",
        F.when(F.isnan("value"), F.col("value")).otherwise(F.least(F.col("value"), F.lit(float(limit)))),
    )


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in labels.items()})
