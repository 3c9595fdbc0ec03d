"""Groups of expressions over the same samples, evaluated together.

A rule file asks one store for many metrics, ranges and look-ups at the same times.  Here all of them become
columns of one row per series and time: samples are reduced once to cells of one grid step, running sums and
latest values are taken once along each series, and every expression is a column over them.  Conditions on
several metrics are then ordinary column expressions instead of joins of vectors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloflow.functions.once import exploded
from sloflow.operators import series as ts
from sloflow.operators.series import Grid


@dataclass(frozen=True)
class Increase:
    """Growth of a counter over the last ``seconds``; NULL without a sample in them."""

    metric: str
    seconds: int


@dataclass(frozen=True)
class Average:
    """Mean of the samples of the last ``seconds``."""

    metric: str
    seconds: int


@dataclass(frozen=True)
class Latest:
    """The last sample, if it is not older than ``seconds``."""

    metric: str
    seconds: int = ts.STALENESS


Expression = Increase | Average | Latest


def rule_group(samples: DataFrame, series: Sequence[str], grid: Grid, wanted: Mapping[str, Expression]) -> DataFrame:
    """``wanted`` as columns per series and grid time: ``(series, ts, *wanted)``, and a number of the series for :func:`held`.

    ``samples`` has metric, the ``series`` columns, ts and value.  A series has a row at each time at which one
    of its expressions may have a value; the others are NULL there.
    """
    for expression in wanted.values():
        if not isinstance(expression, Latest) and (expression.seconds <= 0 or expression.seconds % grid.step):
            raise ValueError(f"{expression} does not fit a grid of {grid.step}s")
    by_kind = {kind: sorted({e.metric for e in wanted.values() if isinstance(e, kind)}) for kind in (Increase, Average, Latest)}
    number = {metric: i for i, metric in enumerate(sorted({e.metric for e in wanted.values()}))}
    chosen = samples.filter(F.col("metric").isin(*number)).select("metric", *series, "ts", "value")
    if by_kind[Increase]:
        chosen = ts.counter_deltas(chosen, ["metric", *series])

    def only(metric: str, column: Column) -> Column:
        return F.when(F.col("metric") == metric, column)

    reduced: dict[str, Column] = {}
    for m in by_kind[Increase]:
        reduced[f"__grown{number[m]}"] = F.sum(only(m, F.col("delta")))
        reduced[f"__growths{number[m]}"] = F.count(only(m, F.lit(1)))
    for m in by_kind[Average]:
        reduced[f"__sum{number[m]}"] = F.sum(only(m, F.col("value")))
        reduced[f"__count{number[m]}"] = F.count(only(m, F.col("value")))
    for m in by_kind[Latest]:
        reduced[f"__latest{number[m]}"] = F.max_by(only(m, F.struct("__at", "value")), only(m, F.col("__at")))
    # Grouped by another name: the latest samples keep their own times.
    cells = chosen.withColumnRenamed("ts", "__at").groupBy(*series, ts.ceil_time(F.col("__at"), grid.step).alias("ts")).agg(
        *[column.alias(name) for name, column in reduced.items()]
    )

    spread, keys = ts._spread(cells, series)
    ordered = Window.partitionBy(*keys).orderBy("ts")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"following": F.lead("ts").over(ordered)}
    for m in by_kind[Increase]:
        sums |= ts._running(f"__g{number[m]}", F.col(f"__grown{number[m]}"), running)
        sums[f"__at{number[m]}"] = F.max(F.when(F.col(f"__growths{number[m]}") > 0, F.unix_seconds("ts"))).over(running)
    for m in by_kind[Average]:
        sums |= ts._running(f"__s{number[m]}", F.col(f"__sum{number[m]}"), running)
        sums[f"__n{number[m]}"] = F.sum(f"__count{number[m]}").over(running)
    for m in by_kind[Latest]:
        sums[f"__l{number[m]}"] = F.last(f"__latest{number[m]}", ignorenulls=True).over(running)
    # A look-up includes both ends of its interval, so it may see one step further than a range.
    reach = max(-(-e.seconds // grid.step) * grid.step + grid.step * isinstance(e, Latest) for e in wanted.values())
    totals = spread.withColumns(sums).select(*keys, "ts", *sums)
    dense = ts._fill(totals, grid.step, grid.end, reach)

    looks: dict[str, Column] = {}
    for e in wanted.values():
        rows, at = e.seconds // grid.step, f"{number[e.metric]}_{e.seconds}"
        if isinstance(e, Increase):
            looks |= ts._before(f"__g{number[e.metric]}", f"__gb{at}", rows, ordered)
        elif isinstance(e, Average):
            looks |= ts._before(f"__s{number[e.metric]}", f"__sb{at}", rows, ordered)
            looks[f"__nb{at}"] = F.lag(f"__n{number[e.metric]}", rows, 0).over(ordered)
    second = F.unix_seconds("ts")
    columns = {}
    for name, e in wanted.items():
        i, at = number[e.metric], f"{number[e.metric]}_{e.seconds}"
        if isinstance(e, Increase):
            columns[name] = F.when(F.col(f"__at{i}") > second - e.seconds, ts._difference(f"__g{i}", f"__gb{at}"))
        elif isinstance(e, Average):
            count = F.col(f"__n{i}") - F.col(f"__nb{at}")
            columns[name] = F.when(count > 0, ts._difference(f"__s{i}", f"__sb{at}") / count)
        else:
            latest = F.col(f"__l{i}")
            fresh = F.unix_micros("ts") - F.unix_micros(latest["__at"]) <= ts._micros(e.seconds)
            columns[name] = F.when(fresh, latest["value"])
    found = dense.withColumns(looks).select(*keys, "ts", *[column.alias(name) for name, column in columns.items()])
    return found.filter(second >= grid.start)


def held(group: DataFrame, series: Sequence[str], conditions: Mapping[str, tuple[Column, int]], step: int) -> DataFrame:
    """``group`` with one boolean column per condition: it held at every evaluation for the last seconds.

    ``conditions`` maps the new column to a condition and its seconds.  A time without a row of the series ends a
    condition like one at which it is false.
    """
    ordered = Window.partitionBy(*[n for n in (ts._KEY,) if n in group.columns], *series).orderBy("ts")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    second = F.unix_seconds("ts")
    now = group.withColumns({f"__c_{name}": F.coalesce(condition, F.lit(False)) for name, (condition, _) in conditions.items()})
    before = F.lag(second, 1).over(ordered)
    gap = F.when(before.isNull() | (before < second - step), second - step)
    now = now.withColumn("__gap", gap)
    broken = {f"__b_{name}": F.max(F.when(F.col(f"__c_{name}"), F.col("__gap")).otherwise(second)).over(running) for name in conditions}
    held_ = {name: F.col(f"__c_{name}") & (second - F.col(f"__b_{name}") - step >= seconds) for name, (_, seconds) in conditions.items()}
    return now.withColumns(broken).withColumns(held_).drop("__gap", *[f"__{k}_{name}" for k in "bc" for name in conditions])


def as_rows(group: DataFrame, labels: Sequence[str], name: str, rows: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row per time and entry of ``rows`` whose condition holds: ``(labels, name, ts, value)``.

    ``rows`` maps the text in column ``name`` to a condition and a value.
    """
    parts = F.array(
        *[F.when(condition, F.struct(F.lit(text).alias(name), value.cast("double").alias("value"))) for text, (condition, value) in rows.items()]
    )
    return exploded(group, "__row", F.array_compact(parts)).select(*labels, f"__row.{name}", "ts", "__row.value")
