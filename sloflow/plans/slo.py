"""Service level objectives over time: events, violation ratio, burn rate, error budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions.once import exploded
from sloflow.operators import groups
from sloflow.operators import series as ts
from sloflow.operators import vector as v
from sloflow.operators.series import MINUTE, RANGES, Grid

SLO = ("namespace", "slo_class", "slo_domain", "slo_type", "slo_version")
BY_RESULT = (*SLO, "result")
# How often each range is evaluated.
STEPS = {
    "5m": MINUTE,
    "30m": MINUTE,
    "1h": MINUTE,
    "2h": 3 * MINUTE,
    "6h": 3 * MINUTE,
    "1d": 3 * MINUTE,
    "3d": 3 * MINUTE,
    "4w": 15 * MINUTE,
}
SPARSE = "4w"
SPARSE_FILL = 30 * MINUTE
SPARSE_STEP = 3 * MINUTE
HOLD = {SPARSE: (SPARSE_STEP, SPARSE_FILL)}
# Burn-rate windows, long range to short range.
WINDOWS = {"1h": "5m", "6h": "30m", "1d": "2h", "3d": "6h"}


def events_over_time(
    cells: DataFrame, grid: Grid, ranges: Sequence[str] = tuple(RANGES), by: Sequence[str] = BY_RESULT
) -> DataFrame:
    """Events per SLO, result and range: ``(by, slo_time_range, ts, value)``.

    ``cells`` are one-minute sums (:func:`~sloflow.operators.series.delta_cells` over counters or
    :func:`~sloflow.operators.series.event_cells` over events).  All ranges come from one pass.
    The longest range is computed every 15 minutes and carried on to a 3-minute grid.
    """
    wanted = {name: RANGES[name] for name in ranges}
    hold = {name: HOLD[name] for name in wanted if name in HOLD}
    return ts.rolling_increase(cells, by, wanted, grid, STEPS, hold)


def _sides(cells: DataFrame) -> DataFrame:
    """Growth and samples of all events and of the failed ones side by side."""
    failed = F.col("result") == "fail"
    return cells.groupBy(*SLO, "ts").agg(
        F.sum("delta").alias("total"),
        F.sum("samples").alias("total_samples"),
        F.sum(F.when(failed, F.col("delta")).otherwise(0.0)).alias("fail"),
        F.sum(F.when(failed, F.col("samples")).otherwise(0)).alias("fail_samples"),
    )


_MEASURES = {"total": ("total", "total_samples"), "fail": ("fail", "fail_samples")}


def _wanted(ranges: Sequence[str]) -> tuple[dict[str, int], dict[str, tuple[int, int]]]:
    return {name: RANGES[name] for name in ranges}, {name: HOLD[name] for name in ranges if name in HOLD}


def wide_events(cells: DataFrame, grid: Grid, ranges: Sequence[str] = tuple(RANGES)) -> DataFrame:
    """All ranges of an SLO at one time in one row: ``total_<range>`` and ``fail_<range>``."""
    wanted, hold = _wanted(ranges)
    return ts.rolling_wide(_sides(cells), SLO, _MEASURES, wanted, grid, STEPS, hold)


def ratio_column(time_range: str) -> Column:
    """Violation ratio of one range of :func:`wide_events`; NULL where the range has no value."""
    total, failed = F.col(f"total_{time_range}"), F.col(f"fail_{time_range}")
    return F.when(total == 0, 0.0).when(
        total.isNotNull(), F.coalesce(v.ieee_div(failed, total), F.lit(0.0))
    )


def ratio_over_time(
    cells: DataFrame, grid: Grid, ranges: Sequence[str] = tuple(RANGES)
) -> DataFrame:
    """The violation ratio straight from cells: ``(SLO, slo_time_range, ts, value)``.

    Same rows as :func:`violation_ratio` of :func:`events_over_time`, but both results of an SLO are
    side by side from the start, so the long series are neither built nor aggregated again.
    """
    wanted, hold = _wanted(ranges)
    union = None
    for names, level in ts.rolling_levels(_sides(cells), SLO, _MEASURES, wanted, grid, STEPS, hold):
        rows = F.array(
            *[
                F.when(
                    F.col(f"total_{r}").isNotNull(),
                    F.struct(F.lit(r).alias("slo_time_range"), ratio_column(r).alias("value")),
                )
                for r in names
            ]
        )
        part = exploded(level, "__row", F.array_compact(rows)).select(*SLO, "__row.slo_time_range", "ts", "__row.value")
        union = part if union is None else union.unionByName(part)
    return union


def sparse_events(cells: DataFrame, grid: Grid, by: Sequence[str] = BY_RESULT) -> DataFrame:
    """The longest range at its own times only."""
    return ts.rolling_increase(cells, by, {SPARSE: RANGES[SPARSE]}, grid, STEPS)


def fill_sparse(sparse: DataFrame, grid: Grid, series: Sequence[str]) -> DataFrame:
    """Last value within 30 minutes on a 3-minute grid."""
    return ts.last_over_time(sparse, series, SPARSE_FILL, grid.with_step(SPARSE_STEP))


def violation_ratio(events: DataFrame, by: Sequence[str] = SLO) -> DataFrame:
    """Failed events / all events; 0 where nothing happened or nothing failed."""
    failed = F.sum(F.when(F.col("result") == "fail", F.col("value")))
    total = F.sum("value")
    return (
        events.groupBy(*by, "slo_time_range", "ts")
        .agg(failed.alias("__failed"), total.alias("__total"))
        .withColumn(
            "value",
            F.when(F.col("__total") == 0, 0.0)
            .when(F.col("__failed").isNotNull(), v.ieee_div(F.col("__failed"), F.col("__total")))
            .otherwise(0.0),
        )
        .drop("__failed", "__total")
    )


def burn_rate(ratio: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Violation ratio / allowed ratio, for SLOs with a threshold."""
    allowed = thresholds.withColumn("value", 1 - F.col("value"))
    return v.varith(ratio, "/", allowed, on=SLO, group="left")


def rate_coefficient(events: DataFrame, ranges: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """How the present rate of events compares with the four-week average."""
    totals = v.vagg(events, "sum", without=["result"])
    month = totals.filter(F.col("slo_time_range") == SPARSE)
    scale = F.lit(float(RANGES[SPARSE])) / F.create_map(
        *[F.lit(part) for r in ranges for part in (r, float(RANGES[r]))]
    )[F.col("slo_time_range")]
    scaled = totals.filter(F.col("slo_time_range").isin(*ranges)).withColumn(
        "value", F.col("value") * scale
    )
    return v.varith(scaled, "/", month, on=SLO, group="left")


def remaining_budget(ratio: DataFrame, thresholds: DataFrame) -> DataFrame:
    """1 - ratio / (1 - threshold), computed as ratio / (threshold - 1) + 1."""
    divisor = thresholds.withColumn("value", F.col("value") - 1)
    return v.varith(v.varith(ratio, "/", divisor, on=SLO, group="left"), "+", 1.0)


def error_budget(ratio: DataFrame, stable: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of the four-week error budget that is left, for domains with a stable version."""
    month = ratio.filter(F.col("slo_time_range") == SPARSE)
    versions = v.vagg(stable, "max", by=["slo_domain", "slo_version", "namespace"])
    known = v.varith(
        month, "*", versions, on=["slo_domain", "slo_version", "namespace"], group="left"
    )
    return remaining_budget(known, thresholds)


def effective_burn_rate(burn: DataFrame, coefficient: DataFrame, long_range: str | None = None) -> DataFrame:
    """Burn rate weighted with the rate coefficient of the long range, or each range with its own."""
    if long_range is None:
        return v.varith(burn, "*", coefficient, on=[*SLO, "slo_time_range"])
    weight = coefficient.filter(F.col("slo_time_range") == long_range)
    return v.varith(burn, "*", weight, on=SLO, group="left")


# ----------------------------------------------------------- the same over one wide row per time


def constants_by(df: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A definition table for :func:`lookup`; it must have one row per ``on``."""
    return df.select(
        *[v.label(df, n).alias(f"__c_{n}") for n in on],
        *[F.col(c).alias("stable_value" if c == "value" else c) for c in values],
    )


def lookup(df: DataFrame, constants: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``df`` that have constants, with their columns."""
    condition = F.lit(True)
    for name in on:
        condition = condition & (v.label(df, name) == constants[f"__c_{name}"])
    return df.join(constants, condition, "inner").drop(*[f"__c_{n}" for n in on])


def with_burn(wide: DataFrame, thresholds: DataFrame, ranges: Sequence[str]) -> DataFrame:
    """:func:`wide_events` of the SLOs with a threshold, with the burn rate of each range as ``burn_<range>``."""
    allowed = thresholds.select(*[v.label(thresholds, n).alias(n) for n in SLO], (1 - F.col("value")).alias("__allowed"))
    known = lookup(wide, constants_by(allowed, SLO, ["__allowed"]), SLO)
    # One column per step, so that nothing is computed twice.
    known = known.withColumns({f"__ratio_{r}": ratio_column(r) for r in ranges})
    burn = {f"burn_{r}": v.ieee_div(F.col(f"__ratio_{r}"), F.col("__allowed")) for r in ranges}
    return known.withColumns(burn).drop("__allowed", *[f"__ratio_{r}" for r in ranges])


def with_weights(wide: DataFrame, ranges: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """:func:`wide_events` with the rate coefficient of each range as ``weight_<range>``."""
    month = F.col(f"total_{SPARSE}")
    return wide.withColumns(
        {f"weight_{r}": v.ieee_div(F.col(f"total_{r}") * F.lit(RANGES[SPARSE] / RANGES[r]), month) for r in ranges}
    )


def by_range(wide: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """A vector ``(SLO, slo_time_range, ts, value)`` from columns of wide rows, where they have values."""
    found = groups.as_rows(wide, SLO, "slo_time_range", {r: (value.isNotNull(), value) for r, value in values.items()})
    return found.select(*SLO, "slo_time_range", "ts", "value")


def coefficients(cells: DataFrame, grid: Grid, ranges: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """:func:`rate_coefficient` straight from cells."""
    weighed = with_weights(_fresh(wide_events(cells, grid, (*ranges, SPARSE))), ranges)
    return by_range(weighed, {r: F.col(f"weight_{r}") for r in ranges})


def effective_burn(cells: DataFrame, thresholds: DataFrame, grid: Grid, month_with: str = "6h") -> DataFrame:
    """:func:`effective_burn_rate` of all windows straight from cells, and of the longest range with the coefficient of ``month_with``."""
    wide = _fresh(wide_events(cells, grid, (*WINDOWS, SPARSE)))
    known = with_weights(with_burn(wide, thresholds, (*WINDOWS, SPARSE)))
    values = {r: F.col(f"burn_{r}") * F.col(f"weight_{r}") for r in WINDOWS}
    return by_range(known, values | {SPARSE: F.col(f"burn_{SPARSE}") * F.col(f"weight_{month_with}")})


def _fresh(wide: DataFrame) -> DataFrame:
    """The times at which the longest range has a value."""
    return wide.filter(F.pmod(F.unix_seconds("ts"), F.lit(SPARSE_STEP)) == 0)


# --------------------------------------------------------------------- own service levels

UPTIME_LABELS = {"slo_type": "availability", "slo_version": "6", "slo_class": "uptime"}
QUERY_LABELS = {"slo_type": "availability", "slo_version": "6", "slo_class": "queries"}


def uptime_events(
    up: DataFrame,
    thresholds: DataFrame,
    grid: Grid,
    app_pattern: str,
    ranges: Sequence[str] = tuple(RANGES),
) -> DataFrame:
    """Minutes in which exactly one instance of an app was up, and the other minutes.

    ``up`` has the labels ``app_label`` and ``namespace`` on a one-minute grid; the domain is the
    app's name.  Domains with an uptime threshold but no good minute get 0.
    """
    apps = v.select_series(up, [("app_label", "=~", app_pattern)])
    total = v.vagg(apps, "sum", by=["app_label", "namespace"])
    good = v.vcompare(total, "==", 1.0)
    known = v.select_series(
        thresholds, [("slo_domain", "=~", app_pattern), ("slo_class", "=", "uptime")]
    )
    zero = ts.on_grid(
        v.vagg(known, "group", by=["namespace", "slo_domain"]).withColumn("value", F.lit(0.0)),
        grid.with_step(3 * MINUTE),
    )
    cells = good.select("app_label", "namespace", "ts", F.lit(1.0).alias("delta"), F.lit(1).alias("samples"))
    wanted = {name: RANGES[name] for name in ranges}
    counted = ts.rolling_increase(
        cells, ["app_label", "namespace"], wanted, grid, {name: 3 * MINUTE for name in wanted}
    )
    named = v.label_replace(counted, "slo_domain", "$1", "app_label", f"^({app_pattern})$")
    zeros = zero.withColumn("slo_time_range", F.explode(F.array(*[F.lit(r) for r in ranges])))
    success = v.vor(named, zeros, on=["namespace", "slo_domain", "slo_time_range"])
    minutes = F.create_map(
        *[F.lit(part) for name, s in wanted.items() for part in (name, s / MINUTE)]
    )
    both = F.array(
        F.struct(F.lit("success").alias("result"), F.col("value").alias("value")),
        F.struct(
            F.lit("fail").alias("result"),
            (minutes[F.col("slo_time_range")] - F.col("value")).alias("value"),
        ),
    )
    return v.with_labels(_exploded(success, both, ["namespace", "slo_domain"]), UPTIME_LABELS)


def _exploded(df: DataFrame, rows, labels: Sequence[str]) -> DataFrame:
    return df.withColumn("__row", F.explode(rows)).select(
        *labels, "slo_time_range", "ts", "__row.result", "__row.value"
    )


def query_events(
    queries: DataFrame,
    fails: DataFrame,
    grid: Grid,
    series: Sequence[str],
    app_pattern: str,
    ranges: Sequence[str] = tuple(RANGES),
) -> DataFrame:
    """Successful and failed queries of an app from its counters of all and of failed queries."""
    by = ["app_label", "namespace"]
    wanted = {name: RANGES[name] for name in ranges}
    steps = {name: 3 * MINUTE for name in wanted}

    def chosen(counters: DataFrame, failed: bool) -> DataFrame:
        own = v.select_series(counters, [("app_label", "=~", app_pattern)])
        return own.select(F.lit(failed).alias("__failed"), *dict.fromkeys([*series, *by]), "ts", "value")

    # Both counters side by side: one table of cells, and a column each.
    both = chosen(queries, False).unionByName(chosen(fails, True))
    grown = ts.counter_deltas(both, ["__failed", *series])
    failed = F.col("__failed")
    cells = grown.groupBy(*by, ts.ceil_time(F.col("ts"), grid.step).alias("ts")).agg(
        F.sum(F.when(~failed, F.col("delta"))).alias("all"),
        F.count_if(~failed).alias("all_samples"),
        F.sum(F.when(failed, F.col("delta"))).alias("fail"),
        F.count_if(failed).alias("fail_samples"),
    )
    measures = {"all": ("all", "all_samples"), "fail": ("fail", "fail_samples")}
    union = None
    for names, level in ts.rolling_levels(cells, by, measures, wanted, grid, steps):
        rows = [
            F.when(value.isNotNull(), F.struct(F.lit(r).alias("slo_time_range"), F.lit(result).alias("result"), value.alias("value")))
            for r in names
            for result, value in (("success", F.col(f"all_{r}") - F.col(f"fail_{r}")), ("fail", F.col(f"fail_{r}")))
        ]
        part = exploded(level, "__row", F.array_compact(F.array(*rows))).select(*by, "ts", "__row.*")
        union = part if union is None else union.unionByName(part)
    named = v.label_replace(union, "slo_domain", "$1", "app_label", f"^({app_pattern})$")
    return v.with_labels(named.drop("app_label"), QUERY_LABELS)


# ------------------------------------------------------------------------ dashboard queries


def sli_percentage(ratio: DataFrame, grid: Grid, seconds: int = 5 * MINUTE) -> DataFrame:
    worst = ts.max_over_time(ratio, [*SLO, "slo_time_range"], seconds, grid)
    return worst.withColumn("value", 1 - F.col("value"))


def budget_per_class(
    ratio: DataFrame, thresholds: DataFrame, grid: Grid, seconds: int = 15 * MINUTE
) -> DataFrame:
    """Remaining budget of any range, from its worst ratio of the last minutes."""
    worst = ts.max_over_time(ratio, [*SLO, "slo_time_range"], seconds, grid)
    return remaining_budget(worst, thresholds)


def worst_budget(
    ratio: DataFrame, stable: DataFrame, thresholds: DataFrame, time_range: str = SPARSE
) -> DataFrame:
    """Smallest remaining budget per domain."""
    chosen = ratio.filter(F.col("slo_time_range") == time_range)
    known = v.varith(
        chosen, "*", v.vagg(stable, "max", by=["slo_domain", "slo_version", "namespace"]),
        on=["slo_domain", "slo_version", "namespace"], group="left",
    )
    return v.vagg(remaining_budget(known, thresholds), "min", by=["slo_domain"])


def budget_change(budget: DataFrame, seconds: int, grid: Grid) -> DataFrame:
    return ts.delta(budget.drop("slo_time_range"), SLO, seconds, grid)


def totals_in_range(cells: DataFrame, seconds: int, grid: Grid, offset: int = 0) -> DataFrame:
    """Successful and failed events of each SLO within a range that ends ``offset`` before now."""
    moved = ts.shift(cells, offset) if offset else cells
    return ts.rolling_increase(moved, BY_RESULT, {"r": seconds}, grid).drop("slo_time_range")


def failures_by(
    cells: DataFrame, dims: Sequence[str], seconds: int, grid: Grid, limit: int | None = None
) -> DataFrame:
    """Failed events per SLO and ``dims`` at the end of the grid, most failures first."""
    by = [*SLO, *[d for d in dims if d not in SLO]]
    end = F.timestamp_seconds(F.lit(grid.end))
    window = (F.col("ts") > ts.plus(end, -seconds)) & (F.col("ts") <= end)
    failed = (
        cells.filter(window & (F.col("result") == "fail"))
        .groupBy(*by)
        .agg(F.sum("delta").alias("value"))
        .orderBy(F.desc("value"), *by)
    )
    return failed.limit(limit) if limit else failed


def responsible(stable: DataFrame, name: str, matchers=()) -> DataFrame:
    """Team (``team``) or escalation (``escalate``) of the chosen domains."""
    return v.vagg(v.select_series(stable, matchers), "max", by=[name])


def highest_coefficient(coefficient: DataFrame) -> DataFrame:
    return v.vagg(coefficient, "max", by=["slo_domain", "slo_class"])
