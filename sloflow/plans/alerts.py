"""Alert conditions over SLO series, their hold times, labels and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.regex import anchored, matches
from sloflow.functions.once import exploded
from sloflow.functions.text import number_text
from sloflow.operators import groups
from sloflow.operators import series as ts
from sloflow.operators import vector as v
from sloflow.operators.series import HOUR, MINUTE, RANGES, Grid
from sloflow.plans import slo
from sloflow.plans.slo import SLO

VERSION = ("slo_domain", "slo_version", "namespace")


@dataclass(frozen=True)
class BurnAlert:
    """Burn rate above the threshold over a long and a short range.

    ``fails`` compares the failed events of the long range with a number.  ``severity`` None means
    that it comes from a separate information series.
    """

    name: str
    long: str
    short: str
    severity: str | None
    fails: tuple[str, float] | None = None
    period: str = ""


# The alerts, their ranges, traffic limits and severities.
BURN_ALERTS = (
    BurnAlert("alert_1h_low", "1h", "5m", "warning", ("<=", 5), "last hour, low traffic"),
    BurnAlert("alert_1h", "1h", "5m", "critical", (">", 5), "last hour"),
    BurnAlert("alert_6h_low", "6h", "30m", None, ("<=", 10), "6 hours, low traffic"),
    BurnAlert("alert_6h", "6h", "30m", "critical", (">", 10), "6 hours"),
    BurnAlert("alert_1d", "1d", "2h", "warning", None, "24 hours"),
    BurnAlert("alert_3d", "3d", "6h", "warning", None, "3 days"),
)


def alert_ranges(alerts: Sequence[BurnAlert] = BURN_ALERTS) -> list[str]:
    """The ranges that the alerts need from :func:`~sloflow.plans.slo.wide_events`."""
    needed = {slo.SPARSE} | {r for a in alerts for r in (a.long, a.short)}
    return [r for r in RANGES if r in needed]


def burn_alerts(
    wide: DataFrame,
    stable: DataFrame,
    ratio_thresholds: DataFrame,
    burn_thresholds: DataFrame,
    alerts: Sequence[BurnAlert] = BURN_ALERTS,
    severity_info: DataFrame | None = None,
) -> DataFrame:
    """Multi-window burn-rate alerts: one row per alert, SLO and time at which it fires.

    ``wide`` comes from :func:`~sloflow.plans.slo.wide_events`; it is evaluated where every range has
    a fresh value, every 3 minutes.  The value is the effective burn rate of the long range.  The long range's coefficient and
    threshold apply to the short range as well.  All conditions are columns over one wide row per
    SLO and time, so the ranges are not joined with each other; only the small definition tables
    are joined, which must have one row per SLO.
    """
    enabled = v.select_series(stable, [("enabled", "!=", "false")])
    versions = v.vagg(enabled, "max", by=[*VERSION, "team", "escalate"])
    limits = burn_thresholds.groupBy(*SLO).agg(
        *[_only(a).alias(f"limit_{a}") for a in sorted({alert.long for alert in alerts})]
    )
    one = slo.constants_by(versions, VERSION, ["team", "escalate", "value"])
    bounds = slo.constants_by(limits, SLO, [c for c in limits.columns if c.startswith("limit_")])
    fresh = wide.filter(F.pmod(F.unix_seconds("ts"), F.lit(slo.SPARSE_STEP)) == 0)
    known = slo.lookup(slo.lookup(fresh, one, VERSION), bounds, SLO)

    longs = sorted({a.long for a in alerts})
    shorts = sorted({a.short for a in alerts})
    known = slo.with_weights(slo.with_burn(known, ratio_thresholds, sorted({*longs, *shorts})), longs)
    effective = {}
    for alert in alerts:
        weight = F.col(f"weight_{alert.long}")
        for part, r in (("long", alert.long), ("short", alert.short)):
            effective[f"__{part}_{alert.name}"] = F.col(f"burn_{r}") * weight * F.col("stable_value")
    known = known.withColumns(effective)
    above = v.COMPARISONS[">"]
    rows = []
    for alert in alerts:
        limit = F.col(f"limit_{alert.long}")
        burn = F.col(f"__long_{alert.name}")
        fires = above(burn, limit) & above(F.col(f"__short_{alert.name}"), limit)
        if alert.fails:
            operator, count = alert.fails
            fires = fires & v.COMPARISONS[operator](F.col(f"fail_{alert.long}"), F.lit(float(count)))
        rows.append(
            F.when(
                fires,
                F.struct(
                    F.lit(alert.name).alias("alert"),
                    F.lit(alert.long).alias("slo_time_range"),
                    F.lit(alert.severity).cast("string").alias("severity"),
                    F.lit(alert.period).alias("period"),
                    burn.alias("value"),
                ),
            )
        )
    fired = exploded(known, "__alert", F.array_compact(F.array(*rows))).select(
        *SLO, "team", "escalate", "ts", "__alert.*"
    )
    return _with_severity(fired, severity_info, [a.name for a in alerts if a.severity is None])


def _only(time_range: str) -> Column:
    """The one threshold of a range; a second one is an error, as in any match."""
    value = F.when(F.col("slo_time_range") == time_range, F.col("value"))
    several = F.raise_error(F.lit(f"several burn-rate thresholds of one SLO over {time_range}")).cast("double")
    return F.when(F.count(value) > 1, several).otherwise(F.max(value))


def _with_severity(
    fired: DataFrame, info: DataFrame | None, names: Sequence[str]
) -> DataFrame:
    """Alerts without a severity of their own get it from the information series, if there is one."""
    own = fired.filter(F.col("severity").isNotNull())
    if info is None:
        return own
    dynamic = fired.filter(F.col("alert").isin(*names)).drop("severity")
    levels = v.vagg(info, "max", by=["severity"])
    return own.unionByName(
        v.varith(dynamic, "*", levels, on=[], group="left", include=["severity"])
    )


def budget_exhausted(budget: DataFrame, stable: DataFrame, hold: int = 10 * MINUTE) -> DataFrame:
    """Error budget at or below zero for ten minutes, in enabled domains."""
    enabled = v.select_series(stable, [("enabled", "!=", "false")])
    versions = v.vagg(enabled, "max", by=[*VERSION, "team", "escalate"])
    owned = v.vmatch(budget, versions, VERSION, "left", ["team", "escalate"]).drop("other")
    spent = v.vcompare(owned, "<=", 0.0)
    return ts.held_for(spent, SLO, hold, slo.SPARSE_STEP)


def missing_burn_rate(
    burn: DataFrame,
    events: DataFrame,
    stable: DataFrame,
    grid: Grid,
    hold: int = 5 * MINUTE,
) -> DataFrame:
    """Enabled domains with events in the last five minutes but without any burn rate."""
    enabled = v.select_series(stable, [("enabled", "=", "true")])
    versions = ts.on_grid(v.vagg(enabled, "sum", by=[*VERSION, "escalate", "team"]), grid)
    recent = burn.filter(F.col("slo_time_range") == "5m")
    present = v.vmatch(recent, v.vagg(enabled, "sum", by=VERSION), VERSION, "left").drop("other")
    without = v.vunless(versions, present, on=VERSION)
    active = v.vcompare(
        v.vagg(
            events.filter(F.col("slo_time_range") == "5m"), "sum", without=["result", "slo_type"]
        ),
        ">",
        0.0,
    )
    return ts.held_for(v.vand(without, active, on=VERSION), VERSION, hold, grid.step)


def missing_all_data(
    events: DataFrame,
    stable: DataFrame,
    failures: DataFrame,
    failure_series: Sequence[str],
    grid: Grid,
    window: int = HOUR,
    hold: int = 10 * MINUTE,
) -> DataFrame:
    """No SLO data of any enabled domain while rule evaluations fail, throughout the last hour."""
    enabled = v.select_series(stable, [("enabled", "!=", "false")])
    versions = v.vagg(enabled, "max", by=VERSION)
    seen = v.varith(events, "*", versions, on=VERSION, group="left")
    growing = v.vcompare(
        ts.increase(failures, failure_series, 5 * MINUTE, grid), ">", 0.0
    )
    # One row per time with what is known of it, in place of vectors matched without labels.
    alive = seen.groupBy("ts").agg(F.sum("value").alias("alive"), F.lit(False).alias("failing"))
    failing = growing.filter(grid.contains(F.col("ts"))).groupBy("ts").agg(F.lit(None).cast("double").alias("alive"), F.lit(True).alias("failing"))
    times = alive.unionByName(failing).groupBy("ts").agg(F.max("alive").alias("alive"), F.bool_or("failing").alias("failing"))
    state = F.when(F.col("alive").isNotNull(), F.when(F.isnan("alive"), F.col("alive")).otherwise(F.least("alive", F.lit(1.0))))
    states = times.select("ts", F.coalesce(state, F.when(F.col("failing"), 0.0)).alias("value")).filter("value IS NOT NULL")
    missing = v.varith(
        v.varith(ts.avg_over_time(states, [], window, grid), "*", -1.0), "+", 1.0
    )
    return ts.held_for(v.vcompare(missing, "==", 1.0), [], hold, grid.step)


def expired_correction(
    corrections: DataFrame, series: Sequence[str], grid: Grid, window: int = 10 * MINUTE, hold: int = 10 * MINUTE
) -> DataFrame:
    """Data corrections that have been inactive for a while."""
    unused = v.vcompare(ts.avg_over_time(corrections, series, window, grid), "==", 0.0)
    return ts.held_for(unused, series, hold, grid.step)


# ----------------------------------------------------------------------------- health checks


@dataclass(frozen=True)
class HealthNames:
    """Names of the series (label ``metric``) the health checks read."""

    up: str = "up"
    ready: str = "ready"
    lines_read: str = "lines_read_total"
    file_size: str = "file_size_bytes"
    file_offset: str = "file_offset_bytes"
    malformed: str = "malformed_lines_total"
    unsupported: str = "unsupported_results_total"
    query_fails: str = "query_fails_total"
    unmatched: str = "events_not_matching_any_rule"
    event_keys: str = "event_keys"
    event_keys_limit: str = "event_keys_limit"
    processed: str = "events_processed_total"
    labels: Sequence[str] = field(default=("namespace", "instance", "result", "status_code"))


def health_checks(
    samples: DataFrame,
    grid: Grid,
    names: HealthNames | None = None,
    instance_pattern: str = ".*",
) -> DataFrame:
    """The pipeline's own checks: one row per check, series and time at which it fires, ``(check, labels, ts, value)``.

    The samples are read once for all checks, which are columns over one row per series and time; a
    second reading finds the ready pods of the targets that are down.
    """
    names = names or HealthNames()
    series = list(names.labels)
    values = groups.rule_group(
        samples,
        series,
        grid,
        {
            "up": groups.Average(names.up, 4 * MINUTE),
            "lines": groups.Increase(names.lines_read, MINUTE),
            "size": groups.Latest(names.file_size),
            "offset": groups.Latest(names.file_offset),
            "malformed": groups.Increase(names.malformed, 10 * MINUTE),
            "unsupported": groups.Increase(names.unsupported, 10 * MINUTE),
            "fails": groups.Increase(names.query_fails, 10 * MINUTE),
            "unmatched": groups.Increase(names.unmatched, MINUTE),
            "keys": groups.Latest(names.event_keys),
            "keys_limit": groups.Latest(names.event_keys_limit),
            "processed": groups.Latest(names.processed),
        },
    )
    lag, rate = F.col("size") - F.col("offset"), F.col("lines") / MINUTE
    above, below, least = v.COMPARISONS[">"], v.COMPARISONS["<"], v.COMPARISONS[">="]
    chosen = matches(v.label(values, "instance"), anchored(instance_pattern))
    behind = above(lag, F.lit(float(1024**2)))
    unclassified = (v.label(values, "result") == "unclassified") & ~matches(v.label(values, "status_code"), anchored("[45].."))
    known = groups.held(
        values,
        series,
        {
            "idle": (v.COMPARISONS["=="](rate, F.lit(0.0)), 10 * MINUTE),
            "behind_short": (behind, 10 * MINUTE),
            "behind_long": (behind, 2 * HOUR),
        },
        grid.step,
    )
    fired = groups.as_rows(
        known,
        series,
        "check",
        {
            "target_down": (chosen & below(F.col("up"), F.lit(0.9)), F.col("up")),
            "no_new_lines": (F.col("idle"), rate),
            "behind_short": (F.col("behind_short"), lag),
            "behind_long": (F.col("behind_long"), lag),
            "malformed_lines": (above(F.col("malformed"), F.lit(100.0)), F.col("malformed")),
            "unsupported_results": (above(F.col("unsupported"), F.lit(10.0)), F.col("unsupported")),
            "query_fails": (above(F.col("fails"), F.lit(10.0)), F.col("fails")),
            "unmatched_events": (above(F.col("unmatched"), F.lit(0.0)), F.col("unmatched")),
            "event_key_limit": (least(F.col("keys"), F.col("keys_limit")), F.col("keys")),
            "unclassified_events": (unclassified & F.col("processed").isNotNull(), F.col("processed")),
        },
    )
    return _settled(fired, samples, series, names, grid)


def _settled(fired: DataFrame, samples: DataFrame, series: Sequence[str], names: HealthNames, grid: Grid) -> DataFrame:
    """The checks that look at more than one series: a target is down if its pod is ready throughout ten minutes, and
    unclassified events are summed up by namespace.  The others pass unchanged."""
    down, summed = "target_down", "unclassified_events"
    ready = samples.filter(F.col("metric") == names.ready)
    pods = v.vcompare(ts.asof(ready, [*series, "pod"], grid), "==", 1.0)
    pods = pods.select(
        F.lit(down).alias("__check"), v.label(pods, "namespace").alias("__namespace"), v.label(pods, "pod").alias("__pod"), F.col("ts").alias("__ts")
    ).distinct()
    same = (
        (fired["check"] == F.col("__check")) & (v.label(fired, "namespace") == F.col("__namespace"))
        & (v.label(fired, "instance") == F.col("__pod")) & (fired["ts"] == F.col("__ts"))
    )
    seen = fired.join(pods, same, "left").filter((fired["check"] != down) | F.col("__pod").isNotNull())
    own = Window.partitionBy("check", *series)
    second = F.unix_seconds("ts")
    island = second - F.row_number().over(own.orderBy("ts")) * grid.step
    since = F.min(second).over(Window.partitionBy("check", *series, "__island"))
    kept = seen.withColumn("__island", island).withColumn("__since", since).filter((F.col("check") != down) | (second - F.col("__since") >= 10 * MINUTE))
    labels = [F.when((F.col("check") != summed) | F.lit(n == "namespace"), F.col(n)).alias(n) for n in series]
    return kept.groupBy("check", *labels, "ts").agg(F.sum("value").alias("value"))


# Severities of the health checks.
HEALTH_SEVERITY = {
    "target_down": "critical",
    "no_new_lines": "warning",
    "behind_short": "warning",
    "behind_long": "critical",
    "malformed_lines": "warning",
    "unsupported_results": "critical",
    "query_fails": "critical",
    "unmatched_events": "warning",
    "event_key_limit": "warning",
    "unclassified_events": "warning",
}


def one_decimal(value: Column) -> Column:
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), number_text(value)).otherwise(
        F.format_string("%.1f", value)
    )


def alert_rows(
    fired: DataFrame,
    alert_type: str,
    title: Column,
    description: Column,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Alerts as ``(ts, labels, title, description, value)``, with static labels added."""
    own = strmap.from_columns(
        {n: F.when(F.col(n) != "", F.col(n)) for n in v.label_names(fired) if n != "period"}
    )
    static = strmap.literal({"alert_type": alert_type, **(labels or {})})
    return fired.select(
        "ts",
        strmap.merge(own, static).alias("labels"),
        title.alias("title"),
        description.alias("description"),
        "value",
    )


def burn_alert_rows(fired: DataFrame) -> DataFrame:
    title = F.concat(
        "slo_domain", F.lit(": "), "slo_type", F.lit(" budget burns too fast over "), "period",
    )
    description = F.concat(
        F.lit("Burn rate "), one_decimal(F.col("value")), F.lit(" over "), "period", F.lit(" for "),
        "slo_type", F.lit(" of class "), "slo_class", F.lit(" in "), "slo_domain",
    )
    return alert_rows(fired, "slo:high_burnrate", title, description)


def budget_alert_rows(fired: DataFrame) -> DataFrame:
    description = F.concat(
        F.lit("No "), F.col("slo_type"), F.lit(" budget is left in "), F.col("slo_domain"),
    )
    return alert_rows(
        fired, "slo:error_budget_exhausted", F.lit("Budget spent"), description,
        {"severity": "warning"},
    )
