"""Queries over time series and service levels.

Series evaluated every minute over a month have many points, so most queries report per day: how
many evaluations had a value, their sum, their maximum, and their sum weighted with the time of day,
which tells values at wrong times.  Every evaluation is in the report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow import fixtures as fx
from sloflow.functions import strmap
from sloflow.operators import series as ts
from sloflow.operators import vector as v
from sloflow.operators.series import DAY, HOUR, MINUTE, RANGES, Grid
from sloflow.plans import alerts, slo
from sloflow.sources import definitions

SERIES = fx.SLO_SERIES
LABELS = slo.SLO


def daily(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Report per key and day over all evaluations."""
    number = F.col(value)
    infinite = number.isin(float("inf"), float("-inf"))
    finite = F.when(~infinite & ~F.isnan(number), number)
    return df.groupBy(*keys, F.unix_date(F.to_date("ts")).cast("bigint").alias("day")).agg(
        F.count("*").alias("points"),
        F.count_if(infinite).alias("infinite"),
        F.count_if(F.isnan(number)).alias("undefined"),
        F.round(F.sum(finite), 4).alias("total"),
        F.round(F.max(finite), 6).alias("peak"),
        F.round(F.sum(finite * F.floor(F.pmod(F.unix_seconds("ts"), F.lit(DAY)) / MINUTE)), 3).alias("moment"),
    )


def _seconds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.unix_seconds("ts").alias("sec"), F.round("value", 6).alias("value"))


# ------------------------------------------------------------------------ counter ingestion


def _increase_events(events: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return events.select(
        strmap.lookup(m, "type").alias("type"),
        strmap.lookup(m, "result").alias("result"),
        F.unix_seconds("event_time").alias("sec"),
        "quantity",
    )


def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    return _increase_events(ts.counter_events(fx.samples_map(spark, sf), 300, staleness=7 * DAY))


def counter_stale(spark: SparkSession, sf: str) -> DataFrame:
    return _increase_events(ts.counter_events(fx.samples_map(spark, sf), 600, staleness=30 * MINUTE))


def histogram_increase(spark: SparkSession, sf: str) -> DataFrame:
    events = ts.histogram_events(fx.samples_hist(spark, sf, 300), 900, staleness=DAY)
    m = F.col("metadata")
    return events.select(
        strmap.lookup(m, "type").alias("type"),
        strmap.lookup(m, ts.BUCKET_MIN).alias("low"),
        strmap.lookup(m, ts.BUCKET_MAX).alias("high"),
        F.unix_seconds("event_time").alias("sec"),
        "quantity",
    )


# -------------------------------------------------------------------------- range functions


def _increase(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        samples = fx.samples_counter(spark, sf)
        by = ["slo_domain", "result"]
        return daily(ts.increase(samples, SERIES, RANGES[name], Grid.over(samples), by), by)

    return query


def increase_extrapolated(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.samples_counter(spark, sf)
    by = ["slo_domain", "result"]
    grid = Grid.over(samples, 10 * MINUTE)
    return daily(ts.increase(samples, SERIES, 6 * HOUR, grid, by, extrapolate=True), by)


LARGE = 2.0**50


def increase_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    """Growth that is NaN, infinite or very large in some minutes, and must leave the later ranges alone."""
    number = F.col("event_id") % 997
    odd = F.when(number == 0, float("inf")).when(number == 1, float("nan")).when(number == 2, float("-inf")).when(number == 3, 2.0**60)
    rows = fx.slo_increments(spark, sf).withColumn("quantity", odd.otherwise(F.col("quantity") + 0.25))
    cells = ts.event_cells(rows, ["slo_domain"])
    found = ts.rolling_increase(cells, ["slo_domain"], {r: RANGES[r] for r in ("5m", "1h", "1d", "4w")}, Grid.over(cells))
    keys = ["slo_domain", "slo_time_range"]
    large = found.filter((F.col("value") >= LARGE) & (F.col("value") < float("inf")))
    rest = found.filter(~((F.col("value") >= LARGE) & (F.col("value") < float("inf"))))
    return daily(rest.withColumn("kind", F.lit("plain")), [*keys, "kind"]).unionByName(
        daily(large.select(*keys, "ts", F.lit(1.0).alias("value"), F.lit("large").alias("kind")), [*keys, "kind"])
    )


def rate_1m(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.samples_counter(spark, sf)
    return daily(ts.rate(samples, SERIES, MINUTE, Grid.over(samples), ["slo_domain"]), ["slo_domain"])


STEP = 10 * MINUTE


def _over_time(function: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        samples = fx.gauge(spark, sf)
        grid = Grid.over(samples, STEP)
        return _seconds(ts.over_time(samples, ["event_type"], function, HOUR, grid), ["event_type"])

    return query


def _over_month(function: str):
    """A range of four weeks every minute, over the measurements in hundredths."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        samples = fx.gauge(spark, sf).withColumn("value", F.round(F.col("value") * 100))
        return daily(ts.over_time(samples, ["event_type"], function, RANGES["4w"], Grid.over(samples)), ["event_type"])

    return query


def last_ot(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.gauge(spark, sf)
    found = ts.last_over_time(samples, ["event_type"], 30 * MINUTE, Grid.over(samples, STEP))
    return _seconds(found, ["event_type"])


def offset_r(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.gauge(spark, sf)
    grid = Grid.over(samples, STEP)
    sums = ts.over_time(samples, ["event_type"], "sum", HOUR, grid)
    return _seconds(ts.shift(sums, DAY), ["event_type"])


def absent_r(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.gauge(spark, sf).filter("event_type = 'view'")
    grid = Grid.over(samples, STEP)
    return _seconds(ts.absent(ts.asof(samples, ["event_type"], grid, STEP, closed=False), grid), [])


def held_for(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.gauge(spark, sf)
    grid = Grid.over(samples, STEP)
    busy = v.vcompare(ts.avg_over_time(samples, ["event_type"], HOUR, grid), ">", 50.0)
    return _seconds(ts.held_for(busy, ["event_type"], HOUR, STEP), ["event_type"])


# --------------------------------------------------------------------------- vector algebra


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last hour per domain, class and result, evaluated every hour."""
    by = ["slo_domain", "slo_class", "result"]
    cells = ts.event_cells(fx.slo_increments(spark, sf), by, HOUR)
    grid = Grid.over(cells, HOUR)
    return ts.rolling_increase(cells, by, {"1h": HOUR}, grid).drop("slo_time_range")


HOURLY = ["slo_domain", "slo_class", "result"]


def v_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    failed = rows.filter("result = 'fail'").drop("result")
    total = v.vagg(rows, "sum", by=["slo_domain", "slo_class"])
    return _seconds(v.varith(failed, "/", total), ["slo_domain", "slo_class"])


def v_group_left(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    totals = v.label_replace(v.vagg(rows, "sum", by=["slo_domain"]), "kind", "k-$1", "slo_domain", "(.).*")
    return _seconds(
        v.varith(rows, "/", totals, on=["slo_domain"], group="left", include=["kind"]), [*HOURLY, "kind"]
    )


def v_group_right(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    totals = v.vagg(rows, "max", by=["slo_domain"])
    return _seconds(v.varith(totals, "-", rows, on=["slo_domain"], group="right"), HOURLY)


def v_and(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    failing = v.vcompare(rows.filter("result = 'fail'"), ">", 3.0)
    return _seconds(v.vand(rows, failing, on=["slo_domain", "slo_class"]), HOURLY)


def v_unless(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    failing = rows.filter("result = 'fail'")
    return _seconds(v.vunless(rows, failing, on=["slo_domain"]), HOURLY)


def v_or(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    failing = rows.filter("result = 'fail'")
    zero = v.varith(v.vagg(rows, "count", by=["slo_domain", "slo_class"]), "*", 0.0)
    joined = v.vor(failing, zero, on=["slo_domain", "slo_class"])
    return _seconds(joined.fillna("", ["result"]), HOURLY)


def v_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    means = v.vagg(rows, "avg", by=["slo_domain"])
    return _seconds(v.vcompare(rows, ">=", means, on=["slo_domain"], group="left"), HOURLY)


def v_without(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(v.vagg(hourly(spark, sf), "sum", without=["result"]), ["slo_class", "slo_domain"])


def v_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf)
    frames = [
        v.vagg(rows, name, by=["slo_domain"]).withColumn("function", F.lit(name))
        for name in ("sum", "max", "min", "count", "group")
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return _seconds(union, ["function", "slo_domain"])


def label_replace(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.label_replace(hourly(spark, sf), "short", "${1}-$2", "slo_domain", "(cl|si)(.*)")
    return _seconds(v.clamp_max(rows, 5.0), [*HOURLY, "short"])


def label_values(spark: SparkSession, sf: str) -> DataFrame:
    return v.label_values(fx.samples_map(spark, sf), "type", [("result", "=", "fail")])


# ----------------------------------------------------------------------------- SLO analytics


def _definitions(spark: SparkSession):
    domains = definitions.parse_slo_definitions(fx.DEFINITIONS)
    return (
        definitions.stable_version_df(spark, domains),
        definitions.ratio_threshold_df(spark, domains).drop("le", "percentile"),
        definitions.burn_threshold_df(spark, domains),
    )


def cells(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid]:
    samples = fx.samples_counter(spark, sf)
    return ts.delta_cells(samples, SERIES, SERIES), Grid.over(samples)


def _events(spark: SparkSession, sf: str, ranges: Sequence[str] = tuple(RANGES)) -> DataFrame:
    found, grid = cells(spark, sf)
    return slo.events_over_time(found, grid, ranges)


def events_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return daily(_events(spark, sf), [*SERIES, "slo_time_range"])


def eot_sparse_4w(spark: SparkSession, sf: str) -> DataFrame:
    found, grid = cells(spark, sf)
    return daily(slo.sparse_events(found, grid), [*SERIES, "slo_time_range"])


def violation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return daily(slo.ratio_over_time(*cells(spark, sf)), [*LABELS, "slo_time_range"])


def burn_rate(spark: SparkSession, sf: str) -> DataFrame:
    _, thresholds, _ = _definitions(spark)
    burn = slo.burn_rate(slo.ratio_over_time(*cells(spark, sf)), thresholds)
    return daily(burn, [*LABELS, "slo_time_range"])


def rate_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    return daily(slo.coefficients(*cells(spark, sf)), [*LABELS, "slo_time_range"])


def _budget(spark: SparkSession, sf: str) -> DataFrame:
    stable, thresholds, _ = _definitions(spark)
    return slo.error_budget(slo.ratio_over_time(*cells(spark, sf), ("4w",)), stable, thresholds)


def error_budget(spark: SparkSession, sf: str) -> DataFrame:
    return daily(_budget(spark, sf), LABELS)


def effective_burn(spark: SparkSession, sf: str) -> DataFrame:
    _, thresholds, _ = _definitions(spark)
    found, grid = cells(spark, sf)
    return daily(slo.effective_burn(found, thresholds, grid), [*LABELS, "slo_time_range"])


def uptime_sli(spark: SparkSession, sf: str) -> DataFrame:
    up = fx.samples_up(spark, sf)
    constants = spark.createDataFrame(
        [("production", d, "uptime", 0.9) for d in ("app-click", "app-view", "app-idle")],
        "namespace string, slo_domain string, slo_class string, value double",
    )
    found = slo.uptime_events(up, constants, Grid.over(up), "app-.+")
    return daily(found, ["namespace", "slo_domain", "slo_class", "slo_version", "result", "slo_time_range"])


def query_sli(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.health_samples(spark, sf).withColumn("app_label", F.concat(F.lit("app-"), F.col("instance")))
    queries = samples.filter("metric = 'file_size_bytes'")
    fails = samples.filter("metric = 'file_offset_bytes'")
    found = slo.query_events(
        queries, fails, Grid.over(queries), ["instance", "app_label", "namespace"], "app-.+"
    )
    return daily(found, ["namespace", "slo_domain", "slo_class", "slo_type", "result", "slo_time_range"])


# ---------------------------------------------------------------------------------- alerts


def _fired(spark: SparkSession, sf: str, names: Sequence[str], severity: DataFrame | None = None) -> DataFrame:
    stable, thresholds, burn = _definitions(spark)
    chosen = [alert for alert in alerts.BURN_ALERTS if alert.name in names]
    wide = slo.wide_events(*cells(spark, sf), alerts.alert_ranges(chosen))
    return alerts.burn_alerts(wide, stable, thresholds, burn, chosen, severity)


def severity_info(spark: SparkSession, sf: str) -> DataFrame:
    """Working hours: critical from 8 to 16 o'clock, else warning."""
    _, grid = cells(spark, sf)
    hour = F.hour("ts")
    level = F.when((hour >= 8) & (hour < 16), "critical").otherwise("warning")
    return grid.with_step(3 * MINUTE).df(spark).select(
        level.alias("severity"), "ts", F.lit(1.0).alias("value")
    )


ALERT_KEYS = [*LABELS, "slo_time_range", "severity", "team", "escalate"]


def _alert(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        severity = severity_info(spark, sf) if name == "alert_6h_low" else None
        return daily(_fired(spark, sf, [name], severity), ALERT_KEYS)

    return query


def alert_budget(spark: SparkSession, sf: str) -> DataFrame:
    stable, _, _ = _definitions(spark)
    return daily(alerts.budget_exhausted(_budget(spark, sf), stable), [*LABELS, "team", "escalate"])


def alert_missing_burn(spark: SparkSession, sf: str) -> DataFrame:
    stable, thresholds, _ = _definitions(spark)
    found, grid = cells(spark, sf)
    events = slo.events_over_time(found, grid, ("5m",))
    burn = slo.burn_rate(slo.violation_ratio(events), thresholds)
    missing = alerts.missing_burn_rate(burn, events, stable, grid)
    return daily(missing, ["slo_domain", "slo_version", "namespace", "team", "escalate"])


def alert_missing_all(spark: SparkSession, sf: str) -> DataFrame:
    stable, _, _ = _definitions(spark)
    samples = fx.samples_with_gaps(spark, sf)
    grid = Grid.over(samples)
    events = slo.events_over_time(ts.delta_cells(samples, SERIES, SERIES), grid, ("5m",))
    failures = fx.health_samples(spark, sf).filter("metric = 'file_size_bytes'")
    missing = alerts.missing_all_data(events, stable, failures, ["instance"], grid)
    return daily(missing, [])


def alert_expired_correction(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.corrections(spark, sf)
    expired = alerts.expired_correction(samples, ["incident"], Grid.over(samples))
    return daily(expired, ["incident"])


def alert_health(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.health_samples(spark, sf)
    grid = Grid.over(samples)
    fired = alerts.health_checks(samples, grid)
    severity = F.create_map(*[F.lit(part) for pair in alerts.HEALTH_SEVERITY.items() for part in pair])
    rows = fired.select("check", severity[F.col("check")].alias("severity"), v.label(fired, "instance").alias("instance"), "ts", "value")
    return daily(rows, ["check", "severity", "instance"])


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    names = [alert.name for alert in alerts.BURN_ALERTS]
    rows = alerts.burn_alert_rows(_fired(spark, sf, names, severity_info(spark, sf)))
    return rows.groupBy(strmap.text(F.col("labels")).alias("labels"), "title", "description").agg(
        F.count("*").alias("points")
    )


def budget_alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    stable, _, _ = _definitions(spark)
    rows = alerts.budget_alert_rows(alerts.budget_exhausted(_budget(spark, sf), stable))
    return rows.groupBy(strmap.text(F.col("labels")).alias("labels"), "title", "description").agg(
        F.count("*").alias("points")
    )


# ------------------------------------------------------------------------ dashboard queries


def _ratio(spark: SparkSession, sf: str, time_range: str) -> tuple[DataFrame, Grid]:
    found, grid = cells(spark, sf)
    return slo.ratio_over_time(found, grid, (time_range,)), grid


def sli_percent(spark: SparkSession, sf: str) -> DataFrame:
    ratio, grid = _ratio(spark, sf, "1h")
    return daily(slo.sli_percentage(ratio, grid), LABELS)


def budget_remaining(spark: SparkSession, sf: str) -> DataFrame:
    ratio, grid = _ratio(spark, sf, "1d")
    _, thresholds, _ = _definitions(spark)
    return daily(slo.budget_per_class(ratio, thresholds, grid.with_step(3 * MINUTE)), LABELS)


def worst_budget(spark: SparkSession, sf: str) -> DataFrame:
    stable, thresholds, _ = _definitions(spark)
    ratio = slo.ratio_over_time(*cells(spark, sf), ("4w",))
    return daily(slo.worst_budget(ratio, stable, thresholds), ["slo_domain"])


def budget_delta(spark: SparkSession, sf: str) -> DataFrame:
    _, grid = cells(spark, sf)
    return daily(slo.budget_change(_budget(spark, sf), DAY, grid.with_step(3 * MINUTE)), LABELS)


def totals_range(spark: SparkSession, sf: str) -> DataFrame:
    found, grid = cells(spark, sf)
    return daily(slo.totals_in_range(found, 6 * HOUR, grid, offset=HOUR), SERIES)


def team_of(spark: SparkSession, sf: str) -> DataFrame:
    """Responsible team and escalation of each domain, beside its number of requests."""
    stable, _, _ = _definitions(spark)
    owners = v.vagg(stable, "max", by=["slo_domain", "team", "escalate"])
    requests = v.label_replace(
        fx.slo_increments(spark, sf).groupBy("slo_domain").agg(F.sum("quantity").alias("value")),
        "slo_domain", "$1", "slo_domain", "(.*)",
    )
    return v.vmatch(requests, owners, ["slo_domain"], "left", ["team", "escalate"]).drop("other")


def _key_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid]:
    rows = fx.slo_increments(spark, sf, {"event_key": "http_path", "slo_app": "http_method"})
    found = ts.event_cells(rows, [*SERIES, "slo_app", "event_key"])
    return found, Grid.over(found)


def top_failing_apps(spark: SparkSession, sf: str) -> DataFrame:
    found, grid = _key_cells(spark, sf)
    return slo.failures_by(found, ["slo_app"], 7 * DAY, grid)


def top_failing_keys(spark: SparkSession, sf: str) -> DataFrame:
    found, grid = _key_cells(spark, sf)
    return slo.failures_by(found, ["slo_app", "event_key"], 28 * DAY, grid, limit=25)


def max_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    found = slo.coefficients(*cells(spark, sf))
    return daily(slo.highest_coefficient(found), ["slo_domain", "slo_class"])


QUERIES = {
    "counter_increase": counter_increase,
    "counter_stale": counter_stale,
    "histogram_increase": histogram_increase,
    **{f"increase_{name}": _increase(name) for name in RANGES},
    "increase_extrapolated": increase_extrapolated,
    "increase_nonfinite": increase_nonfinite,
    "rate_1m": rate_1m,
    "last_ot": last_ot,
    "count_ot": _over_time("count"),
    "sum_ot": _over_time("sum"),
    "avg_ot": _over_time("avg"),
    "min_ot": _over_time("min"),
    "max_ot": _over_time("max"),
    "delta_r": _over_time("delta"),
    **{f"{function}_4w": _over_month(function) for function in ("avg", "min", "max", "delta")},
    "offset_r": offset_r,
    "absent_r": absent_r,
    "held_for": held_for,
    "v_one_to_one": v_one_to_one,
    "v_group_left": v_group_left,
    "v_group_right": v_group_right,
    "v_and": v_and,
    "v_unless": v_unless,
    "v_or": v_or,
    "v_compare": v_compare,
    "v_without": v_without,
    "v_aggregates": v_aggregates,
    "label_replace": label_replace,
    "label_values": label_values,
    "events_over_time": events_over_time,
    "eot_sparse_4w": eot_sparse_4w,
    "violation_ratio": violation_ratio,
    "burn_rate": burn_rate,
    "rate_coefficient": rate_coefficient,
    "error_budget": error_budget,
    "effective_burn": effective_burn,
    "uptime_sli": uptime_sli,
    "query_sli": query_sli,
    **{alert.name: _alert(alert.name) for alert in alerts.BURN_ALERTS},
    "alert_budget": alert_budget,
    "alert_missing_burn": alert_missing_burn,
    "alert_missing_all": alert_missing_all,
    "alert_expired_correction": alert_expired_correction,
    "alert_health": alert_health,
    "alert_rows": alert_rows,
    "budget_alert_rows": budget_alert_rows,
    "sli_percent": sli_percent,
    "budget_remaining": budget_remaining,
    "worst_budget": worst_budget,
    "budget_delta": budget_delta,
    "totals_range": totals_range,
    "team_of": team_of,
    "top_failing_apps": top_failing_apps,
    "top_failing_keys": top_failing_keys,
    "max_coefficient": max_coefficient,
}
