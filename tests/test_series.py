import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sloflow.operators import series as ts
from sloflow.operators import vector as v
from sloflow.operators.series import Grid
from sloflow.plans import alerts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
T0 = int(START.timestamp())
SAMPLES = "labels map<string,string>, ts timestamp, value double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def samples(spark, rows):
    """Rows of (labels, second, value)."""
    return spark.createDataFrame([(l, at(s), float(x)) for l, s, x in rows], SAMPLES)


def poll_by_poll(points, poll, staleness):
    """One series polled as the clock goes on: (poll second, growth)."""
    previous, out = None, []
    last = max(s for s, _ in points)
    for now in range(poll, last + poll, poll):
        if previous and now - previous[0] > staleness:
            previous = None
        seen = [p for p in points if now - poll < p[0] <= now]
        if not seen:
            continue
        before, total = previous or seen[0], 0.0
        for point in seen:
            total += point[1] if point[1] < before[1] else point[1] - before[1]
            before = point
        previous = seen[-1]
        out.append((now, total))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_counter_increase_against_model(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], set()
    for name in ("a", "b", "c"):
        points, second, value = [], 0, 0
        while second < 3000:
            second += rng.choice([5, 20, 61, 400])
            value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(4)
            points.append((second, value))
        rows += [({"n": name}, s, x) for s, x in points]
        expected |= {(name, T0 + p, g) for p, g in poll_by_poll(points, 60, 150)}
    found = ts.counter_increase(samples(spark, rows), 60, 150).collect()
    assert {(r.labels["n"], int(r.poll_ts.replace(tzinfo=timezone.utc).timestamp()), r.value) for r in found} == expected


def test_earlier_samples(spark):
    first, second = [({"n": "a"}, 10, 5)], [({"n": "a"}, 70, 8)]
    earlier = ts.last_samples(samples(spark, first))
    assert [r.value for r in ts.counter_increase(samples(spark, second), earlier=earlier).collect()] == [3.0]
    assert [r.value for r in ts.counter_increase(samples(spark, second)).collect()] == [0.0]


def histogram(spark, buckets, **labels):
    rows = [({"le": le, **labels}, 30, 0) for le in buckets] + [({"le": le, **labels}, 60, n) for le, n in buckets.items()]
    return samples(spark, rows)


def test_histogram(spark):
    found = ts.histogram_events(histogram(spark, {"1": 2, "3": 8, "6": 8, "+Inf": 10}, foo="bar")).collect()
    got = {(r.metadata[ts.BUCKET_MIN], r.metadata[ts.BUCKET_MAX], r.quantity) for r in found}
    assert got == {("-Inf", "1", 2.0), ("1", "3", 6.0), ("6", "+Inf", 2.0)}
    wrong = ts.histogram_increase(histogram(spark, {"1": 2, "3": 1, "+Inf": 9}))
    assert [r.high for r in wrong.collect()] == [1.0]
    bad = histogram(spark, {"1": 2}).unionByName(histogram(spark, {"x": 1}, foo="other"))
    assert ts.histogram_increase(bad).count() == 0
    missing = histogram(spark, {"1": 2}).unionByName(samples(spark, [({"foo": "x"}, 20, 1)]))
    assert ts.histogram_increase(missing).count() == 0


def test_long_gap(spark):
    """Look-back over a gap that is longer than every range."""
    rows = [("a", at(60), 1.0), ("a", at(120), 3.0), ("a", at(6000), 10.0), ("a", at(6060), 4.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double")
    cells = ts.delta_cells(df, ["s"], ["s"])
    found = ts.rolling_increase(cells, ["s"], {"2m": 120, "5m": 300}, Grid(T0, T0 + 6300))
    got = {(r.slo_time_range, int(r.ts.replace(tzinfo=timezone.utc).timestamp()) - T0): r.value for r in found.collect()}
    assert got[("2m", 120)] == 2.0 and got[("2m", 180)] == 2.0 and ("2m", 240) not in got
    assert got[("2m", 6000)] == 7.0 and got[("2m", 6060)] == 11.0 and got[("5m", 6240)] == 11.0 and got[("5m", 6300)] == 4.0
    assert max(s for r, s in got if r == "5m") == 6300


def test_hold(spark):
    df = spark.createDataFrame([("a", at(0), 1.0, 1)], "s string, ts timestamp, delta double, samples int")
    grid = Grid(T0, T0 + 7200)
    found = ts.rolling_increase(df, ["s"], {"10m": 600}, grid, {"10m": 300}, {"10m": (60, 240)})
    seconds = sorted(int(r.ts.replace(tzinfo=timezone.utc).timestamp()) - T0 for r in found.collect())
    assert seconds == [0, 60, 120, 180, 300, 360, 420, 480]


def test_instant_vector(spark):
    df = samples(spark, [({"n": "a"}, 30, 1), ({"n": "a"}, 200, 2), ({"n": "b"}, 61, 3)])
    found = ts.instant_vector(df, Grid(T0, T0 + 600), lookback=100, offset=30).collect()
    got = {(r.labels["n"], int(r.ts.replace(tzinfo=timezone.utc).timestamp()) - T0): r.value for r in found}
    assert got == {("a", 30): 1.0, ("a", 90): 1.0, ("a", 210): 2.0, ("a", 270): 2.0, ("b", 90): 3.0, ("b", 150): 3.0}


def test_held_for(spark):
    rows = [("a", at(s)) for s in (0, 60, 120, 240, 300)] + [("b", at(0))]
    df = spark.createDataFrame(rows, "k string, ts timestamp").withColumn("value", F.lit(1.0))
    found = ts.held_for(df, ["k"], 60, 60).collect()
    assert sorted(int(r.ts.replace(tzinfo=timezone.utc).timestamp()) - T0 for r in found) == [60, 120, 300]


def vector(spark, rows, names):
    schema = ", ".join(f"{n} string" for n in names) + ", ts timestamp, value double"
    return spark.createDataFrame([(*r[:-1], at(0), float(r[-1])) for r in rows], schema)


def test_vector_match(spark):
    left = vector(spark, [("a", "x", 6), ("a", "y", 9), ("b", None, 1)], ["d", "c"])
    right = vector(spark, [("a", "t1", 3), ("b", "", 0)], ["d", "team"])
    found = v.varith(left, "/", right, on=["d"], group="left", include=["team"]).orderBy("d", "c").collect()
    assert [(r.d, r.c, r.team, r.value) for r in found] == [
        ("a", "x", "t1", 2.0), ("a", "y", "t1", 3.0), ("b", None, "", float("inf")),
    ]
    with pytest.raises(Exception, match="many rows on the one side"):
        v.varith(left, "*", right, on=["d"]).collect()
    # an absent label equals an empty one
    other = vector(spark, [("b", 5)], ["d"])
    assert [r.d for r in v.vand(left, other, on=["d", "c"]).collect()] == ["b"]
    assert sorted(r.c for r in v.vunless(left, other, on=["d"]).collect()) == ["x", "y"]
    nan = left.withColumn("value", F.lit(float("nan")))
    assert v.vcompare(nan, ">", 0.0).count() == 0 and v.vcompare(nan, "!=", 0.0).count() == 3


def test_nan_is_no_maximum(spark):
    rows = [("a", float("nan")), ("a", 2.0), ("b", float("nan")), ("c", None), ("c", -1.0)]
    df = spark.createDataFrame(rows, "slo_domain string, value double")
    found = {r["slo_domain"]: r["value"] for r in v.vagg(df, "max", by=["slo_domain"]).collect()}
    assert found["a"] == 2.0 and found["c"] == -1.0 and math.isnan(found["b"])


def test_growth_beside_nan(spark):
    rows = [(float("nan"), 5.0), (5.0, float("nan")), (5.0, 3.0), (3.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = [r[0] for r in df.select(ts.increase_between(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(found[0]) and math.isnan(found[1]) and found[2:] == [3.0, 2.0]


def test_two_thresholds_of_one_range_are_an_error(spark):
    schema = "slo_domain string, slo_time_range string, value double"
    rows = [("a", "1h", 2.0), ("a", "6h", 3.0), ("b", "6h", 4.0)]

    def limits(rows):
        found = spark.createDataFrame(rows, schema).groupBy("slo_domain").agg(alerts._only("1h").alias("v"))
        return {(r.slo_domain, r.v) for r in found.collect()}

    assert limits(rows) == {("a", 2.0), ("b", None)}
    with pytest.raises(Exception, match="several burn-rate thresholds"):
        limits([*rows, ("a", "1h", 2.5)])


def odd_growth(rng):
    return rng.choice([1.0, 2.5, 7.0, 0.1, 7.0, 1.0, 3.0, float("nan"), float("inf"), float("-inf"), 2.0**70, -4.0])


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_against_model(spark, seed):
    """Every range and step over irregular cells with gaps, non-finite and very large growth."""
    rng = random.Random(seed)
    rows = []
    for name in ("a", "b"):
        minute = 0
        while minute < 500:
            minute += rng.choice([1, 1, 1, 2, 5, 40, 90])
            rows.append((name, at(60 * minute), odd_growth(rng) if rng.random() < 0.2 else float(rng.randrange(9)), 1))
    df = spark.createDataFrame(rows, "s string, ts timestamp, delta double, samples int")
    grid = Grid(T0 + 600, T0 + 60 * 480)
    ranges, steps = {"3m": 180, "12m": 720, "60m": 3600, "7m": 420}, {"12m": 180, "60m": 900, "7m": 180}
    found = ts.rolling_increase(df, ["s"], ranges, grid, steps, {"60m": (180, 1800)}).collect()
    got = {(r.s, r.slo_time_range, int(r.ts.replace(tzinfo=timezone.utc).timestamp())): r.value for r in found}
    expected = {}
    for name in ("a", "b"):
        own = [(int(t.timestamp()), d) for s, t, d, _ in rows if s == name]
        for r, seconds in ranges.items():
            last = None
            for now in range(grid.start - 3600, grid.end + 1, 60):
                inside = [d for t, d in own if now - seconds < t <= now and t <= grid.end]
                if now % steps.get(r, 60) == 0 and inside:
                    last = (now, sum(inside))
                fresh = last and (now == last[0] if r != "60m" else now - last[0] < 1800 and now % 180 == 0)
                if fresh and now >= grid.start:
                    expected[name, r, now] = last[1]
    assert got.keys() == expected.keys()
    assert all(same(got[k], expected[k]) for k in got), [(k, got[k], expected[k]) for k in got if not same(got[k], expected[k])][:5]
    wide = ts.rolling_wide(df, ["s"], {"v": ("delta", "samples")}, ranges, grid, steps, {"60m": (180, 1800)}).collect()
    again = {(r.s, n, int(r.ts.replace(tzinfo=timezone.utc).timestamp())): r[f"v_{n}"] for r in wide for n in ranges if r[f"v_{n}"] is not None}
    assert again.keys() == expected.keys() and all(same(again[k], got[k]) for k in got)


def test_infinity_leaves_no_trace(spark):
    cells = [("a", at(60), float("inf"), 1), ("a", at(120), 2.0**60, 1), ("a", at(1200), 1.0, 1), ("a", at(90060), 1e-3, 1)]
    df = spark.createDataFrame(cells, "s string, ts timestamp, delta double, samples int")
    found = ts.rolling_increase(df, ["s"], {"5m": 300}, Grid(T0, T0 + 90060)).collect()
    got = {int(r.ts.replace(tzinfo=timezone.utc).timestamp()) - T0: r.value for r in found}
    assert got[60] == got[300] == float("inf") and got[360] == 2.0**60 and got[1200] == 1.0 and got[90060] == 1e-3


@pytest.mark.parametrize("function", ["count", "sum", "avg", "min", "max", "delta"])
def test_over_time_against_model(spark, function):
    for seed, rows_of_range in ((1, 1), (2, 5), (3, 16)):
        rng = random.Random(seed)
        rows = []
        for name in ("a", "b", None):
            second = 0
            while second < 9000:
                second += rng.choice([7, 31, 60, 61, 130, 700, 1500])
                value = float("nan") if function in ("min", "max") and rng.random() < 0.2 else rng.choice([float("inf"), 2.0**70]) if function == "sum" and rng.random() < 0.05 else float(rng.randrange(-50, 50))
                rows.append((name, at(second), value))
        df = spark.createDataFrame(rows, "s string, ts timestamp, value double").repartition(3)
        seconds, grid = 60 * rows_of_range, Grid(T0 + 300, T0 + 8400)
        found = ts.over_time(df, ["s"], function, seconds, grid).collect()
        got = {(r.s, int(r.ts.replace(tzinfo=timezone.utc).timestamp())): r.value for r in found}
        expected = {}
        for name in ("a", "b", None):
            own = [(t.timestamp(), x) for s, t, x in rows if s == name]
            for now in range(grid.start, grid.end + 1, 60):
                inside = [x for t, x in own if now - seconds < t <= now]
                numbers = [x for x in inside if not math.isnan(x)] or inside
                if not inside or (function == "delta" and len(inside) < 2):
                    continue
                expected[name, now] = {
                    "count": float(len(inside)), "sum": sum(inside), "avg": sum(inside) / len(inside),
                    "min": min(numbers), "max": max(numbers), "delta": inside[-1] - inside[0],
                }[function]
        assert got.keys() == expected.keys()
        assert all(same(got[k], expected[k]) for k in got), [(k, got[k], expected[k]) for k in got if not same(got[k], expected[k])][:5]


def test_cost_does_not_depend_on_the_range(spark):
    """No frame of a window is bounded below by the range."""
    df = spark.createDataFrame([("a", at(60), 1.0)], "s string, ts timestamp, value double")
    for function in ("count", "sum", "avg", "min", "max", "delta"):
        plan = ts.over_time(df, ["s"], function, 86400, Grid(T0, T0 + 86400))._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame" not in plan and "unboundedfollowing" not in plan.lower()


def scans(df):
    """File scans of a plan in which Spark reuses equal exchanges."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["alert_health", "effective_burn", "query_sli", "alert_missing_all", "rate_coefficient"])
def test_rule_groups_read_their_tables_twice_at_most(spark, name):
    import __spark_entry__ as driver

    found = driver.queries()[name](spark, "/root/testdata/sf0.001")
    assert scans(found) <= 2


def test_held_columns(spark):
    from sloflow.operators import groups

    rng = random.Random(5)
    rows = [(s, at(60 * i), rng.choice([1.0, 1.0, 1.0, 0.0, None])) for s in ("a", "b") for i in range(200) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double")
    found = groups.held(df, ["s"], {"now": (F.col("value") == 1.0, 0), "long": (F.col("value") == 1.0, 180)}, 60)
    for name, seconds in (("now", 0), ("long", 180)):
        expected = ts.held_for(df.filter("value = 1.0"), ["s"], seconds, 60)
        assert {(r.s, r.ts) for r in found.filter(name).collect()} == {(r.s, r.ts) for r in expected.collect()}


def test_rule_group_against_single_expressions(spark):
    from sloflow.operators import groups

    rng = random.Random(6)
    rows, second = [], 0
    while second < 6000:
        second += rng.choice([5, 60, 61, 400])
        rows.append((rng.choice(["up", "lines"]), rng.choice(["x", "y", None]), at(second), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, "metric string, instance string, ts timestamp, value double")
    grid = Grid(T0 + 120, T0 + 6000)
    wanted = {"up": groups.Average("up", 240), "grown": groups.Increase("lines", 600), "short": groups.Increase("lines", 60), "now": groups.Latest("lines", 150)}
    found = groups.rule_group(df, ["instance"], grid, wanted)

    def metric(name):
        return df.filter(F.col("metric") == name).drop("metric")

    single = {
        "up": ts.avg_over_time(metric("up"), ["instance"], 240, grid), "grown": ts.increase(metric("lines"), ["instance"], 600, grid),
        "short": ts.increase(metric("lines"), ["instance"], 60, grid), "now": ts.asof(metric("lines"), ["instance"], grid, 150),
    }
    for name, expected in single.items():
        got = {(r.instance, r.ts, r[name]) for r in found.collect() if r[name] is not None}
        assert got == {(r.instance, r.ts, r.value) for r in expected.collect()} and got
