"""Time series: counter increases, range functions and look-ups on an evaluation grid.

Samples are rows of series key columns, ``ts`` and ``value``.  Raw samples are first reduced to one
cell per series and grid step, with partial aggregation; all later windows work on cells, whose
number per series is bounded by the length of the grid and not by the data.

A range ``r`` at time ``t`` covers ``(t - r, t]``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import exploded
from sloflow.functions.text import number_text, to_float
from sloflow.operators.scan import time_chunk, with_previous
from sloflow.operators.shape import BUCKET_MAX, BUCKET_MIN, sample_event

MINUTE, HOUR, DAY = 60, 3600, 86400
# The time ranges in use.
RANGES = {
    "5m": 5 * MINUTE,
    "30m": 30 * MINUTE,
    "1h": HOUR,
    "2h": 2 * HOUR,
    "6h": 6 * HOUR,
    "1d": DAY,
    "3d": 3 * DAY,
    "4w": 28 * DAY,
}
STALENESS = 5 * MINUTE


def _micros(seconds: float) -> int:
    return int(seconds * 1_000_000)


def ceil_time(ts: Column, step: float) -> Column:
    """The first multiple of ``step`` seconds that is not before ``ts``."""
    width = F.lit(_micros(step))
    return F.timestamp_micros(F.ceil(F.unix_micros(ts) / width).cast("bigint") * width)


def floor_time(ts: Column, step: float) -> Column:
    width = F.lit(_micros(step))
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / width).cast("bigint") * width)


def plus(ts: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(_micros(seconds)))


@dataclass(frozen=True)
class Grid:
    """Evaluation times: multiples of ``step`` seconds from ``start`` to ``end`` (unix seconds)."""

    start: int
    end: int
    step: int = MINUTE

    @classmethod
    def over(cls, df: DataFrame, step: int = MINUTE, ts: str = "ts") -> Grid:
        """The grid that covers a table; runs one min/max aggregation over its time column."""
        low, high = df.agg(
            F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))
        ).first()
        if low is None:
            return cls(0, -step, step)
        width = _micros(step)
        return cls(-(-low // width) * step, -(-high // width) * step, step)

    def with_step(self, step: int) -> Grid:
        return Grid(-(-self.start // step) * step, self.end // step * step, step)

    def times(self) -> Column:
        """All grid times as an array column."""
        if self.end < self.start:
            return F.array().cast("array<timestamp>")
        return F.transform(
            F.sequence(F.lit(self.start), F.lit(self.end), F.lit(self.step)),
            lambda second: F.timestamp_seconds(second),
        )

    def df(self, spark: SparkSession) -> DataFrame:
        count = max(0, (self.end - self.start) // self.step + 1)
        return spark.range(count).select(
            F.timestamp_seconds(F.lit(self.start) + F.col("id") * self.step).alias("ts")
        )

    def contains(self, ts: Column) -> Column:
        second = F.unix_micros(ts)
        return second.between(_micros(self.start), _micros(self.end)) & (
            F.pmod(second, F.lit(_micros(self.step))) == 0
        )


def on_grid(constants: DataFrame, grid: Grid) -> DataFrame:
    """Repeat constant rows at every grid time."""
    return constants.withColumn("ts", F.explode(grid.times()))


# ----------------------------------------------------------------- increases between samples


def increase_between(previous: Column, current: Column) -> Column:
    """Growth of a counter; a smaller value means it started again from zero.

    A comparison with NaN is false, so growth from or to NaN is NaN.
    """
    return F.when(~F.isnan(previous) & ~F.isnan(current) & (current < previous), current).otherwise(current - previous)


def counter_deltas(
    samples: DataFrame, series: Sequence[str], chunk_seconds: float = HOUR
) -> DataFrame:
    """Add ``delta``: growth since the previous sample of the series, 0 for the first sample."""
    found = with_previous(
        samples,
        series,
        ["ts"],
        {"__previous": (F.col("value"), None)},
        time_chunk(F.col("ts"), chunk_seconds),
    )
    return found.withColumn(
        "delta",
        F.when(F.col("__previous").isNull(), 0.0).otherwise(
            increase_between(F.col("__previous"), F.col("value"))
        ),
    ).drop("__previous")


def counter_increase(
    samples: DataFrame,
    poll_interval: int = MINUTE,
    staleness: int = STALENESS,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Growth per series and poll: ``(labels, poll_ts, value)``.

    Polls happen at multiples of ``poll_interval``; each sees the samples since the one before.  A
    previous sample that is older than ``staleness`` at the poll, and comes from an earlier poll, is
    forgotten: the first sample of the poll is then the baseline.  ``earlier`` has the last samples
    of an earlier run (:func:`last_samples`); they count as previous samples only.
    """
    rows = samples.select("labels", "ts", "value", F.lit(False).alias("earlier"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select("labels", "ts", "value", F.lit(True).alias("earlier")))
    polled = rows.withColumns(
        {
            "series_id": strmap.text(F.col("labels")),
            "poll_ts": ceil_time(F.col("ts"), poll_interval),
        }
    )
    found = with_previous(
        polled,
        ["series_id"],
        ["ts", "value"],
        {"__previous": (F.struct("ts", "value", "poll_ts"), None)},
        F.unix_micros("poll_ts"),
    )
    previous = F.col("__previous")
    age = F.unix_micros("poll_ts") - F.unix_micros(previous["ts"])
    usable = (previous["poll_ts"] == F.col("poll_ts")) | (age <= _micros(staleness))
    delta = F.when(
        F.coalesce(usable, F.lit(False)), increase_between(previous["value"], F.col("value"))
    ).otherwise(0.0)
    return (
        found.withColumn("delta", delta)
        .filter(~F.col("earlier"))
        .groupBy("series_id", "poll_ts")
        .agg(F.any_value("labels").alias("labels"), F.sum("delta").alias("value"))
        .select("labels", "poll_ts", "value")
    )


def last_samples(samples: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The last sample of every series, for the next run."""
    rows = samples.select("labels", "ts", "value")
    if earlier is not None:
        rows = rows.unionByName(earlier.select("labels", "ts", "value"))
    last = F.max_by(F.struct("labels", "ts", "value"), F.struct("ts", "value")).alias("last")
    return rows.groupBy(strmap.text(F.col("labels")).alias("series_id")).agg(last).select("last.*")


def counter_events(
    samples: DataFrame,
    poll_interval: int = MINUTE,
    staleness: int = STALENESS,
    drop: Sequence[str] = (),
    add: Mapping[str, str] | None = None,
    result_as_quantity: bool = True,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Raw events from counter growth; polls without growth give none."""
    grown = counter_increase(samples, poll_interval, staleness, earlier)
    return sample_event(
        grown, F.col("labels"), F.col("value"), F.col("poll_ts"), result_as_quantity, drop, add
    ).select("event_time", "metadata", "quantity", "result_value")


def histogram_increase(
    samples: DataFrame, poll_interval: int = MINUTE, staleness: int = STALENESS, earlier: DataFrame | None = None
) -> DataFrame:
    """Growth per histogram bucket alone: ``(labels, poll_ts, low, high, value)``.

    A poll with any missing or unreadable ``le`` label is rejected as a whole.  A bucket that grew
    less than the one below it is an error: it and all higher buckets of that histogram are dropped.
    Whether a poll is rejected depends on labels alone, so it is read off the samples.
    """
    bound = to_float(strmap.lookup(F.col("labels"), "le"))
    grown = counter_increase(samples, poll_interval, staleness, earlier).withColumns(
        {"le": bound, "histogram": strmap.text(strmap.without(F.col("labels"), ["le"]))}
    )
    unreadable = samples.filter(bound.isNull())
    rejected = unreadable.select(ceil_time(F.col("ts"), poll_interval).alias("poll_ts")).distinct()
    usable = grown.join(rejected, "poll_ts", "left_anti")
    buckets = Window.partitionBy("histogram", "poll_ts").orderBy("le")
    upto = buckets.rowsBetween(Window.unboundedPreceding, 0)
    return (
        usable.withColumns(
            {
                "low": F.lag("le", 1, float("-inf")).over(buckets),
                "high": F.col("le"),
                "alone": F.col("value") - F.lag("value", 1, 0.0).over(buckets),
            }
        )
        .withColumn("worst", F.min("alone").over(upto))
        .filter(F.col("worst") >= 0)
        .select("labels", "poll_ts", "low", "high", F.col("alone").alias("value"))
    )


def histogram_events(
    samples: DataFrame,
    poll_interval: int = MINUTE,
    staleness: int = STALENESS,
    drop: Sequence[str] = (),
    add: Mapping[str, str] | None = None,
    result_as_quantity: bool = True,
    earlier: DataFrame | None = None,
) -> DataFrame:
    grown = histogram_increase(samples, poll_interval, staleness, earlier)
    bounds = F.create_map(
        F.lit(BUCKET_MIN), number_text(F.col("low")), F.lit(BUCKET_MAX), number_text(F.col("high"))
    )
    return sample_event(
        grown,
        strmap.merge(F.col("labels"), bounds),
        F.col("value"),
        F.col("poll_ts"),
        result_as_quantity,
        drop,
        add,
    ).select("event_time", "metadata", "quantity", "result_value")


# ------------------------------------------------------------------------- cells and ranges


def delta_cells(
    samples: DataFrame, series: Sequence[str], by: Sequence[str], step: int = MINUTE
) -> DataFrame:
    """Counter growth per ``by`` labels and grid step: ``(by, ts, delta, samples)``."""
    return (
        counter_deltas(samples, series)
        .groupBy(*by, ceil_time(F.col("ts"), step).alias("ts"))
        .agg(F.sum("delta").alias("delta"), F.count("*").alias("samples"))
    )


def event_cells(events: DataFrame, by: Sequence[str], step: int = MINUTE) -> DataFrame:
    """The same cells straight from SLO events, without the detour over counters."""
    return events.groupBy(*by, ceil_time(F.col("event_time"), step).alias("ts")).agg(
        F.sum("quantity").alias("delta"), F.count("*").alias("samples")
    )


def _check_range(seconds: int, step: int):
    if seconds <= 0 or seconds % step:
        raise ValueError(f"a range of {seconds}s is not a multiple of the grid step {step}s")


_KEY = "__key"
#: Partitions per configured one: series are few and long, and some tasks get several while others get none.
_FINER = 4


def _spread(cells: DataFrame, series: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Partition by series into a multiple of the configured number of partitions; also the keys of windows over them.

    Cells are few and are about to become many: without a fixed number, adaptive execution would
    merge them into one task before the grid is filled.  The partitioning is by one number per series, as
    Spark drops constant labels from the keys of a window and would then shuffle again, without that number.
    """
    if not series:
        return cells, []
    number = _FINER * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.withColumn(_KEY, F.xxhash64(*series)).repartition(number, _KEY), [_KEY, *series]


# A running sum is kept in parts that can be subtracted again: whole numbers, which are exact as long as there are
# fewer than 2 ** 23 cells, what is left of them, sums of growth too large for that, and counts of cells
# without a finite growth, three to a number.  So what has left a range leaves no trace in it.
_WHOLE = 2.0**40
_FIELD = 21
_PARTS = ("whole", "part", "huge", "odd")


def _parts(growth: Column) -> dict[str, Column]:
    infinite = F.abs(growth) == float("inf")
    finite = ~F.isnan(growth) & ~infinite
    plain = finite & (F.abs(growth) < _WHOLE)
    return {
        "whole": F.when(plain, F.floor(growth)).otherwise(F.lit(0).cast("bigint")),
        "part": F.when(plain, growth - F.floor(growth)).otherwise(0.0),
        "huge": F.when(finite & ~plain, growth).otherwise(0.0),
        "odd": F.when(F.isnan(growth), F.lit(1).cast("bigint"))
        .when(infinite, F.when(growth > 0, F.lit(1 << _FIELD)).otherwise(F.lit(1 << 2 * _FIELD)))
        .otherwise(F.lit(0).cast("bigint")),
    }


def _difference(name: str, before: str) -> Column:
    """The sum between two running sums, whose parts are columns ``<name>_whole`` and so on."""
    whole, part, huge, odd = (F.col(f"{name}_{p}") - F.col(f"{before}_{p}") for p in _PARTS)
    mask = (1 << _FIELD) - 1
    undefined = odd.bitwiseAND(mask) > 0
    up, down = F.shiftright(odd, _FIELD).bitwiseAND(mask) > 0, F.shiftright(odd, 2 * _FIELD) > 0
    return (
        F.when(odd == 0, whole.cast("double") + part + huge)
        .when(undefined | (up & down), float("nan"))
        .when(up, float("inf"))
        .otherwise(float("-inf"))
    )


def _running(name: str, growth: Column, frame) -> dict[str, Column]:
    return {f"{name}_{p}": F.sum(column).over(frame) for p, column in _parts(growth).items()}


def _before(name: str, back: str, rows: int, ordered) -> dict[str, Column]:
    """The parts of a running sum some rows earlier; nothing before the first row."""
    zero = {"whole": 0, "part": 0.0, "huge": 0.0, "odd": 0}
    return {f"{back}_{p}": F.lag(f"{name}_{p}", rows, zero[p]).over(ordered) for p in _PARTS}


def _fill(cells: DataFrame, step: int, end: int, reach: int, following: str = "following") -> DataFrame:
    """Repeat each cell at the times after it, up to the next cell or for ``reach`` seconds.

    ``following`` is the time of the series' next cell; ``filled`` marks the added rows.  Only an
    explode: no join with the grid.
    """
    second = F.unix_seconds("ts")
    last = F.least(
        F.coalesce(F.unix_seconds(following) - step, F.lit(end).cast("bigint")),
        second + F.lit(reach - step),
        F.lit(end).cast("bigint"),
    )
    times = F.sequence(second, F.greatest(last, second), F.lit(step).cast("bigint"))
    return (
        cells.filter(F.unix_seconds("ts") <= end)
        .withColumn("__times", times)
        .select(
            *[F.col(c) for c in cells.columns if c not in ("ts", following)],
            F.posexplode_outer("__times").alias("__nth", "__second"),
        )
        .withColumns({"ts": F.timestamp_seconds("__second"), "filled": F.col("__nth") > 0})
        .drop("__nth", "__second")
    )


def rolling_levels(
    cells: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    ranges: Mapping[str, int],
    grid: Grid,
    steps: Mapping[str, int] | None = None,
    hold: Mapping[str, tuple[int, int]] | None = None,
) -> list[tuple[tuple[str, ...], DataFrame]]:
    """:func:`rolling_wide` in one table per evaluation step, each with the names of its ranges.

    Running sums are taken once over the cells.  A coarser step keeps the last of them within each of its
    intervals, and is filled at that step and only as far as its own ranges reach: the 15-minute cells of a
    month are as many as the one-minute cells of two days.  All steps share one shuffle by ``by``.
    """
    steps, hold = steps or {}, hold or {}
    levels: dict[int, list[str]] = {}
    for name, seconds in ranges.items():
        _check_range(seconds, grid.step)
        step = steps.get(name, grid.step)
        if step % grid.step or (name in hold and (step % hold[name][0] or seconds % step)):
            raise ValueError(f"range {name} is evaluated every {step}s on a grid of {grid.step}s and held by {hold.get(name)}")
        # A range that is no multiple of its step looks back to times between the evaluations.
        levels.setdefault(step if seconds % step == 0 else grid.step, []).append(name)
    spread, keys = _spread(cells, by)
    ordered = Window.partitionBy(*keys).orderBy("ts")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"following": F.lead("ts").over(ordered)}
    for name, (growth, count) in measures.items():
        sums |= _running(f"__{name}", F.col(growth), running)
        sums[f"__last_{name}"] = F.max(F.when(F.col(count) > 0, F.unix_seconds("ts"))).over(running)
    totals = spread.withColumns(sums).select(*keys, "ts", *sums)
    return [(tuple(own), _level(totals, by, keys, list(measures), {r: ranges[r] for r in own}, grid, step, steps, hold)) for step, own in sorted(levels.items())]


def _level(
    totals: DataFrame, by: Sequence[str], keys: Sequence[str], measures: Sequence[str], ranges: Mapping[str, int], grid: Grid, step: int, steps: Mapping[str, int], hold: Mapping[str, tuple[int, int]]
) -> DataFrame:
    if step != grid.step:
        at, following = ceil_time(F.col("ts"), step), ceil_time(F.col("following"), step)
        totals = totals.filter(following.isNull() | (following > at)).withColumns({"ts": at, "following": following})
    held = {r: hold[r] for r in ranges if r in hold}
    longest = max(ranges.values()) + max((seconds for _, seconds in held.values()), default=0)
    dense = _fill(totals, step, grid.end, longest)
    ordered = Window.partitionBy(*keys).orderBy("ts")
    # Rows are dense for the longest range after each sample, so looking back by rows is exact.
    looks: dict[str, Column] = {}
    for name in measures:
        for r, seconds in ranges.items():
            looks |= _before(f"__{name}", f"__{name}_{r}", seconds // step, ordered)
    second = F.unix_seconds("ts")
    seen = dense.withColumns(looks)
    columns = {}
    for r, seconds in ranges.items():
        on_time = F.pmod(second, F.lit(steps[r])) == 0 if steps.get(r, step) != step else F.lit(True)
        for name in measures:
            present = F.col(f"__last_{name}") > second - seconds
            columns[f"{name}_{r}"] = F.when(on_time & present, _difference(f"__{name}", f"__{name}_{r}"))
    found = seen.select(*keys, "ts", *[column.alias(name) for name, column in columns.items()])
    if held:
        found = _held(found, keys, measures, held, ordered, step, grid)
    return found.filter(F.unix_seconds("ts") >= grid.start).select(*by, "ts", *columns)


def _held(found: DataFrame, keys: Sequence[str], measures: Sequence[str], hold: Mapping[str, tuple[int, int]], ordered, step: int, grid: Grid) -> DataFrame:
    """Repeat the last value of the held ranges on their finer step, for some seconds."""
    fine = min(s for s, _ in hold.values())
    earlier = {
        f"__{column}_{j}": F.lag(F.struct("ts", column), j).over(ordered)
        for r, (_, seconds) in hold.items()
        for column in (f"{name}_{r}" for name in measures)
        for j in range(1, -(-seconds // step))
    }
    offsets = F.explode(F.sequence(F.lit(0), F.lit(step - fine), F.lit(fine)))
    rows = found.withColumns(earlier).withColumn("__offset", offsets)
    offset, second = F.col("__offset"), F.unix_seconds("ts")
    values = {}
    for column in [c for c in found.columns if c not in (*keys, "ts")]:
        r = next((r for r in hold if any(column == f"{name}_{r}" for name in measures)), None)
        if r is None:
            values[column] = F.when(offset == 0, F.col(column))
            continue
        own_step, seconds = hold[r]
        choices = [F.when(offset < seconds, F.col(column))]
        for j in range(1, -(-seconds // step)):
            back = F.col(f"__{column}_{j}")
            near = (F.unix_seconds(back["ts"]) == second - j * step) & (offset + j * step < seconds)
            choices.append(F.when(near, back[column]))
        values[column] = F.when(F.pmod(offset, F.lit(own_step)) == 0, F.coalesce(*choices))
    moved = F.timestamp_seconds(second + offset)
    return rows.select(*keys, moved.alias("ts"), *[column.alias(name) for name, column in values.items()]).filter(F.unix_seconds("ts") <= grid.end)


def rolling_wide(
    cells: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    ranges: Mapping[str, int],
    grid: Grid,
    steps: Mapping[str, int] | None = None,
    hold: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Increase of each measure over each range, as columns ``<measure>_<range>`` per time.

    ``measures`` maps a name to the cell columns of its growth and of its number of samples.  A
    column is NULL where the range has no sample of the measure, or where the range is not
    evaluated: ``steps`` gives the evaluation step of a range, and ``hold`` repeats its last value
    on a finer step for some seconds, as ``(step, seconds)``.

    Growth is summed up along time once, and each range is the difference of two running sums; the
    cost does not depend on the length of the ranges.  Growth that is not finite, or very large, counts in
    the ranges that it is in and in no other.
    """
    levels = [found for _, found in rolling_levels(cells, by, measures, ranges, grid, steps, hold)]
    if len(levels) == 1:
        return levels[0]
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level, allowMissingColumns=True)
    columns = [f"{name}_{r}" for name in measures for r in ranges]
    return union.groupBy(*by, "ts").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in columns])


def rolling_increase(
    cells: DataFrame,
    by: Sequence[str],
    ranges: Mapping[str, int],
    grid: Grid,
    steps: Mapping[str, int] | None = None,
    hold: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Increase over each range at each grid time: ``(by, slo_time_range, ts, value)``.

    A group has a value where it has a sample in the range; see :func:`rolling_wide`.
    """
    union = None
    for names, level in rolling_levels(cells, by, {"v": ("delta", "samples")}, ranges, grid, steps, hold):
        rows = F.array(
            *[
                F.when(
                    F.col(f"v_{r}").isNotNull(),
                    F.struct(F.lit(r).alias("slo_time_range"), F.col(f"v_{r}").alias("value")),
                )
                for r in names
            ]
        )
        part = exploded(level, "__row", F.array_compact(rows)).select(*by, "__row.slo_time_range", "ts", "__row.value")
        union = part if union is None else union.unionByName(part)
    return union


def _looking_back(
    cells: DataFrame,
    series: Sequence[str],
    seconds: int,
    grid: Grid,
    sums: Sequence[str] = (),
    counts: Sequence[str] = (),
    firsts: Sequence[str] = (),
    lasts: Sequence[str] = (),
) -> DataFrame:
    """Per series and grid time with a cell in the range: sums and counts of the range's cells, and
    columns of its first and last cell.

    Cells have the times of the grid.  Sums are differences of running sums, and a cell knows its successor,
    so the first cell of a range is the one after the last cell before it.  The cost does not depend on the range.
    """
    spread, keys = _spread(cells, series)
    ordered = Window.partitionBy(*keys).orderBy("ts")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    columns = {"following": F.lead("ts").over(ordered)}
    for name in sums:
        columns |= _running(f"__{name}", F.col(name), running)
    columns |= {f"__{name}": F.sum(name).over(running) for name in counts}
    columns |= {f"__next_{name}": F.lead(name).over(ordered) for name in firsts}
    columns |= {f"__origin_{name}": F.first(name).over(running) for name in firsts}
    known = spread.withColumns(columns).select(*keys, "ts", *columns, *[F.col(n).alias(f"__own_{n}") for n in lasts])
    rows = seconds // grid.step
    looks: dict[str, Column] = {"__seen": F.lag(F.lit(True), rows).over(ordered)}
    for name in sums:
        looks |= _before(f"__{name}", f"__{name}_back", rows, ordered)
    looks |= {f"__{name}_back": F.lag(f"__{name}", rows, 0).over(ordered) for name in counts}
    looks |= {f"__{name}_after": F.lag(f"__next_{name}", rows).over(ordered) for name in firsts}
    dense = _fill(known, grid.step, grid.end, seconds).withColumns(looks)
    found = dense.select(
        *series,
        "ts",
        *[_difference(f"__{name}", f"__{name}_back").alias(name) for name in sums],
        *[(F.col(f"__{name}") - F.col(f"__{name}_back")).alias(name) for name in counts],
        *[F.when(F.col("__seen"), F.col(f"__{name}_after")).otherwise(F.col(f"__origin_{name}")).alias(name) for name in firsts],
        *[F.col(f"__own_{name}").alias(name) for name in lasts],
    )
    return found.filter(F.unix_seconds("ts") >= grid.start)


def _extremum(cells: DataFrame, series: Sequence[str], function: str, seconds: int, grid: Grid) -> DataFrame:
    """``min`` or ``max`` of column ``value`` over the cells of each range; NULL if all of them are.

    The time axis is cut into blocks as long as the range.  A range meets two blocks at most: it ends with the
    first cells of one, whose extremum is known from left to right, and begins with the last ones of the
    block before, known from right to left.  So each cell is looked at three times, whatever the range.
    """
    aggregate, choose = (F.min, F.least) if function == "min" else (F.max, F.greatest)
    rows = seconds // grid.step

    def block(ts: str) -> Column:
        return F.floor((F.unix_seconds(ts) / F.lit(grid.step) - 1) / F.lit(rows))

    spread, keys = _spread(cells, series)
    inner = Window.partitionBy(*keys, "__block")
    upto = Window.unboundedPreceding
    ordered = Window.partitionBy(*keys).orderBy("__block", "ts")
    known = (
        spread
        .withColumn("__block", block("ts"))
        .withColumn("__right", aggregate("value").over(inner.orderBy(F.desc("ts")).rowsBetween(upto, 0)))
        .withColumns(
            {
                "__left": aggregate("value").over(inner.orderBy("ts").rowsBetween(upto, 0)),
                "following": F.lead("ts").over(ordered),
                "__next_right": F.lead("__right").over(ordered),
                "__next_block": F.lead("__block").over(ordered),
            }
        )
        .withColumnRenamed("__block", "__cell_block")
        .drop("value")
    )
    dense = _fill(known, grid.step, grid.end, seconds).withColumn("__block", block("ts"))
    # From the start of the block to this row; and from the first cell at or after a row to the end of that cell's block.
    behind = F.when(F.col("__cell_block") == F.col("__block"), F.col("__left"))
    ahead = F.struct(
        F.when(F.col("filled"), F.col("__next_block")).otherwise(F.col("__block")).alias("block"),
        F.when(F.col("filled"), F.col("__next_right")).otherwise(F.col("__right")).alias("value"),
    )
    rowwise = Window.partitionBy(*keys).orderBy("ts")
    # Without a row that far back, the range begins before the first cell.
    begun = F.coalesce(F.lag("__ahead", rows - 1).over(rowwise), F.first("__ahead").over(rowwise.rowsBetween(upto, 0)))
    seen = dense.withColumn("__ahead", ahead).withColumn("__begun", begun)
    earlier = F.when(F.col("__begun.block") < F.col("__block"), F.col("__begun.value"))
    found = seen.select(*series, "ts", choose(behind, earlier).alias("value"))
    return found.filter(F.unix_seconds("ts") >= grid.start)


def increase(
    samples: DataFrame,
    series: Sequence[str],
    seconds: int,
    grid: Grid,
    by: Sequence[str] | None = None,
    extrapolate: bool = False,
) -> DataFrame:
    """Sum over the series of each ``by`` group of the counter growth within the range.

    The exact form counts the growth between all neighbouring samples that ends in the range.  With
    ``extrapolate`` each series with at least two samples in the range is stretched to the range's
    edges, the way common monitoring systems estimate it.
    """
    by = list(series) if by is None else list(by)
    if extrapolate:
        return _extrapolated(samples, series, seconds, grid, by)
    cells = delta_cells(samples, series, by, grid.step)
    return rolling_increase(cells, by, {"r": seconds}, grid).drop("slo_time_range")


def _extrapolated(
    samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid, by: Sequence[str]
) -> DataFrame:
    _check_range(seconds, grid.step)
    at = F.unix_micros("ts") / 1e6
    cells = (
        counter_deltas(samples, series)
        .withColumns({"__cell": ceil_time(F.col("ts"), grid.step), "__at": at})
        .groupBy(*series, F.col("__cell").alias("ts"))
        .agg(
            F.min_by(F.struct("__at", "value", "delta"), "__at").alias("first"),
            F.max("__at").alias("last_at"),
            F.sum("delta").alias("delta"),
            F.count("*").alias("samples"),
        )
    )
    second = F.unix_seconds("ts")
    stats = _looking_back(
        cells, series, seconds, grid, sums=["delta"], counts=["samples"], firsts=["first"], lasts=["last_at"]
    ).filter(F.col("samples") >= 2)
    grown = F.col("delta") - F.col("first.delta")
    sampled = F.col("last_at") - F.col("first.__at")
    spacing = sampled / (F.col("samples") - 1)
    to_start = F.col("first.__at") - (second - seconds)
    to_end = second - F.col("last_at")
    to_zero = F.when(
        (grown > 0) & (F.col("first.value") >= 0), sampled * F.try_divide(F.col("first.value"), grown)
    )
    to_start = F.when(to_zero < to_start, to_zero).otherwise(to_start)
    limit = spacing * 1.1
    covered = (
        sampled
        + F.when(to_start < limit, to_start).otherwise(spacing / 2)
        + F.when(to_end < limit, to_end).otherwise(spacing / 2)
    )
    value = grown * F.try_divide(covered, sampled)
    return (
        stats.withColumn("value", value)
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "ts")
        .agg(F.sum("value").alias("value"))
        .select(*by, "ts", "value")
    )


def rate(
    samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid, by: Sequence[str] | None = None
) -> DataFrame:
    """Increase per second."""
    grown = increase(samples, series, seconds, grid, by)
    return grown.withColumn("value", F.col("value") / float(seconds))


def asof(
    samples: DataFrame,
    series: Sequence[str],
    grid: Grid,
    lookback: int = STALENESS,
    closed: bool = True,
    carried: Sequence[str] = ("value",),
) -> DataFrame:
    """Latest ``carried`` columns of each series at each grid time, if not older than ``lookback``."""
    latest = samples.groupBy(*series, ceil_time(F.col("ts"), grid.step).alias("__cell")).agg(
        F.max_by(F.struct("ts", *carried), "ts").alias("__latest")
    )
    width = _micros(grid.step)
    following = F.lead("__cell").over(Window.partitionBy(*series).orderBy("__cell"))
    oldest = F.unix_micros("__latest.ts") + F.lit(_micros(lookback) - (0 if closed else 1))
    first = F.unix_micros("__cell")
    last = F.least(
        F.coalesce(F.unix_micros(following) - width, F.lit(_micros(grid.end)).cast("bigint")),
        F.floor(oldest / F.lit(width)).cast("bigint") * width,
        F.lit(_micros(grid.end)).cast("bigint"),
    )
    times = F.when(
        last >= first, F.sequence(first, F.greatest(last, first), F.lit(width).cast("bigint"))
    )
    return (
        latest.withColumn("__times", times)
        .select(*series, F.explode_outer("__times").alias("__at"), *[F.col(f"__latest.{c}") for c in carried])
        .filter(F.col("__at") >= _micros(grid.start))
        .select(*series, F.timestamp_micros("__at").alias("ts"), *carried)
    )


def instant_vector(
    samples: DataFrame,
    grid: Grid,
    lookback: int = STALENESS,
    offset: int = 0,
) -> DataFrame:
    """Samples ``(labels, ts, value)`` as seen by evaluations at the grid times.

    An evaluation at ``t`` looks at ``t - offset``, which is also the time of its rows.
    """
    keyed = shift(samples.withColumn("series_id", strmap.text(F.col("labels"))), offset)
    found = asof(keyed, ["series_id"], grid, lookback, carried=("labels", "value"))
    return shift(found, -offset).select("labels", "ts", "value")


def last_over_time(samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid) -> DataFrame:
    return asof(samples, series, grid, seconds, closed=False)


_OVER_TIME = ("count", "sum", "avg", "min", "max", "delta")


def over_time(
    samples: DataFrame, series: Sequence[str], function: str, seconds: int, grid: Grid
) -> DataFrame:
    """``count``, ``sum``, ``avg``, ``min``, ``max`` or ``delta`` (last - first) within the range."""
    if function not in _OVER_TIME:
        raise ValueError(f"unknown range function {function!r}, use one of {_OVER_TIME}")
    _check_range(seconds, grid.step)
    # Grouped by another name: min_by and max_by below need the samples' own times.
    cells = samples.withColumnRenamed("ts", "__at").groupBy(*series, ceil_time(F.col("__at"), grid.step).alias("ts"))
    count = F.count("*").alias("count")
    if function in ("min", "max"):
        real = F.when(~F.isnan("value"), F.col("value"))
        reduced = cells.agg((F.min if function == "min" else F.max)(real).alias("value"))
        found = _extremum(reduced, series, function, seconds, grid)
        # There is a sample in each range: where no number was found, all of them are NaN.
        return found.withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    if function == "delta":
        reduced = cells.agg(count, F.min_by("value", "__at").alias("first"), F.max_by("value", "__at").alias("last"))
        found = _looking_back(reduced, series, seconds, grid, counts=["count"], firsts=["first"], lasts=["last"])
        return found.filter("count > 1").select(*series, "ts", (F.col("last") - F.col("first")).alias("value"))
    if function == "count":
        found = _looking_back(cells.agg(count), series, seconds, grid, counts=["count"])
        return found.select(*series, "ts", F.col("count").cast("double").alias("value"))
    found = _looking_back(cells.agg(count, F.sum("value").alias("sum")), series, seconds, grid, sums=["sum"], counts=["count"])
    return found.select(*series, "ts", (F.col("sum") / F.col("count") if function == "avg" else F.col("sum")).alias("value"))


def count_over_time(samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid) -> DataFrame:
    return over_time(samples, series, "count", seconds, grid)


def avg_over_time(samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid) -> DataFrame:
    return over_time(samples, series, "avg", seconds, grid)


def max_over_time(samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid) -> DataFrame:
    return over_time(samples, series, "max", seconds, grid)


def delta(samples: DataFrame, series: Sequence[str], seconds: int, grid: Grid) -> DataFrame:
    return over_time(samples, series, "delta", seconds, grid)


def shift(df: DataFrame, seconds: int) -> DataFrame:
    """``offset``: rows appear ``seconds`` later."""
    return df.withColumn("ts", plus(F.col("ts"), seconds))


def absent(df: DataFrame, grid: Grid) -> DataFrame:
    """One row of value 1 at each grid time that has no row in ``df``."""
    times = grid.df(df.sparkSession)
    return times.join(df.select("ts").distinct(), "ts", "left_anti").withColumn("value", F.lit(1.0))


def held_for(df: DataFrame, keys: Sequence[str], seconds: int, step: int) -> DataFrame:
    """Rows of a condition that held at every evaluation for the last ``seconds``.

    ``df`` has one row per key and evaluation at which the condition holds.
    """
    ordered = Window.partitionBy(*keys).orderBy("ts")
    island = F.unix_seconds("ts") - F.row_number().over(ordered) * step
    marked = df.withColumn("__island", island)
    since = F.min(F.unix_seconds("ts")).over(Window.partitionBy(*keys, "__island"))
    return (
        marked.withColumn("__held", F.unix_seconds("ts") - since)
        .filter(F.col("__held") >= seconds)
        .drop("__island", "__held")
    )
