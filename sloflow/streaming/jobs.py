"""Streaming forms of the stateful operators.

Stateless steps (parsing, relabelling, rules, ...) are the same functions on a streaming DataFrame.
Operators that need order or memory run per micro-batch: the batch operator works on the rows of the
batch, and what it must know from earlier batches is in a small state table.  That way a key that
holds a third of a batch is spread over many tasks exactly as in a batch run.

All writers are idempotent: output and state of a batch are folders named after its id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sloflow.operators import counters, shape
from sloflow.functions import strmap
from sloflow.operators.classify import classify_dynamic, event_key, remember
from sloflow.operators.series import MINUTE, STALENESS, counter_events, last_samples
from sloflow.operators.statistical import class_counts, classify_statistical
from sloflow.session import CLASSIFICATION, SAMPLE
from sloflow.sources.matchers import Matcher
from sloflow.streaming.state import DeltaState

LEARNED = T.StructType(
    [T.StructField("event_key", T.StringType()), T.StructField("learned", CLASSIFICATION)]
)
ADMITTED = T.StructType([T.StructField("event_key", T.StringType())])


def learned_state(path: str) -> DeltaState:
    return DeltaState(f"{path}/state", LEARNED, lambda: F.col("event_key"))


def sample_state(path: str) -> DeltaState:
    return DeltaState(f"{path}/state", SAMPLE, lambda: strmap.text(F.col("labels")), lambda: F.unix_seconds("ts"))


def admitted_state(path: str) -> DeltaState:
    return DeltaState(f"{path}/state", ADMITTED, lambda: F.col("event_key"))


def weight_state(path: str, interval: int) -> DeltaState:
    schema = T.StructType(
        [T.StructField("interval_no", T.LongType()), T.StructField("domain", T.StringType()), T.StructField("class", T.StringType()), T.StructField("weight", T.DoubleType())]
    )
    return DeltaState(f"{path}/state", schema, lambda: F.to_json(F.struct("interval_no", "domain", "class")), lambda: F.col("interval_no") * interval)


def hold_state(path: str, keys: Sequence[str]) -> DeltaState:
    return DeltaState(f"{path}/state", hold_schema(keys), lambda: F.to_json(F.struct(*keys)), lambda: F.col("last"))


def run(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``each``.

    With ``available_now`` it drains the source and stops, otherwise it runs on.
    """
    writer: DataStreamWriter = (
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def written_batch(df: DataFrame, path: str, number: int) -> DataFrame:
    """``df`` from the folder of its batch: computed once, and the same when the batch is repeated."""
    df.write.mode("overwrite").parquet(batch_path(path, number))
    return df.sparkSession.read.schema(df.schema).parquet(batch_path(path, number))


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def classify_stream(
    stream: DataFrame,
    path: str,
    exact: DataFrame | None = None,
    regexp: Sequence[Matcher] = (),
    order: Sequence[str] = ("event_time", "event_id"),
    chunk: Column | None = None,
    **options,
) -> StreamingQuery:
    """Classification with a learned cache that lives as long as the stream.

    A batch reads what is known of its own event keys, and writes those of which it learned something new.
    """
    return run(stream, lambda batch, number: classify_batch(batch, number, path, exact, regexp, order, chunk), f"{path}/checkpoint", **options)


def classify_batch(
    batch: DataFrame,
    number: int,
    path: str,
    exact: DataFrame | None = None,
    regexp: Sequence[Matcher] = (),
    order: Sequence[str] = ("event_time", "event_id"),
    chunk: Column | None = None,
) -> DataFrame:
    """One micro-batch of :func:`classify_stream`: its events, as they were written."""
    state, spark = learned_state(path), batch.sparkSession
    known = state.read(spark, number, state.touched(batch.select(event_key().alias("event_key"))))
    found = classify_dynamic(batch, exact, regexp, order, chunk, remembered=known)
    written = written_batch(found, f"{path}/events", number)
    old = known.select(F.col("event_key").alias("__key"), F.col("learned").alias("__old"))
    now = remember(written, None, order).filter(F.col("event_key").isNotNull())
    both = now.join(old, F.col("event_key") == F.col("__key"), "left")
    news = F.col("__key").isNull() | (F.col("learned").isNotNull() & ~F.col("learned").eqNullSafe(F.col("__old")))
    state.write(both.filter(news), number)
    return written


def increase_stream(
    stream: DataFrame,
    path: str,
    poll_interval: int = MINUTE,
    staleness: int = STALENESS,
    lateness: int = 10 * MINUTE,
    **options,
) -> StreamingQuery:
    """Raw events from counter samples; the last sample of each series is kept between batches.

    A poll whose samples arrive in two batches gives two events that add up to its growth.  A series
    leaves the state when its last sample is too old to count for samples that come up to ``lateness``
    seconds after the time that the stream has reached, so the state follows the live series and not the
    history.  Samples dated in the future do not move that time, as long as they are ahead of the clock or
    come in one batch only.
    """

    def each(batch: DataFrame, number: int) -> None:
        increase_batch(batch, number, path, lambda rows, earlier: counter_events(rows, poll_interval, staleness, earlier=earlier), staleness + poll_interval + lateness)

    return run(stream, each, f"{path}/checkpoint", **options)


def increase_batch(
    batch: DataFrame, number: int, path: str, events: Callable[[DataFrame, DataFrame], DataFrame], seconds: int
) -> DataFrame:
    """One micro-batch of :func:`increase_stream`: its events, as they were written.

    ``events`` makes them of the samples and the last earlier ones; a series is kept for ``seconds``.
    """
    state, spark = sample_state(path), batch.sparkSession
    earlier = state.read(spark, number, state.touched(batch))
    written = written_batch(events(batch, earlier), f"{path}/events", number)
    newest = batch.agg(F.max(F.unix_seconds("ts"))).first()[0]
    state.advance(spark, number, newest, seconds)
    here = batch.select(strmap.text(F.col("labels")).alias("__series")).distinct()
    kept = last_samples(batch, earlier).withColumn("__series", strmap.text(F.col("labels")))
    state.write(kept.join(here, "__series", "left_semi"), number)
    return written


def cap_stream(
    stream: DataFrame,
    path: str,
    limit: int,
    placeholder: str = counters.EXCEEDED_PLACEHOLDER,
    order: Sequence[str] = ("event_time", "event_id", "rule"),
    **options,
) -> StreamingQuery:
    """Cardinality limit over the whole stream: the admitted keys are kept between batches.

    They are ``limit`` at most; a batch writes those that it adds.
    """
    state = admitted_state(path)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = state.read(spark, number)
        free = limit - known.count()
        fresh = batch.join(known, "event_key", "left_anti")
        added = counters.admitted_keys(fresh, max(free, 0), order).select("event_key")
        state.write(added, number)
        admitted = state.read(spark, number + 1)
        capped = counters.cap_event_keys(batch, limit, placeholder, order, admitted)
        capped.write.mode("overwrite").parquet(batch_path(f"{path}/events", number))

    return run(stream, each, f"{path}/checkpoint", **options)


def counter_state(path: str, names: counters.LabelNames = counters.DEFAULT_NAMES, exemplars: bool = False) -> DeltaState:
    """Label sets of the finest level with the sums of both results, and their latest exemplars."""
    text = T.StringType()
    fields = [T.StructField(name, text) for name in names.levels] + [T.StructField("extra", T.MapType(text, text))]
    fields += [T.StructField(result, T.DoubleType()) for result in counters.RESULTS]
    if exemplars:
        at = T.StructType([T.StructField("event_time", T.TimestampType()), T.StructField("event_id", T.LongType())])
        shown = T.StructType([T.StructField("at", at), T.StructField("value", T.DoubleType()), T.StructField("labels", text)])
        fields += [T.StructField(f"{result}_exemplar", shown) for result in counters.RESULTS]
    levels = [F.col(f"`{name}`") for name in names.levels]
    return DeltaState(f"{path}/counters", T.StructType(fields), lambda: F.to_json(F.struct(*levels, strmap.text(F.col("extra")).alias("extra"))))


def counter_stream(
    stream: DataFrame,
    path: str,
    names: counters.LabelNames = counters.DEFAULT_NAMES,
    limit: int = 0,
    placeholder: str = counters.EXCEEDED_PLACEHOLDER,
    exemplar_keys: Sequence[str] = (),
    order: Sequence[str] = ("event_time", "event_id", "rule"),
    **options,
) -> StreamingQuery:
    """Counters of SLO events since the start of the stream, with a limit on event keys and exemplars; they survive restarts.

    A batch is aggregated to label sets of the finest level, and only those are read, added to and written again.
    The coarser levels are made by :func:`read_counters`.  The keys that came first over the whole stream are
    admitted; 0 means no limit.
    """

    def each(batch: DataFrame, number: int) -> None:
        count_batch(batch, number, path, names, limit, placeholder, exemplar_keys, order)

    return run(stream, each, f"{path}/checkpoint", **options)


def count_batch(
    batch: DataFrame,
    number: int,
    path: str,
    names: counters.LabelNames = counters.DEFAULT_NAMES,
    limit: int = 0,
    placeholder: str = counters.EXCEEDED_PLACEHOLDER,
    exemplar_keys: Sequence[str] = (),
    order: Sequence[str] = ("event_time", "event_id", "rule"),
) -> None:
    """One micro-batch of :func:`counter_stream`."""
    state, seen, spark = counter_state(path, names, bool(exemplar_keys)), admitted_state(f"{path}/keys"), batch.sparkSession
    rows = shape.valid_result(batch)
    if limit:
        known = seen.read(spark, number)
        fresh = rows.join(known, "event_key", "left_anti")
        seen.write(counters.admitted_keys(fresh, max(limit - known.count(), 0), order).select("event_key"), number)
        rows = counters.cap_event_keys(rows, limit, placeholder, order, seen.read(spark, number + 1))
    added = counters.finest_counters(rows, names, exemplar_keys, ("event_time", "event_id"))
    added = added.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in state.schema])
    # Written before it is added: what it is read for would otherwise aggregate the batch again.
    added.write.mode("overwrite").parquet(batch_path(f"{path}/added", number))
    added = spark.read.schema(state.schema).parquet(batch_path(f"{path}/added", number))
    before = state.read(spark, number, state.touched(added))
    here = added.select(state.key().alias("__here")).distinct()
    before = before.join(here, state.key() == F.col("__here"), "left_semi")
    sums = [F.sum(result).alias(result) for result in counters.RESULTS]
    if exemplar_keys:
        latest = [f"{result}_exemplar" for result in counters.RESULTS]
        sums += [F.max_by(name, F.col(f"{name}.at")).alias(name) for name in latest]
    by = [F.col(f"`{name}`") for name in names.levels]
    both = before.unionByName(added).groupBy(*by, state.key().alias("__key")).agg(F.any_value("extra").alias("extra"), *sums)
    state.write(both.drop("__key"), number)


def read_counters(
    spark: SparkSession, path: str, base: str = "slo_events_total", names: counters.LabelNames = counters.DEFAULT_NAMES, exemplars: bool = False
) -> DataFrame:
    """All levels of the counters of a stream: ``(metric, level, labels, value[, exemplar])``."""
    return counters.cascade_levels(counter_state(path, names, exemplars).read(spark), base, names)


def minute_totals(
    events: DataFrame, by: Sequence[str], delay: str = "10 minutes", ts: str = "event_time"
) -> DataFrame:
    """Tumbling one-minute sums on event time; later events are dropped by the watermark."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 minute"), *by)
        .agg(F.sum("quantity").alias("value"))
    )


def late_state(path: str, by: Sequence[str]) -> DeltaState:
    fields = [T.StructField(name, T.StringType()) for name in by]
    fields += [T.StructField("end_sec", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("events", T.LongType())]
    return DeltaState(f"{path}/state", T.StructType(fields), lambda: F.to_json(F.struct("end_sec", *by)), lambda: F.col("end_sec"))


def minute_totals_with_late(
    stream: DataFrame, path: str, by: Sequence[str], delay: int = 10 * MINUTE, ts: str = "event_time", **options
) -> StreamingQuery:
    """One-minute sums like :func:`minute_totals`, and the rows that came too late for them as a table of their own.

    The watermark of a batch is the newest time of all batches before it, less ``delay`` seconds.  A row whose
    minute ended by then is late: it goes to ``late`` with the seconds that it is behind, and is in no sum.  A
    minute is final once the watermark after a batch has passed its end; it is then written to ``rows``, once, and
    leaves the state, which holds the open minutes only.
    """
    state = late_state(path, by)
    names = [*by, "end_sec", "value", "events"]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = state._times().read(spark, number).first()
        before = known["newest"] if known else None
        end = F.floor(F.unix_micros(ts) / 60_000_000) * 60 + 60
        rows = batch.withColumn("end_sec", end)
        mark = None if before is None else before - delay
        late = F.lit(False) if mark is None else F.coalesce(F.col("end_sec") <= mark, F.lit(False))
        behind = rows.filter(late).withColumn("behind", F.lit(mark) - F.unix_seconds(ts)).drop("end_sec")
        behind.write.mode("overwrite").parquet(batch_path(f"{path}/late", number))
        fresh = rows.filter(~late & F.col("end_sec").isNotNull())
        added = fresh.groupBy(*[F.col(n).cast("string").alias(n) for n in by], "end_sec").agg(
            F.sum("quantity").alias("value"), F.count("*").alias("events")
        )
        open_ = state.read(spark, number, state.touched(added))
        here = added.select(*[F.col(n).alias(f"__{n}") for n in (*by, "end_sec")])
        same = F.lit(True)
        for n in (*by, "end_sec"):
            same = same & F.col(n).eqNullSafe(F.col(f"__{n}"))
        touched = open_.join(here, same, "left_semi")
        sums = added.select(*names).unionByName(touched.select(*names)).groupBy(*by, "end_sec").agg(F.sum("value").alias("value"), F.sum("events").alias("events"))
        state.write(sums, number)
        newest = batch.agg(F.max(F.unix_seconds(ts))).first()[0]
        newest = before if newest is None else newest if before is None else max(before, newest)
        now = None if newest is None else newest - delay
        # All open minutes with what this batch added, without the mark that it is about to set.
        current = state.read(spark, number + 1, marked=number)
        final = current.filter(F.col("end_sec") <= now) if now is not None else current.limit(0)
        final.write.mode("overwrite").parquet(batch_path(f"{path}/rows", number))
        state.mark(spark, number, newest, None if now is None else now + 1)

    return run(stream, each, f"{path}/checkpoint", **options)


def sliding_totals(minutes: DataFrame, by: Sequence[str], length: str, slide: str) -> DataFrame:
    """Sliding sums over the one-minute sums, as a second aggregation on the same stream."""
    return (
        minutes.groupBy(F.window(F.window_time("window"), length, slide), *by)
        .agg(F.sum("value").alias("value"))
        .select(
            F.unix_seconds("window.start").alias("start_sec"),
            F.unix_seconds("window.end").alias("end_sec"),
            *by,
            "value",
        )
    )


def without_repeats(events: DataFrame, delay: str = "10 minutes", ts: str = "event_time") -> DataFrame:
    """Drop events delivered twice within the watermark delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def append_to(stream: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Append a stateless or windowed stream to a parquet folder, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option(
        "checkpointLocation", f"{path}/checkpoint"
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime="1 minute").start()


def hold_schema(keys: Sequence[str]) -> T.StructType:
    fields = [T.StructField(key, T.StringType()) for key in keys]
    times = [T.StructField(name, T.LongType()) for name in ("since", "last")]
    return T.StructType(fields + times)


def hold_stream(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    seconds: int,
    step: int,
    lateness: int = 10 * MINUTE,
    **options,
) -> StreamingQuery:
    """Rows of a condition that has held for ``seconds``, across micro-batches.

    Each row of the stream is one evaluation at which the condition holds for its key.  A key's run
    goes on in the next batch if its first evaluation there is one step after the last one here.  A run
    leaves the state once evaluations ``lateness`` seconds after its next step have been seen.
    """
    state = hold_state(path, keys)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = state.read(spark, number, state.touched(batch))
        second = F.unix_seconds("ts")
        ordered = Window.partitionBy(*keys).orderBy("ts")
        marked = batch.withColumn("__island", second - F.row_number().over(ordered) * step)
        whole = Window.partitionBy(*keys, "__island")
        runs = marked.withColumns(
            {"__from": F.min(second).over(whole), "__to": F.max(second).over(whole)}
        )
        renamed = known.withColumnsRenamed({key: f"__k_{key}" for key in keys})
        same = F.lit(True)
        for key in keys:
            same = same & runs[key].eqNullSafe(renamed[f"__k_{key}"])
        joined = runs.join(renamed, same & (F.col("__from") == F.col("last") + step), "left")
        since = F.coalesce("since", "__from")
        done = joined.withColumn("__since", since).select(*batch.columns, "__since", "__to")
        done.write.mode("overwrite").parquet(batch_path(f"{path}/runs", number))
        written = spark.read.schema(done.schema).parquet(batch_path(f"{path}/runs", number))
        written.filter(F.unix_seconds("ts") - F.col("__since") >= seconds).drop(
            "__since", "__to"
        ).write.mode("overwrite").parquet(batch_path(f"{path}/rows", number))
        latest = written.groupBy(*keys).agg(
            F.max_by("__since", "__to").alias("since"), F.max("__to").alias("last")
        )
        state.advance(spark, number, batch.agg(F.max(second)).first()[0], step + lateness)
        state.write(latest, number)

    return run(stream, each, f"{path}/checkpoint", **options)


def weigh_batch(
    batch: DataFrame, number: int, path: str, window: int, interval: int, defaults: Sequence[tuple[str, str, float]] = (), lateness: int = 10 * MINUTE
) -> DataFrame:
    """One micro-batch of the statistical classifier, which knows the class counts of the batches before it.

    A count is kept for the window and ``lateness`` seconds.  An event is drawn once, so counts that come in
    later than an interval's events do not change what was drawn for them.
    """
    state, spark = weight_state(path, interval), batch.sparkSession
    earlier = state.read(spark, number)
    found = written_batch(classify_statistical(batch, window, interval, defaults, earlier=earlier), f"{path}/events", number)
    own = class_counts(found.filter(F.col("statistical_result") == "increased-weight"), interval)
    here = own.select(*[F.col(name).alias(f"__{name}") for name in ("interval_no", "domain", "class")])
    same = F.lit(True)
    for name in ("interval_no", "domain", "class"):
        same = same & F.col(name).eqNullSafe(F.col(f"__{name}"))
    touched = earlier.join(here, same, "left_semi")
    sums = own.unionByName(touched.select(*own.columns)).groupBy("interval_no", "domain", "class").agg(F.sum("weight").alias("weight"))
    state.advance(spark, number, batch.agg(F.max(F.unix_seconds("event_time"))).first()[0], window + 2 * interval + lateness)
    state.write(sums, number)
    return found


def source_backlog(spark: SparkSession, progress: Sequence[dict], limit: int | None = None) -> DataFrame:
    """How far each source of the given progress reports is behind.

    ``unit`` is ``bytes`` for file sources, which report outstanding bytes, and ``records`` for
    sources with numbered offsets.  ``limit`` keeps the sources that are further behind.
    """
    rows = []
    for report in progress:
        for source in report["sources"]:
            metrics = source.get("metrics") or {}
            if "numBytesOutstanding" in metrics:
                behind, unit = int(float(metrics["numBytesOutstanding"])), "bytes"
            else:
                behind, unit = _offset_lag(source.get("endOffset"), source.get("latestOffset")), "records"
            rows.append((report["timestamp"], source["description"], unit, behind))
    table = spark.createDataFrame(rows, "ts string, source string, unit string, backlog bigint")
    return table if limit is None else table.filter(F.col("backlog") > limit)


def _offset_lag(end, latest) -> int:
    """Sum of the differences of equally nested offsets."""
    if isinstance(end, dict) and isinstance(latest, dict):
        return sum(_offset_lag(end.get(key, 0), value) for key, value in latest.items())
    if isinstance(end, (int, float)) and isinstance(latest, (int, float)):
        return max(0, int(latest) - int(end))
    return 0
