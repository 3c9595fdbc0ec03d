"""Streaming twins of batch queries: the stream is drained and its output is read back.

The events arrive in four parts, one after the other, each in a run of its own that goes on from the checkpoint
of the one before, so what is kept between micro-batches and between runs counts in every result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sloflow import fixtures as fx
from sloflow.functions import strmap
from sloflow.operators import shape
from sloflow.operators.relabel import relabel
from sloflow.operators.rules import evaluate_rules, parse_rules
from sloflow.operators.series import DAY
from sloflow.queries.events import CAP, KEYS, STAGES, dynamic_events
from sloflow.session import SAMPLE, shared_dir
from sloflow.sources.matchers import matchers_df
from sloflow.streaming import jobs, staged


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


PARTS = 4


def _in_parts(spark: SparkSession, rows: DataFrame, ts: str, path: str, run: Callable[[], StreamingQuery]) -> None:
    """Write ``rows`` to a folder in stretches of time of about equal size, and run the query after each."""
    second = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    cuts = rows.select(second.alias("second")).approxQuantile("second", [n / PARTS for n in range(1, PARTS)], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        rows.filter((second > low) & (second <= high)).write.mode("append").parquet(path)
        run().awaitTermination()


def _arriving(spark: SparkSession, sf: str, path: str, job: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run ``job`` over the ``events`` table as a stream of raw events that arrive in parts."""
    events = fx.table(spark, sf, "events")
    folder = f"{path}/in"

    def run() -> StreamingQuery:
        return job(fx.e_columns(spark.readStream.schema(events.schema).parquet(folder)))

    _in_parts(spark, events, "ts", folder, run)


def _raw(events: DataFrame) -> DataFrame:
    return shape.generate_event_key(fx.with_metadata(events), KEYS)


def stream_learned(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "learned")
    given = matchers_df(spark, fx.EXACT_MATCHERS)
    _arriving(spark, sf, path, lambda events: jobs.classify_stream(_raw(events), path, given, fx.REGEXP_MATCHERS))
    found = jobs.read_batches(spark, f"{path}/events", dynamic_events(spark, sf).schema)
    return found.select(
        "event_id", "classified_by", *[F.col(f"classification.{p}").alias(p) for p in ("domain", "app", "class")]
    )


#: Domain and class of the streamed events, from their method and user.
AREAS = [
    {"source_labels": ["httpMethod"], "regex": "GET", "target_label": "area", "replacement": "browse"},
    {"source_labels": ["httpMethod"], "regex": "POST", "target_label": "area", "replacement": "shop"},
    {"source_labels": ["userId"], "regex": ".*[02468]", "target_label": "level", "replacement": "critical"},
    {"source_labels": ["userId"], "regex": ".*[13579]", "target_label": "level", "replacement": "low"},
]


def _slo(events: DataFrame) -> DataFrame:
    """SLO events of a stream that is classified by its own metadata, without any memory; all rules."""
    own = shape.classify_from_metadata(relabel(events, AREAS), "area", "level", "endpoint")
    return evaluate_rules(own, parse_rules(fx.RULES))


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "counters")
    _arriving(spark, sf, path, lambda events: jobs.counter_stream(_slo(_raw(events)), path))
    rows = jobs.read_counters(spark, path)
    return rows.select("metric", strmap.text(F.col("labels")).alias("labels"), "value")


def stream_capped_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters with a limit on event keys and exemplars, over four runs."""
    path = _folder(spark, "capped")
    keyed = lambda events: _slo(shape.generate_event_key(_raw(events), ["httpPath"]))
    job = lambda events: jobs.counter_stream(keyed(events), path, limit=CAP, exemplar_keys=["httpMethod"])
    _arriving(spark, sf, path, job)
    rows = jobs.read_counters(spark, path, exemplars=True)
    exemplar = F.col("exemplar")
    return rows.select(
        "metric", strmap.text(F.col("labels")).alias("labels"), "value", exemplar["at"]["event_id"].alias("exemplar_id"),
        exemplar["value"].alias("exemplar_value"), exemplar["labels"].alias("exemplar_labels"),
    )


def stream_cap(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "cap")
    keyed = lambda events: _slo(shape.generate_event_key(_raw(events), ["httpPath"]))
    _arriving(spark, sf, path, lambda events: jobs.cap_stream(keyed(events), path, CAP))
    schema = keyed(fx.e(spark, sf)).schema.add("key_capped", "boolean")
    rows = jobs.read_batches(spark, f"{path}/events", schema)
    return rows.groupBy("event_key", F.col("key_capped").cast("int").alias("key_capped")).agg(
        F.count("*").alias("events"), F.min("event_id").alias("first_id")
    )


def stream_increase(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "increase")
    stream = lambda: spark.readStream.schema(SAMPLE).parquet(f"{path}/samples")
    _in_parts(spark, fx.samples_map(spark, sf), "ts", f"{path}/samples", lambda: jobs.increase_stream(stream(), path, 300, staleness=7 * DAY))
    schema = "event_time timestamp, metadata map<string,string>, quantity double, result_value double"
    m = F.col("metadata")
    events = jobs.read_batches(spark, f"{path}/events", spark.createDataFrame([], schema).schema)
    # A poll whose samples came in two batches has an event from each.
    return events.groupBy(
        strmap.lookup(m, "type").alias("type"), strmap.lookup(m, "result").alias("result"), F.unix_seconds("event_time").alias("sec")
    ).agg(F.sum("quantity").alias("quantity"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "windows")

    def job(events: DataFrame) -> StreamingQuery:
        minutes = jobs.minute_totals(events.withColumn("quantity", F.lit(1.0)), ["event_type", "result"])
        return jobs.append_to(jobs.sliding_totals(minutes, ["event_type", "result"], "1 hour", "10 minutes"), path)

    _arriving(spark, sf, path, job)
    return spark.read.parquet(f"{path}/rows")


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth event comes one part later than its time says, which is too late for most of them.

    Late rows per part and event type, and per day and event type the sums of the final minutes.
    """
    path = _folder(spark, "late")
    events = fx.table(spark, sf, "events")
    time = F.col("ts").cast("timestamp")
    part = F.least(F.floor((F.dayofmonth(time) - 1) / 8), F.lit(PARTS - 1)) + (F.col("event_id") % 10 == 0).cast("int")
    for number in range(PARTS + 1):
        events.filter(part == number).write.mode("append").parquet(f"{path}/in")
        rows = fx.e_columns(spark.readStream.schema(events.schema).parquet(f"{path}/in")).withColumn("quantity", F.lit(1.0))
        jobs.minute_totals_with_late(rows, path, ["event_type"]).awaitTermination()
    late = spark.read.parquet(f"{path}/late").groupBy(F.lit("late").alias("kind"), "event_type", F.col("batch").cast("bigint").alias("part")).agg(
        F.count("*").cast("double").alias("value"), F.sum("event_id").cast("bigint").alias("ids")
    )
    day = F.floor((F.col("end_sec") - 1) / 86400).cast("bigint")
    sums = spark.read.parquet(f"{path}/rows").groupBy(F.lit("sum").alias("kind"), "event_type", day.alias("part")).agg(
        F.sum("value").alias("value"), F.sum("events").alias("ids")
    )
    return late.unionByName(sums)


def stream_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Stateless steps on a stream: event key, own classification, rules."""
    path = _folder(spark, "parse")

    def job(events: DataFrame) -> StreamingQuery:
        rows = _slo(_raw(events)).select(
            "event_id", F.col("rule").cast("bigint").alias("rule"), "event_key", "result", "slo_domain", "slo_class", "quantity"
        )
        return jobs.append_to(rows, path)

    _arriving(spark, sf, path, job)
    return spark.read.parquet(f"{path}/rows")


def _staged(spark: SparkSession, sf: str, config: dict) -> DataFrame:
    """A declarative run over log lines that arrive in parts, each followed to its end by a run that goes on."""
    path = _folder(spark, "staged")
    events = fx.table(spark, sf, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    time = lambda rows: F.to_timestamp(strmap.lookup(F.col("metadata"), "time"), "yyyy-MM-dd HH:mm:ss")

    def run() -> StreamingQuery:
        lines = fx.lines_of(fx.e_columns(spark.readStream.schema(events.schema).parquet(f"{path}/in")))
        return staged.stream_pipeline(spark, json.dumps(config), path, {"tailer": lines}, event_time=time, available_now=True)

    _in_parts(spark, events, "ts", f"{path}/in", run)
    return staged.read_staged(spark, path)


def stages_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of ``stages_events`` on a stream."""
    m = F.col("metadata")
    keys = {"seconds": "seconds", "ip": "ip", "event_key": "__eventKey"}
    return _staged(spark, sf, STAGES).select(
        "event_id", "quantity", *[F.col(f"classification.{p}").alias(p) for p in ("domain", "app", "class")],
        *[strmap.lookup(m, key).alias(name) for name, key in keys.items()],
    )


#: Lines without a referrer have no class of their own; they take the one that their key had last.
LEARNING = {
    "pipeline": ["tailer", "relabel", "eventKeyGenerator", "metadataClassifier", "dynamicClassifier"],
    "modules": {
        **{name: STAGES["modules"][name] for name in ("tailer", "relabel", "eventKeyGenerator")},
        "metadataClassifier": {
            "sloDomainMetadataKey": "httpMethod", "sloClassMetadataKey": "referer", "sloAppMetadataKey": "endpoint",
        },
        "dynamicClassifier": {},
    },
}


def stages_stream_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Stages with a memory: classes learned in one part are used in the next."""
    return _staged(spark, sf, LEARNING).select("event_id", *[F.col(f"classification.{p}").alias(p) for p in ("domain", "app", "class")])


QUERIES = {
    "stages_stream": stages_stream,
    "stages_stream_learned": stages_stream_learned,
    "stream_parse": stream_parse,
    "stream_learned": stream_learned,
    "stream_counters": stream_counters,
    "stream_cap": stream_cap,
    "stream_capped_counters": stream_capped_counters,
    "stream_increase": stream_increase,
    "stream_windows": stream_windows,
    "stream_late": stream_late,
}
