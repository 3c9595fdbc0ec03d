"""Declarative runs: an ordered list of stages with their settings, from YAML.

A stage is a function from DataFrame to DataFrame.  Setting names may be written in any letter case,
unknown ones are errors, and the kinds of events must fit from stage to stage before anything runs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.text import parse_duration_ns, parse_float
from sloflow.operators import counters, quality, shape
from sloflow.operators.classify import classification_report, classify_dynamic
from sloflow.operators.relabel import RelabelStep, relabel
from sloflow.operators.rules import ConfigError, evaluate_rules, load_rules, read_yaml, rules_to_thresholds
from sloflow.operators.scan import time_chunk
from sloflow.operators.series import STALENESS, counter_events, histogram_events, shift
from sloflow.operators.statistical import classify_statistical
from sloflow.session import CLASSIFICATION
from sloflow.sources import accesslog, loglines, messages
from sloflow.sources.matchers import matchers_df, read_matchers

NOTHING, RAW, SLO, COUNTERS = "nothing", "raw events", "SLO events", "counters"


@dataclass
class Context:
    """What stages share: the session, landed inputs by stage, and how events are ordered."""

    spark: SparkSession
    inputs: Mapping[str, object] = field(default_factory=dict)
    base_dir: str = "."
    event_time: Callable[[DataFrame], Column] | None = None
    #: Whether the events have times of their own, which the source stage finds out.
    timed: bool = True
    #: Lazy side results by name; none is computed unless it is read.
    reports: dict[str, DataFrame] = field(default_factory=dict)
    #: In a stream: what the stages with a memory keep from batch to batch
    #: (:class:`sloflow.streaming.staged.Memory`), else None.
    memory: object | None = None
    #: Observations by name, where the run itself counts, else None.
    watched: dict[str, Observation] | None = None

    def counted(self, df: DataFrame, name: str, counts: Mapping[str, Column]) -> DataFrame:
        """``df``, whose rows are counted as a lazy report, or as they flow by in the run."""
        if self.watched is None:
            self.reports[name] = quality.count_events(df, counts)
            return df
        seen, self.watched[name] = quality.observed(df, name, counts)
        return seen

    def path(self, name: str) -> str:
        return name if "://" in name or os.path.isabs(name) else os.path.join(self.base_dir, name)

    @property
    def order(self) -> tuple[str, ...]:
        return ("event_time", "event_id") if self.event_time else ("event_id",)

    @property
    def chunk(self) -> Column:
        """Cut keys by time if events have one, else by a million row numbers."""
        if self.event_time:
            return time_chunk(F.col("event_time"))
        return F.shiftright("event_id", 20)

    def identified(self, df: DataFrame) -> DataFrame:
        """Add the columns that every raw event has and the source did not give."""
        if "event_id" not in df.columns:
            df = df.withColumn("event_id", F.monotonically_increasing_id())
        if self.event_time:
            df = df.withColumn("event_time", self.event_time(df))
        elif "event_time" not in df.columns:
            self.timed = False
            df = df.withColumn("event_time", F.lit(datetime.now(timezone.utc)))
        if "classification" not in df.columns:
            df = df.withColumn("classification", F.lit(None).cast(CLASSIFICATION))
        return df.select(
            "event_id", "event_time", strmap.or_empty(F.col("metadata")).alias("metadata"), "classification", "quantity"
        )


class Settings:
    """Settings of one stage; remembers which names the stage knows."""

    def __init__(self, stage: str, values: Mapping | None):
        self.stage = stage
        self.values = {str(k).lower(): v for k, v in (values or {}).items()}
        self.known: set[str] = set()

    def get(self, name: str, default=None):
        self.known.add(name.lower())
        value = self.values.get(name.lower(), default)
        return default if value is None or value == "" and default is not None else value

    def need(self, name: str):
        value = self.get(name)
        if value in (None, ""):
            raise ConfigError([f"{self.stage}: setting {name} is missing"])
        return value

    def flag(self, name: str, default: bool) -> bool:
        value = self.get(name, default)
        return value if isinstance(value, bool) else str(value).lower() in ("true", "yes", "on", "1")

    def seconds(self, name: str, default: str) -> int:
        return parse_duration_ns(str(self.get(name, default))) // 1_000_000_000

    def ignore(self, *names: str):
        """Settings that only make sense for a long-running service."""
        self.known.update(name.lower() for name in names)

    def done(self):
        unknown = set(self.values) - self.known
        if unknown:
            raise ConfigError([f"{self.stage}: unknown settings {sorted(unknown)}"])


Build = Callable[[DataFrame | None, Settings, Context], DataFrame]


@dataclass(frozen=True)
class Stage:
    takes: str
    gives: str
    build: Build


STAGES: dict[str, Stage] = {}


def stage(name: str, takes: str, gives: str):
    """Register a stage; use it to add your own."""

    def add(build: Build) -> Build:
        STAGES[name] = Stage(takes, gives, build)
        return build

    return add


@stage("tailer", NOTHING, RAW)
def _log_lines(_, settings: Settings, context: Context) -> DataFrame:
    path = settings.get("tailedFile")
    line_re = settings.need("loglineParseRegexp")
    empty_re = settings.get("emptyGroupRE", "^$")
    settings.ignore("follow", "reopen", "positionFile", "positionPersistenceInterval")
    lines = context.inputs.get("tailer")
    if lines is None:
        if not path:
            raise ConfigError(["tailer: setting tailedFile is missing"])
        lines = loglines.read_log_lines(context.spark, context.path(path)).withColumnRenamed("seq", "event_id")
    parsed = loglines.parse_log_lines(lines, line_re, empty_re)
    parsed = context.counted(parsed, "lines", {"lines_read": F.lit(True), "malformed": F.col("malformed")})
    return context.identified(loglines.well_formed(parsed))


@stage("kafkaIngester", NOTHING, RAW)
def _messages(_, settings: Settings, context: Context) -> DataFrame:
    brokers, topic = settings.get("brokers", []), settings.get("topic", "")
    group, start = settings.get("groupID", ""), settings.get("fallbackStartOffset", "FirstOffset")
    header = settings.get("schemaVersionHeader", "schema-version")
    settings.ignore("logKafkaEvents", "logKafkaErrors", "commitInterval", "retentionTime")
    landed = context.inputs.get("kafkaIngester")
    if landed is None:
        landed = messages.read_kafka(
            context.spark, stream=False, brokers=brokers, topic=topic, group_id=group, start=start
        )
    elif start not in messages.START_OFFSETS:
        raise ConfigError([f"kafkaIngester: unknown fallbackStartOffset {start!r}"])
    decoded = messages.decode_messages(landed, header)
    decoded = context.counted(decoded, "messages", {"messages_read": F.lit(True), "malformed": F.col("malformed")})
    return context.identified(loglines.well_formed(decoded))


@stage("envoyAccessLogServer", NOTHING, RAW)
def _access_logs(_, settings: Settings, context: Context) -> DataFrame:
    settings.ignore("address", "gracefulShutdownTimeout")
    landed = context.inputs.get("envoyAccessLogServer")
    if landed is None:
        raise ConfigError(["envoyAccessLogServer: pass the landed log records as an input"])
    flat = accesslog.explode_log_batches(landed)
    return context.identified(flat.drop("event_id"))


GROWTH = {"counter_increase": counter_events, "histogram_increase": histogram_events}


def _grown(make, interval: int, staleness: int, drop, add, as_quantity: bool, samples: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    return make(samples, interval, staleness, drop, add, as_quantity, earlier)


@stage("prometheusIngester", NOTHING, RAW)
def _samples(_, settings: Settings, context: Context) -> DataFrame:
    queries = settings.need("queries")
    staleness = settings.seconds("staleness", f"{STALENESS}s") or STALENESS
    settings.ignore("apiUrl", "httpHeaders", "queryTimeout")
    landed = context.inputs.get("prometheusIngester") or {}
    union = None
    for config in queries:
        query = Settings("prometheusIngester query", config)
        text, kind = query.need("query"), query.need("type")
        interval, offset = query.seconds("interval", "1m"), query.seconds("offset", "0s")
        drop, add = query.get("dropLabels", []), query.get("additionalLabels", {})
        as_quantity = query.flag("resultAsQuantity", kind != "simple")
        query.done()
        if text not in landed:
            raise ConfigError([f"prometheusIngester: no samples given for query {text!r}"])
        if kind == "simple":
            events = shape.samples_to_events(landed[text], drop, add, as_quantity)
        elif kind in GROWTH:
            grown = partial(_grown, GROWTH[kind], interval, staleness, drop, add, as_quantity)
            events = grown(landed[text]) if context.memory is None else context.memory.increased(landed[text], grown, staleness + interval)
        else:
            raise ConfigError([f"prometheusIngester: unknown query type {kind!r}"])
        events = shift(events.withColumnRenamed("event_time", "ts"), offset).withColumnRenamed("ts", "event_time")
        union = events if union is None else union.unionByName(events)
    return context.identified(union)


@stage("eventMetadataRenamer", RAW, RAW)
def _rename(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    pairs = []
    for item in settings.get("eventMetadataRenamerConfigs", []):
        pair = Settings("eventMetadataRenamer", item)
        pairs.append((pair.need("source"), pair.need("destination")))
        pair.done()
    renamed = shape.rename_keys(df, pairs, collisions="__collisions")
    return context.counted(renamed, "rename_collisions", {"collisions": F.col("__collisions")}).drop("__collisions")


@stage("relabel", RAW, RAW)
def _relabel(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    return relabel(df, [RelabelStep.from_config(c) for c in settings.get("eventRelabelConfigs", [])])


@stage("eventKeyGenerator", RAW, RAW)
def _event_key(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    return shape.generate_event_key(
        df,
        settings.get("metadataKeys", []),
        # the setting is spelled like this
        settings.get("filedSeparator", ":"),
        settings.flag("overrideExistingEventKey", True),
    )


@stage("metadataClassifier", RAW, RAW)
def _own_class(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    return shape.classify_from_metadata(
        df,
        settings.need("sloDomainMetadataKey"),
        settings.need("sloClassMetadataKey"),
        settings.need("sloAppMetadataKey"),
        settings.flag("overrideExistingValues", True),
    )


@stage("dynamicClassifier", RAW, RAW)
def _dynamic(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    reported = settings.get("unclassifiedEventMetadataKeys", [])
    exact = read_matchers([context.path(p) for p in settings.get("exactMatchesCsvFiles", [])])
    regexp = read_matchers([context.path(p) for p in settings.get("regexpMatchesCsvFiles", [])])
    table = matchers_df(context.spark, exact) if exact else None
    classify = classify_dynamic if context.memory is None else context.memory.classified
    found = classify(df, table, regexp, context.order, context.chunk)
    context.reports["classification"] = classification_report(found, reported)
    return found.drop("event_key", "classified_by")


@stage("statisticalClassifier", RAW, RAW)
def _statistical(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    defaults = []
    for item in settings.get("defaultWeights", []):
        weight = Settings("statisticalClassifier", item)
        target = Settings("statisticalClassifier", weight.get("classification", {}))
        defaults.append(
            (target.get("sloDomain", ""), target.get("sloClass", ""), parse_float(weight.get("weight", "0")))
        )
        weight.done()
        target.done()
    window = settings.seconds("historyWindowSize", "30m")
    interval = settings.seconds("historyWeightUpdateInterval", "1m")
    if not context.timed and not defaults:
        raise ConfigError(["statisticalClassifier: events without event times have no history, and there are no defaultWeights"])
    if context.memory is not None and context.timed:
        found = context.memory.weighed(df, window, interval, defaults)
    else:
        found = classify_statistical(df, window, interval, defaults, history=context.timed)
    context.reports["statistical"] = found.groupBy("statistical_result").agg(F.count("*").alias("events"))
    return found.drop("statistical_result")


@stage("sloEventProducer", RAW, SLO)
def _rules(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    rules = load_rules([context.path(p) for p in settings.get("rulesFiles", [])])
    if settings.flag("exposeRulesAsMetrics", False):
        context.reports["rule_thresholds"] = rules_to_thresholds(context.spark, rules)
    df = context.counted(df, "rules", quality.standard_counts(rules))
    return evaluate_rules(df, rules)


@stage("prometheusExporter", SLO, COUNTERS)
def _counters(df: DataFrame, settings: Settings, context: Context) -> DataFrame:
    names = Settings("prometheusExporter labelNames", settings.get("labelNames", {}))
    defaults = counters.DEFAULT_NAMES
    labels = counters.LabelNames(
        names.get("result", defaults.result),
        names.get("sloDomain", defaults.domain),
        names.get("sloClass", defaults.class_),
        names.get("sloApp", defaults.app),
        names.get("eventKey", defaults.key),
    )
    names.done()
    limit = int(settings.get("maximumUniqueEventKeys", 0))
    placeholder = settings.get("exceededKeyLimitPlaceholder", counters.EXCEEDED_PLACEHOLDER)
    invalid = ~F.coalesce(F.col("result").isin(*shape.RESULTS), F.lit(False))
    valid = shape.valid_result(context.counted(df, "results", {"slo_events": F.lit(True), "invalid_results": invalid}))
    context.reports["event_keys"] = counters.event_key_stats(valid, limit)
    metric, exemplar_keys = settings.get("metricName", "slo_events_total"), settings.get("exemplarMetadataKeys", [])
    if context.memory is not None:
        return context.memory.counted(valid, labels, limit, placeholder, exemplar_keys, (*context.order, "rule"), metric)
    return counters.capped_counters(
        valid,
        limit,
        placeholder,
        metric,
        labels,
        exemplar_keys,
        context.order,
        (*context.order, "rule"),
    )


@dataclass(frozen=True)
class Pipeline:
    """Checked stages in order, with their settings."""

    stages: tuple[tuple[str, Mapping], ...]

    def __post_init__(self):
        errors = []
        kind = NOTHING
        for name, _ in self.stages:
            if name not in STAGES:
                errors.append(f"unknown stage {name!r}, use one of {sorted(STAGES)}")
                continue
            if STAGES[name].takes != kind:
                errors.append(f"stage {name!r} takes {STAGES[name].takes}, but gets {kind}")
            kind = STAGES[name].gives
        if errors:
            raise ConfigError(errors)

    @classmethod
    def parse(cls, text: str) -> Pipeline:
        top = Settings("configuration", read_yaml(text))
        names = top.need("pipeline")
        modules = top.get("modules", {})
        top.ignore("logLevel", "webServerListenAddress", "maximumGracefulShutdownDuration", "afterPipelineShutdownDelay")
        top.done()
        by_name = {str(key).lower(): value for key, value in modules.items()}
        missing = [name for name in names if name.lower() not in by_name]
        if missing:
            raise ConfigError([f"missing settings of stage {name!r}" for name in missing])
        return cls(tuple((name, by_name[name.lower()] or {}) for name in names))

    def run(self, context: Context) -> DataFrame:
        """The lazy result of the last stage."""
        df = None
        for name, values in self.stages:
            settings = Settings(name, values)
            df = STAGES[name].build(df, settings, context)
            settings.done()
            if STAGES[name].gives == RAW:
                df = context.counted(df, f"events after {name}", {"events": F.lit(True)})
        return df


def run_pipeline(
    spark: SparkSession,
    text: str,
    inputs: Mapping[str, object] | None = None,
    base_dir: str = ".",
    event_time: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """Run a YAML configuration.

    ``inputs`` gives landed data by source stage (for ``prometheusIngester`` a mapping from query
    text to samples).  ``event_time`` computes the time of an event; without it events are ordered
    as they are read, and the statistical classifier has no history, only its default weights.
    """
    return run_with_reports(spark, text, inputs, base_dir, event_time)[0]


def run_with_reports(
    spark: SparkSession,
    text: str,
    inputs: Mapping[str, object] | None = None,
    base_dir: str = ".",
    event_time: Callable[[DataFrame], Column] | None = None,
) -> tuple[DataFrame, Mapping[str, DataFrame]]:
    """The result of a run and its reports by name, each a lazy DataFrame.

    Reports say what became of the events: lines or messages read and malformed, events after every
    stage (what relabelling drops is the difference), collisions of renamed keys, classified and
    unclassified events, events that match no rule, invalid results, event keys beside their limit, and
    with ``exposeRulesAsMetrics`` the thresholds of the rules.
    """
    context = Context(spark, inputs or {}, base_dir, event_time)
    return Pipeline.parse(text).run(context), context.reports


def run_counted(
    spark: SparkSession,
    text: str,
    sink: Callable[[DataFrame], object],
    inputs: Mapping[str, object] | None = None,
    base_dir: str = ".",
    event_time: Callable[[DataFrame], Column] | None = None,
) -> tuple[dict[str, dict[str, int]], Mapping[str, DataFrame]]:
    """Run a configuration into ``sink``, which writes or collects the result once, and count on the way.

    Returns the counts of :func:`run_with_reports` by report and name, from that one run, and the reports that
    are no plain counts (by class, by key, thresholds) as lazy DataFrames.
    """
    context = Context(spark, inputs or {}, base_dir, event_time, watched={})
    sink(Pipeline.parse(text).run(context))
    return {name: dict(seen.get) for name, seen in context.watched.items()}, context.reports


def stage_names() -> Sequence[str]:
    return sorted(STAGES)
