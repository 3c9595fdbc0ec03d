"""Declarative runs on streams.

A micro-batch goes through the whole chain of stages.  Stretches of stages without a memory stay one plan;
a stage with a memory (growth of samples, learned classes, class weights, counters) ends such a stretch: it
reads from its own state what earlier batches left, writes its rows to a folder of the batch, and the next
stretch starts from there.  Everything is named after the batch, so a repeated batch overwrites its own
folders, and one checkpoint holds the place in the source.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sloflow.operators import counters
from sloflow.operators.rules import ConfigError
from sloflow.plans.stages import COUNTERS, STAGES, Context, Pipeline, Settings
from sloflow.session import SAMPLE
from sloflow.sources import loglines, messages
from sloflow.streaming import jobs
from sloflow.streaming.state import StateTable

QUERY = "__query"


@dataclass
class Memory:
    """The states of the stages of one stream, as one micro-batch sees them; each stage has a folder."""

    path: str
    number: int
    stages: int = 0

    def _folder(self, kind: str) -> str:
        self.stages += 1
        return f"{self.path}/{self.stages}-{kind}"

    def increased(self, samples: DataFrame, events: Callable, seconds: int) -> DataFrame:
        return jobs.increase_batch(samples, self.number, self._folder("increase"), events, seconds + 10 * jobs.MINUTE)

    def classified(self, df: DataFrame, exact, regexp, order: Sequence[str], chunk: Column) -> DataFrame:
        return jobs.classify_batch(df, self.number, self._folder("learned"), exact, regexp, order, chunk)

    def weighed(self, df: DataFrame, window: int, interval: int, defaults) -> DataFrame:
        return jobs.weigh_batch(df, self.number, self._folder("weights"), window, interval, defaults)

    def counted(self, df, names, limit: int, placeholder: str, exemplar_keys, order: Sequence[str], metric: str) -> DataFrame:
        # The counters are the last stage, and a stream has one of them.
        folder = f"{self.path}/counted"
        jobs.count_batch(df, self.number, folder, names, limit, placeholder, exemplar_keys, order)
        return jobs.read_counters(df.sparkSession, folder, metric, names, bool(exemplar_keys))


_NEXT = T.StructType([T.StructField("next", T.LongType())])


def _numbered(batch: DataFrame, number: int, path: str) -> DataFrame:
    """The batch with ``event_id`` in the order of reading, above those of all batches before it."""
    spark, state = batch.sparkSession, StateTable(f"{path}/numbers", _NEXT)
    before = state.read(spark, number).first()
    start = before["next"] if before else 0
    rows = batch.withColumn("event_id", F.monotonically_increasing_id() + F.lit(start))
    landed = StateTable(f"{path}/landed", rows.schema)
    landed.write(rows, number)
    written = landed.read(spark, number + 1)
    newest = written.agg(F.max("event_id")).first()[0]
    state.write(spark.createDataFrame([(start if newest is None else newest + 1,)], _NEXT), number)
    return written


def _source(spark: SparkSession, name: str, values: Mapping, inputs: Mapping[str, object], context: Context) -> DataFrame:
    """The stream that the source stage reads: the given one, or the one that its settings name."""
    given = inputs.get(name)
    if isinstance(given, Mapping):
        tagged = [rows.select(*SAMPLE.names).withColumn(QUERY, F.lit(text)) for text, rows in given.items()]
        if not tagged:
            raise ConfigError([f"{name}: no samples given"])
        return reduce(DataFrame.unionByName, tagged)
    if given is not None:
        return given
    settings = Settings(name, values)
    if name == "tailer":
        return loglines.read_log_stream(spark, context.path(settings.need("tailedFile")))
    if name == "kafkaIngester":
        brokers, topic = settings.get("brokers", []), settings.get("topic", "")
        group, start = settings.get("groupID", ""), settings.get("fallbackStartOffset", "FirstOffset")
        return messages.read_kafka(spark, stream=True, brokers=brokers, topic=topic, group_id=group, start=start)
    raise ConfigError([f"{name}: pass the landed rows as an input"])


def stream_pipeline(
    spark: SparkSession,
    text: str,
    path: str,
    inputs: Mapping[str, object] | None = None,
    base_dir: str = ".",
    event_time: Callable[[DataFrame], Column] | None = None,
    available_now: bool | None = None,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Run a YAML configuration as a stream whose state, output and checkpoint are in ``path``.

    ``inputs`` gives streaming DataFrames as :func:`~sloflow.plans.stages.run_pipeline` takes landed ones; without
    them log lines and Kafka messages are read as their stages say.  Rows without ``event_id`` are numbered as they
    are read.  The query stops once the source is drained if ``available_now``, or, where that is None, if the
    tailer is told not to ``follow``; else it runs on.  Samples keep their labels only (no ``event_id``).

    Events go to ``path/events``, see :func:`read_staged`; a chain that ends in counters keeps those instead.
    """
    chain, inputs = Pipeline.parse(text), inputs or {}
    if not chain.stages:
        raise ConfigError(["pipeline: no stages"])
    name, values = chain.stages[0]
    stream = _source(spark, name, values, inputs, Context(spark, base_dir=base_dir))
    if available_now is None:
        available_now = name == "tailer" and not Settings(name, values).flag("follow", True)
    is_counted = STAGES[chain.stages[-1][0]].gives == COUNTERS

    def each(batch: DataFrame, number: int) -> None:
        landed: object = batch
        if QUERY in batch.columns:
            texts = inputs[name].keys()
            landed = {text: batch.filter(F.col(QUERY) == text).drop(QUERY) for text in texts}
        elif "event_id" not in batch.columns and name != "envoyAccessLogServer":
            landed = _numbered(batch, number, path)
        context = Context(batch.sparkSession, {name: landed}, base_dir, event_time, memory=Memory(path, number))
        done = chain.run(context)
        if not is_counted:
            jobs.written_batch(_with_ids(done, number), f"{path}/events", number)

    return jobs.run(stream, each, f"{path}/checkpoint", available_now=available_now, interval=interval)


def _with_ids(done: DataFrame, number: int) -> DataFrame:
    return done.withColumn("batch_id", F.lit(number).cast("long"))


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """The events of a stream so far, with the ``batch_id`` that they came in."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/events")


def read_counted(
    spark: SparkSession,
    path: str,
    metric: str = "slo_events_total",
    names: counters.LabelNames = counters.DEFAULT_NAMES,
    exemplars: bool = False,
) -> DataFrame:
    """The counters of a stream so far, as :func:`~sloflow.streaming.jobs.read_counters` gives them."""
    return jobs.read_counters(spark, f"{path}/counted", metric, names, exemplars)
