"""Counters at several levels of detail, their limits, exemplars and text form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.text import number_text
from sloflow.operators.shape import RESULTS
from sloflow.session import materialize

EXCEEDED_PLACEHOLDER = "cardinalityLimitExceeded"  # fixed value
MAX_EXEMPLAR_RUNES = 128  # fixed value


@dataclass(frozen=True)
class LabelNames:
    result: str = "result"
    domain: str = "slo_domain"
    class_: str = "slo_class"
    app: str = "slo_app"
    key: str = "event_key"

    @property
    def levels(self) -> tuple[str, str, str, str]:
        return (self.domain, self.class_, self.app, self.key)


DEFAULT_NAMES = LabelNames()


def level_metric_name(labels: Sequence[str], base: str = "slo_events_total") -> str:
    return "_".join(labels) + ":" + base


def slo_labels(names: LabelNames = DEFAULT_NAMES, capped: bool = False) -> Column:
    """All labels of an SLO event; the rule's own labels win over the common ones.

    ``capped`` says that ``event_key`` may already be the placeholder, which wins over everything.
    """
    core = F.create_map(
        F.lit(names.result),
        F.col("result"),
        F.lit(names.domain),
        F.col("slo_domain"),
        F.lit(names.class_),
        F.col("slo_class"),
        F.lit(names.app),
        F.col("slo_app"),
        F.lit(names.key),
        F.col("event_key"),
    )
    merged = strmap.merge(core, F.col("labels"))
    if capped:
        merged = F.when(
            F.col("key_capped"), F.map_concat(merged, F.create_map(F.lit(names.key), F.col("event_key")))
        ).otherwise(merged)
    return F.map_concat(merged, F.create_map(F.lit(names.result), F.col("result")))


def cap_event_keys(
    df: DataFrame,
    limit: int,
    placeholder: str = EXCEEDED_PLACEHOLDER,
    order: Sequence[str] = ("event_time", "event_id", "rule"),
    admitted: DataFrame | None = None,
) -> DataFrame:
    """Keep the first ``limit`` distinct event keys and replace all later new ones.

    The first occurrences are found by a partial aggregation and a distributed top-n.  The at most
    ``limit`` admitted keys are joined back; Spark broadcasts them if their bytes allow it.  0 means no
    limit.  Where only counters are wanted, :func:`capped_counters` reads the events once.
    """
    if not limit:
        return df.withColumn("key_capped", F.lit(False))
    if admitted is None:
        admitted = admitted_keys(df, limit, order)
    table = admitted.select(F.col("event_key").alias("__key"), F.lit(True).alias("__ok"))
    return (
        df.join(table, F.col("event_key") == F.col("__key"), "left")
        .withColumns(
            {
                "key_capped": F.col("__ok").isNull(),
                "event_key": F.when(F.col("__ok"), F.col("event_key")).otherwise(placeholder),
            }
        )
        .drop("__key", "__ok")
    )


def admitted_keys(df: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("first_seen")
    return df.groupBy("event_key").agg(first).orderBy("first_seen").limit(limit)


def event_key_stats(df: DataFrame, limit: int) -> DataFrame:
    """Number of known event keys (never above a limit) beside the limit."""
    distinct = F.count_distinct("event_key")
    known = F.least(distinct, F.lit(limit)) if limit else distinct
    return df.agg(known.alias("event_keys"), F.lit(limit).cast("bigint").alias("event_keys_limit"))


def finest_counters(
    df: DataFrame,
    names: LabelNames = DEFAULT_NAMES,
    exemplar_keys: Sequence[str] = (),
    order: Sequence[str] = ("event_time", "event_id"),
    first: Sequence[str] = (),
) -> DataFrame:
    """One row per label set of the finest level, with the sums of both results side by side.

    Putting the results side by side is the zero initialisation: a label set seen with one result
    has the other one at 0.  With ``first`` there is one row per label set and event key, with the
    key and the smallest position by these columns (``__key``, ``__first``).
    """
    labels = slo_labels(names, capped="key_capped" in df.columns)
    staged = df.filter(F.col("result").isin(*RESULTS)).withColumn("__labels", labels)
    levels = [strmap.lookup(F.col("__labels"), name).alias(name) for name in names.levels]
    extra = strmap.without(F.col("__labels"), [*names.levels, names.result]).alias("extra")
    sums = [
        F.sum(F.when(F.col("result") == result, F.col("quantity")).otherwise(0.0)).alias(result)
        for result in RESULTS
    ]
    if exemplar_keys:
        chosen = strmap.select(F.col("metadata"), exemplar_keys)
        runes = F.aggregate(
            F.map_entries(chosen),
            F.lit(0),
            lambda total, e: total + F.length(e["key"]) + F.length(e["value"]),
        )
        valid = (F.size(chosen) > 0) & (runes <= MAX_EXEMPLAR_RUNES)
        position = F.struct(*[F.col(c) for c in order])
        for result in RESULTS:
            when = F.when(valid & (F.col("result") == result), position)
            exemplar = F.struct(
                position.alias("at"), F.col("quantity").alias("value"), strmap.text(chosen).alias("labels")
            )
            sums.append(F.max_by(exemplar, when).alias(f"{result}_exemplar"))
    by = [*levels, extra]
    if first:
        by.append(F.col("event_key").alias("__key"))
        sums.append(F.min(F.struct(*[F.col(c) for c in first])).alias("__first"))
    return staged.groupBy(*by).agg(*sums)


def cascade_counters(
    df: DataFrame,
    base: str = "slo_events_total",
    names: LabelNames = DEFAULT_NAMES,
    exemplar_keys: Sequence[str] = (),
    order: Sequence[str] = ("event_time", "event_id"),
) -> DataFrame:
    """Sums of the quantity at four label levels: ``(metric, level, labels, value[, exemplar])``.

    Raw rows are aggregated once at the finest level.  The coarser levels are grouping sets over
    that much smaller result.
    """
    return cascade_levels(finest_counters(df, names, exemplar_keys, order), base, names)


def capped_counters(
    df: DataFrame,
    limit: int,
    placeholder: str = EXCEEDED_PLACEHOLDER,
    base: str = "slo_events_total",
    names: LabelNames = DEFAULT_NAMES,
    exemplar_keys: Sequence[str] = (),
    order: Sequence[str] = ("event_time", "event_id"),
    first: Sequence[str] = ("event_time", "event_id", "rule"),
) -> DataFrame:
    """:func:`cascade_counters` of the events with a limit on event keys, as :func:`cap_event_keys` sets it.

    The limit only renames a label, so it is applied to the aggregated rows: the events are read and
    shuffled once.  The rows of the finest level are written to the shared folder, as the admitted keys
    are found among them and joined back to them.  0 means no limit.
    """
    if not limit:
        return cascade_counters(df, base, names, exemplar_keys, order)
    finest = materialize(finest_counters(df, names, exemplar_keys, order, first), "finest")
    seen = finest.groupBy("__key").agg(F.min("__first").alias("__first"))
    admitted = seen.orderBy("__first").limit(limit).select(F.col("__key").alias("__admitted"))
    named = F.when(F.col("__admitted").isNotNull(), F.col(f"`{names.key}`")).otherwise(placeholder)
    capped = finest.join(admitted, F.col("__key") == F.col("__admitted"), "left").withColumn(names.key, named)
    return cascade_levels(capped.drop("__key", "__first", "__admitted"), base, names)


def cascade_levels(
    finest: DataFrame, base: str = "slo_events_total", names: LabelNames = DEFAULT_NAMES
) -> DataFrame:
    """All four levels from the rows of :func:`finest_counters`."""
    exemplar_keys = f"{RESULTS[0]}_exemplar" in finest.columns
    levels = list(names.levels)
    sets = [[F.col("extra"), *[F.col(c) for c in levels[: n + 1]]] for n in range(len(levels))]
    sums = [F.sum(result).alias(result) for result in RESULTS]
    if exemplar_keys:
        for result in RESULTS:
            name = f"{result}_exemplar"
            sums.append(F.max_by(name, F.col(f"{name}.at")).alias(name))
    depth = sum((1 - F.grouping(c) for c in levels[1:]), 1 - F.grouping(levels[0]))
    grouped = finest.groupingSets(sets, F.col("extra"), *[F.col(c) for c in levels]).agg(
        depth.alias("level"), *sums
    )
    metrics = F.array(*[F.lit(level_metric_name(levels[: n + 1], base)) for n in range(len(levels))])
    both = F.array(
        *[
            F.struct(
                F.lit(result).alias("result"),
                F.col(result).alias("value"),
                *([F.col(f"{result}_exemplar").alias("exemplar")] if exemplar_keys else []),
            )
            for result in RESULTS
        ]
    )
    exploded = grouped.withColumn("__row", F.explode(both))
    identity = strmap.from_columns(
        {names.result: F.col("__row.result"), **{c: F.col(c) for c in levels}}
    )
    columns = [
        F.element_at(metrics, F.col("level").cast("int")).alias("metric"),
        F.col("level").cast("int").alias("level"),
        strmap.merge(F.col("extra"), identity).alias("labels"),
        F.col("__row.value").alias("value"),
    ]
    if exemplar_keys:
        columns.append(F.col("__row.exemplar").alias("exemplar"))
    return exploded.select(*columns)


def densify_results(df: DataFrame, by: Sequence[str], quantity: str = "quantity") -> DataFrame:
    """Sum per label set and result, with a 0 for a result that did not occur."""
    sums = [
        F.sum(F.when(F.col("result") == r, F.col(quantity)).otherwise(0.0)).alias(r) for r in RESULTS
    ]
    wide = df.filter(F.col("result").isin(*RESULTS)).groupBy(*by).agg(*sums)
    return wide.unpivot(list(by), list(RESULTS), "result", "value")


def to_exposition(counters: DataFrame) -> DataFrame:
    """Text lines ``name{label="value",...} number`` with sorted labels."""

    def escaped(value: Column) -> Column:
        value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
        value = F.replace(value, F.lit('"'), F.lit('\\"'))
        return F.replace(value, F.lit("\n"), F.lit("\\n"))

    labels = strmap.text(F.transform_values("labels", lambda _, value: escaped(value)))
    return counters.select(
        F.concat(
            F.col("metric"),
            F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""),
            F.lit(" "),
            number_text(F.col("value")),
        ).alias("value")
    )


def write_counters(counters: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the counters, one folder per level."""
    counters.write.mode(mode).partitionBy("level").parquet(path)
