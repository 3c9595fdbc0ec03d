"""Narrow steps on raw events: renaming, event keys, own classification, ingest labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import computed
from sloflow.functions.text import number_text

# Reserved metadata keys.
EVENT_KEY = "__eventKey"
RESULT_VALUE = "prometheusQueryResult"
RESULT_TIME = "unixTimestamp"
BUCKET_MIN = "prometheusHistogramMinValue"
BUCKET_MAX = "prometheusHistogramMaxValue"

RESULTS = ("success", "fail")


def event_key(metadata: Column | None = None) -> Column:
    """The event's key; an event without one has the empty key."""
    metadata = F.col("metadata") if metadata is None else metadata
    return F.coalesce(strmap.lookup(metadata, EVENT_KEY), F.lit(""))


def rename_keys(
    df: DataFrame, pairs: Iterable[tuple[str, str]], collisions: str | None = None
) -> DataFrame:
    """Rename metadata keys in order; an existing destination is never overwritten.

    ``collisions`` names a column that counts the refused renames.
    """
    refused = F.lit(0)
    for source, destination in pairs:
        metadata = F.col("metadata")
        value = strmap.lookup(metadata, source)
        taken = strmap.lookup(metadata, destination).isNotNull()
        if collisions:
            df = df.withColumn(
                collisions,
                (F.col(collisions) if collisions in df.columns else refused)
                + (value.isNotNull() & taken).cast("int"),
            )
        df = df.withColumn(
            "metadata",
            F.when(
                value.isNotNull() & ~taken,
                F.map_concat(
                    strmap.without(metadata, [source]), F.create_map(F.lit(destination), value)
                ),
            ).otherwise(metadata),
        )
    return df


def generate_event_key(
    df: DataFrame, keys: Sequence[str], separator: str = ":", override: bool = True
) -> DataFrame:
    """Join the values of the present keys; empty values count as present."""
    metadata = F.col("metadata")
    generated = F.concat_ws(separator, *[strmap.lookup(metadata, key) for key in keys])
    updated = strmap.with_key(metadata, EVENT_KEY, generated)
    if not override:
        updated = F.when(event_key() == "", updated).otherwise(metadata)
    return df.withColumn("metadata", updated)


def is_classified(classification: Column | None = None) -> Column:
    """True when domain, app and class are all set and not empty."""
    c = F.col("classification") if classification is None else classification
    return F.coalesce(
        c.isNotNull() & (c["domain"] != "") & (c["app"] != "") & (c["class"] != ""), F.lit(False)
    )


def classification(domain: Column, app: Column, class_: Column) -> Column:
    return F.struct(domain.alias("domain"), app.alias("app"), class_.alias("class"))


def classify_from_metadata(
    df: DataFrame, domain_key: str, class_key: str, app_key: str, override: bool = True
) -> DataFrame:
    """Take each part of the classification from its key.

    Without ``override`` only empty parts are filled, and classified events stay as they are.
    """
    current = F.col("classification")

    def part(name: str, key: str) -> Column:
        own = F.coalesce(current[name], F.lit(""))
        found = strmap.lookup(F.col("metadata"), key)
        if override:
            return F.coalesce(found, own)
        return F.when(own == "", F.coalesce(found, own)).otherwise(own)

    updated = classification(
        part("domain", domain_key), part("app", app_key), part("class", class_key)
    )
    if not override:
        updated = F.when(is_classified(), current).otherwise(updated)
    return df.withColumn("classification", updated)


def require_classified(df: DataFrame) -> DataFrame:
    return computed(df, {"__classified": is_classified()}).filter("__classified").drop("__classified")


def classification_matches(
    column: Column, domain: str = "", app: str = "", class_: str = ""
) -> Column:
    """Compare with a partly given classification; an empty part matches anything."""
    condition = F.lit(True)
    for name, value in (("domain", domain), ("app", app), ("class", class_)):
        if value:
            condition = condition & (column[name] == value)
    return F.coalesce(condition, F.lit(False))


def valid_result(df: DataFrame) -> DataFrame:
    return df.filter(F.col("result").isin(*RESULTS))


def adjust_labels(
    metadata: Column, drop: Sequence[str] = (), add: Mapping[str, str] | None = None
) -> Column:
    """Drop keys, then add keys; an added key stays even if it is also dropped."""
    kept = strmap.without(metadata, drop)
    return strmap.merge(kept, strmap.literal(add)) if add else kept


def sample_event(
    df: DataFrame,
    labels: Column,
    value: Column,
    ts: Column,
    result_as_quantity: bool,
    drop: Sequence[str] = (),
    add: Mapping[str, str] | None = None,
) -> DataFrame:
    """Turn a measured value into a raw event.

    The quantity is the value itself or 1; values below zero cannot be a quantity, and events of
    quantity 0 do not exist.
    """
    metadata = strmap.merge(
        labels,
        F.create_map(
            F.lit(RESULT_VALUE),
            number_text(value),
            F.lit(RESULT_TIME),
            F.floor(F.unix_micros(ts) / 1_000_000).cast("string"),
        ),
    )
    quantity = value if result_as_quantity else F.lit(1.0)
    kept = df.filter((value > 0) | F.isnan(value)) if result_as_quantity else df
    return kept.withColumns(
        {
            "event_time": ts,
            "metadata": adjust_labels(metadata, drop, add),
            "quantity": quantity,
            "result_value": value,
        }
    )


def samples_to_events(
    samples: DataFrame,
    drop: Sequence[str] = (),
    add: Mapping[str, str] | None = None,
    result_as_quantity: bool = False,
) -> DataFrame:
    """Each sample ``(labels, ts, value)`` becomes one raw event."""
    return sample_event(
        samples, F.col("labels"), F.col("value"), F.col("ts"), result_as_quantity, drop, add
    ).select("event_time", "metadata", "quantity", "result_value")
