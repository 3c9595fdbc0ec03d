"""Kafka-shaped messages to raw events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import computed

SCHEMA_VERSION = "v1"
# Names of the start positions and what Spark calls them.
START_OFFSETS = {"FirstOffset": "earliest", "LastOffset": "latest"}


def kafka_options(
    brokers: Sequence[str], topic: str, group_id: str = "", start: str = "FirstOffset"
) -> dict[str, str]:
    """Options of Spark's Kafka reader; committed offsets live in the query's checkpoint."""
    if not brokers or not topic:
        raise ValueError("brokers and topic are required")
    if start not in START_OFFSETS:
        raise ValueError(f"unknown start offset {start!r}, use one of {sorted(START_OFFSETS)}")
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "startingOffsets": START_OFFSETS[start],
        "includeHeaders": "true",
    }
    if group_id:
        options["kafka.group.id"] = group_id
    return options


def read_kafka(spark: SparkSession, stream: bool = True, **options) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**kafka_options(**options)).load()


def _field(fields: Column, name: str) -> Column:
    """A field by exact name, else by name in any letter case."""
    similar = F.map_values(F.map_filter(fields, lambda key, _: F.lower(key) == name))
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.get(similar, 0))


def _kind(variant: Column) -> Column:
    """``STRING``, ``VOID``, ``OBJECT<...>``, ...; NULL for an absent field."""
    return F.schema_of_variant(variant)


def _fields(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "map<string,variant>")


def _is_absent(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def _is_object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def decode_messages(df: DataFrame, version_header: str = "schema-version") -> DataFrame:
    """Decode ``(value, headers)`` into ``metadata``, ``classification``, ``quantity``, ``malformed``.

    The value is one JSON object ``{metadata, quantity, slo_classification}`` and nothing else.
    Pass the header name your producers use for the schema version; the first such header counts,
    and a message without it is read as version ``v1``.
    """
    body = F.col("value").cast("string")
    version = F.get(F.filter("headers", lambda h: h["key"] == version_header), 0)["value"]
    known = F.coalesce(version.cast("string"), F.lit(SCHEMA_VERSION)) == SCHEMA_VERSION
    # Text after the JSON value would go unnoticed.  It cannot fit both an enclosing list and an
    # enclosing object.
    in_list = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"value":'), body, F.lit("}")))
    single = (
        in_object.isNotNull()
        & F.try_variant_get(in_list, "$[0]", "variant").isNotNull()
        & F.try_variant_get(in_list, "$[1]", "variant").isNull()
    )
    staged = df.withColumn(
        "__document",
        F.when(known & single, F.try_variant_get(in_list, "$[0]", "variant")),
    )
    document = F.col("__document")
    staged = staged.withColumn("__top", _fields(document))
    top = F.col("__top")
    staged = staged.withColumns(
        {
            "__metadata": _field(top, "metadata"),
            "__quantity": _field(top, "quantity"),
            "__class": _fields(_field(top, "slo_classification")),
            "__class_kind": _kind(_field(top, "slo_classification")),
        }
    )
    staged = staged.withColumns(
        {
            "__metadata": _fields(F.col("__metadata")),
            "__metadata_kind": _kind(F.col("__metadata")),
            "__quantity_kind": _kind(F.col("__quantity")),
            "__quantity": F.try_variant_get("__quantity", "$", "double"),
            "__domain": _field(F.col("__class"), "domain"),
            "__app": _field(F.col("__class"), "app"),
            "__cls": _field(F.col("__class"), "class"),
        }
    )

    def textual(variant: Column) -> Column:
        kind = _kind(variant)
        return _is_absent(kind) | (kind == "STRING")

    document_kind = _kind(document)
    quantity = F.col("__quantity")
    quantity_kind = F.col("__quantity_kind")
    numeric = F.coalesce(
        quantity_kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        & ~quantity.isin(float("inf"), float("-inf")),
        F.lit(False),
    )
    good_metadata = _is_absent(F.col("__metadata_kind")) | (
        _is_object(F.col("__metadata_kind"))
        & F.forall(F.map_values("__metadata"), textual)
    )
    good_class = _is_absent(F.col("__class_kind")) | (
        _is_object(F.col("__class_kind"))
        & textual(F.col("__domain"))
        & textual(F.col("__app"))
        & textual(F.col("__cls"))
    )
    good = F.coalesce(
        (document_kind == "VOID")
        | (
            _is_object(document_kind)
            & good_metadata
            & good_class
            & (_is_absent(quantity_kind) | numeric)
        ),
        F.lit(False),
    )

    def text_or_empty(variant: Column) -> Column:
        return F.coalesce(F.try_variant_get(variant, "$", "string"), F.lit(""))

    classification = F.when(
        _is_object(F.col("__class_kind")),
        F.struct(
            text_or_empty(F.col("__domain")).alias("domain"),
            text_or_empty(F.col("__app")).alias("app"),
            text_or_empty(F.col("__cls")).alias("class"),
        ),
    )
    metadata = F.transform_values("__metadata", lambda _, value: text_or_empty(value))
    temporary = [name for name in staged.columns if name.startswith("__")]
    columns = {
        "metadata": strmap.or_empty(metadata),
        "classification": classification,
        "quantity": F.coalesce(quantity, F.lit(1.0)),
    }
    checked = staged.withColumn("__good", good)
    return computed(
        checked,
        {name: F.when(F.col("__good"), column) for name, column in columns.items()}
        | {"malformed": ~F.col("__good")},
    ).drop(*temporary, "__good")
