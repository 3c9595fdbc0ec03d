"""Relabelling of event metadata: ordered steps that rewrite, copy or drop keys and events."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import computed
from sloflow.functions.regex import anchored, expand, matches

ACTIONS = ("replace", "keep", "drop", "hashmod", "labelmap", "labeldrop", "labelkeep")
_KEYS = {"source_labels", "separator", "regex", "modulus", "target_label", "replacement", "action"}
_LABEL_NAME = "^[a-zA-Z_][a-zA-Z0-9_]*\\z"


@dataclass(frozen=True)
class RelabelStep:
    """One step; the defaults copy the joined source labels into the target."""

    source_labels: tuple[str, ...] = field(default=())
    separator: str = ";"
    regex: str = "(.*)"
    modulus: int = 0
    target_label: str = ""
    replacement: str = "$1"
    action: str = "replace"

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown relabel action {self.action!r}, use one of {ACTIONS}")
        if self.action in ("replace", "hashmod") and not self.target_label:
            raise ValueError(f"relabel action {self.action!r} needs target_label")
        if self.action == "hashmod" and self.modulus <= 0:
            raise ValueError("relabel action 'hashmod' needs a modulus above zero")
        anchored(self.regex)

    @classmethod
    def from_config(cls, config: Mapping) -> RelabelStep:
        unknown = set(config) - _KEYS
        if unknown:
            raise ValueError(f"unknown relabel settings: {sorted(unknown)}")
        values = dict(config)
        if "source_labels" in values:
            values["source_labels"] = tuple(values["source_labels"])
        if "modulus" in values:
            values["modulus"] = int(values["modulus"])
        if "action" in values:
            values["action"] = str(values["action"]).lower()
        for name in ("regex", "replacement", "separator", "target_label"):
            if name in values:
                values[name] = str(values[name])
        return cls(**values)


def _source(step: RelabelStep, metadata: Column) -> Column:
    if not step.source_labels:
        return F.lit("")
    return F.concat_ws(
        step.separator,
        *[F.coalesce(strmap.lookup(metadata, name), F.lit("")) for name in step.source_labels],
    )


def _replace(step: RelabelStep, metadata: Column, source: Column) -> Column:
    pattern = anchored(step.regex)
    value = expand(step.replacement, source, pattern)
    removed = strmap.without(metadata, [step.target_label])
    target = expand(step.target_label, source, pattern)
    written = F.map_concat(metadata, F.create_map(target, value))
    settable = target.rlike(_LABEL_NAME) & (value != "")
    return F.when(
        matches(source, pattern), F.when(settable, written).otherwise(removed)
    ).otherwise(metadata)


def _hashmod(step: RelabelStep, metadata: Column, source: Column) -> Column:
    low_bytes = F.conv(F.substring(F.md5(source), 17, 16), 16, 10).cast("decimal(20,0)")
    bucket = F.pmod(low_bytes, F.lit(step.modulus).cast("decimal(20,0)")).cast("bigint")
    return F.map_concat(
        metadata, F.create_map(F.lit(step.target_label), bucket.cast("string"))
    )


def _labelmap(step: RelabelStep, metadata: Column) -> Column:
    """Copy matching keys to their new names; among equal new names the last old name wins."""
    pattern = anchored(step.regex)
    selected = F.filter(
        F.array_sort(F.map_entries(metadata)), lambda entry: matches(entry["key"], pattern)
    )
    renamed = F.transform(
        selected,
        lambda entry: F.struct(
            expand(step.replacement, entry["key"], pattern).alias("key"), entry["value"].alias("value")
        ),
    )
    return F.map_concat(metadata, F.map_from_entries(renamed))


def relabel(df: DataFrame, steps: Iterable[RelabelStep | Mapping], column: str = "metadata") -> DataFrame:
    """Apply the steps in order; ``keep`` and ``drop`` steps remove events.

    Keys with an empty value count as absent, so they are gone after any step.
    """
    steps = [s if isinstance(s, RelabelStep) else RelabelStep.from_config(s) for s in steps]
    if steps:
        df = df.withColumn(column, strmap.drop_empty_values(F.col(column)))
    for step in steps:
        metadata = F.col(column)
        source = _source(step, metadata)
        if step.action in ("keep", "drop"):
            found = computed(df, {"__matches": matches(source, anchored(step.regex))})
            wanted = F.col("__matches") if step.action == "keep" else ~F.col("__matches")
            df = found.filter(wanted).drop("__matches")
        elif step.action == "replace":
            df = df.withColumn(column, _replace(step, metadata, source))
        elif step.action == "hashmod":
            df = df.withColumn(column, _hashmod(step, metadata, source))
        elif step.action == "labelmap":
            df = df.withColumn(column, _labelmap(step, metadata))
        else:
            pattern = anchored(step.regex)
            wanted = step.action == "labelkeep"
            df = df.withColumn(
                column,
                F.map_filter(
                    metadata,
                    lambda key, _: matches(key, pattern) if wanted else ~matches(key, pattern),
                ),
            )
    return df
