"""Counts of what happened to the events of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sloflow.operators.rules import Rule, matched_rule_count
from sloflow.operators.shape import is_classified


def standard_counts(rules: Sequence[Rule] = ()) -> dict[str, Column]:
    """Counters that any stage after classification can report."""
    counts = {
        "events": F.lit(True),
        "unclassified": ~is_classified(),
    }
    if rules:
        counts["not_matching_any_rule"] = is_classified() & (matched_rule_count(rules) == 0)
    return counts


def _tallies(counts: Mapping[str, Column]) -> list[Column]:
    """Sums of conditions, as one and zero, or of whole numbers."""
    return [F.coalesce(F.sum(number.cast("bigint")), F.lit(0)).cast("bigint").alias(name) for name, number in counts.items()]


def count_events(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One row with the number of rows for which each condition holds, or the sum of a whole number."""
    return df.agg(*_tallies(counts))


def observed(df: DataFrame, name: str, counts: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The same while the data flows by: read the observation after an action on the returned frame."""
    observation = Observation(name)
    return df.observe(observation, *_tallies(counts)), observation
