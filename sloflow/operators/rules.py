"""Evaluation rules: which events they take, when such an event failed, what labels it gets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import exploded
from sloflow.functions.regex import compile_pattern, matches
from sloflow.functions.text import parse_float
from sloflow.operators.predicates import EQUALITY, NUMERIC, predicate
from sloflow.operators.shape import event_key, is_classified


class ConfigError(ValueError):
    """All mistakes found in a configuration, joined."""

    def __init__(self, errors: Sequence[str]):
        super().__init__("; ".join(errors))
        self.errors = list(errors)


class _TextLoader(yaml.BaseLoader):
    """YAML with scalars as written (``8.0`` stays ``8.0``) and without repeated keys."""


def _unique_mapping(loader, node, deep=False):
    found = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        if key in found:
            raise ValueError(f"key {key!r} is given twice")
        found[key] = loader.construct_object(value_node, deep=True)
    return found


_TextLoader.add_constructor("tag:yaml.org,2002:map", _unique_mapping)


def read_yaml(text: str):
    return yaml.load(text, Loader=_TextLoader)


@dataclass(frozen=True)
class Condition:
    operator: str
    key: str
    value: str = ""

    def column(self, metadata: Column | None = None) -> Column:
        return predicate(self.operator, self.key, self.value, metadata)


@dataclass(frozen=True)
class SloMatcher:
    """Regular expressions searched in the classification; an empty one takes anything."""

    domain: str = ""
    app: str = ""
    class_: str = ""

    def column(self, classification: Column) -> Column:
        condition = F.lit(True)
        for name, text in (("domain", self.domain), ("class", self.class_), ("app", self.app)):
            if text:
                condition = condition & matches(classification[name], compile_pattern(text))
        return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class Rule:
    metadata_matcher: tuple[Condition, ...] = ()
    slo_matcher: SloMatcher = SloMatcher()
    failure_conditions: tuple[Condition, ...] = ()
    additional_metadata: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: Mapping) -> Rule:
        config = config or {}
        known_keys(config, {"metadata_matcher", "slo_matcher", "failure_conditions", "additional_metadata"})
        matcher = config.get("slo_matcher") or {}
        known_keys(matcher, {"domain", "class", "app"})

        def conditions(name: str) -> tuple[Condition, ...]:
            found = []
            for item in config.get(name) or ():
                known_keys(item, {"operator", "key", "value"})
                found.append(
                    Condition(str(item.get("operator", "")), str(item.get("key", "")), str(item.get("value", "")))
                )
            return tuple(found)

        return cls(
            conditions("metadata_matcher"),
            SloMatcher(
                str(matcher.get("domain", "")), str(matcher.get("app", "")), str(matcher.get("class", ""))
            ),
            conditions("failure_conditions"),
            {str(k): str(v) for k, v in (config.get("additional_metadata") or {}).items()},
        )


def known_keys(config: Mapping, allowed: set[str]):
    unknown = set(config) - allowed
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}, use {sorted(allowed)}")


def rule_matches(rule: Rule) -> Column:
    """The classification and all metadata conditions fit."""
    parts = [rule.slo_matcher.column(F.col("classification"))]
    parts += [condition.column() for condition in rule.metadata_matcher]
    return reduce(lambda a, b: a & b, parts)


def rule_failed(rule: Rule) -> Column:
    """At least one failure condition holds; without conditions the event succeeded."""
    return reduce(lambda a, b: a | b, [c.column() for c in rule.failure_conditions], F.lit(False))


def check_rules(rules: Iterable[Rule]) -> list[Rule]:
    """Return the rules, or raise one error naming every mistake in any of them."""
    rules = list(rules)
    errors = []
    for number, rule in enumerate(rules):
        for check in (rule_matches, rule_failed):
            try:
                check(rule)
            except ValueError as error:
                errors.append(f"rule {number}: {error}")
    if errors:
        raise ConfigError(errors)
    return rules


def parse_rules(text: str) -> list[Rule]:
    config = read_yaml(text) or {}
    known_keys(config, {"rules"})
    return [Rule.from_config(item) for item in config.get("rules") or ()]


def load_rules(paths: Sequence[str]) -> list[Rule]:
    """Rules of all files in the given order; unknown settings are errors."""
    rules = []
    for path in paths:
        with open(path, encoding="utf-8") as file:
            rules += parse_rules(file.read())
    return check_rules(rules)


def evaluate_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One SLO event per classified event and matching rule.

    Adds ``event_key``, ``result``, ``slo_domain``, ``slo_class``, ``slo_app``, ``labels`` (the
    rule's additional metadata) and ``rule`` (its position).
    """
    rules = check_rules(rules)
    if not rules:
        rules, df = [Rule()], df.limit(0)
    labels = F.array(*[strmap.literal(rule.additional_metadata) for rule in rules])
    hits = F.array(
        *[
            F.when(
                is_classified() & rule_matches(rule),
                F.struct(
                    F.lit(number).alias("rule"),
                    F.when(rule_failed(rule), "fail").otherwise("success").alias("result"),
                ),
            )
            for number, rule in enumerate(rules)
        ]
    )
    return exploded(df, "__hit", F.array_compact(hits)).withColumns(
        {
            "event_key": event_key(),
            "result": F.col("__hit.result"),
            "slo_domain": F.col("classification.domain"),
            "slo_class": F.col("classification.class"),
            "slo_app": F.col("classification.app"),
            "labels": F.element_at(labels, F.col("__hit.rule") + 1),
            "rule": F.col("__hit.rule"),
        }
    ).drop("__hit")


def matched_rule_count(rules: Sequence[Rule]) -> Column:
    """How many rules take the event; 0 on a classified event is worth a warning."""
    counts = [rule_matches(rule).cast("int") for rule in rules]
    return F.when(is_classified(), reduce(lambda a, b: a + b, counts, F.lit(0))).otherwise(0)


def _shortest(number: float) -> str:
    """Same layout as :func:`sloflow.functions.text.number_text` for a configuration value."""
    if number != number:
        return "NaN"
    if number in (float("inf"), float("-inf")):
        return "+Inf" if number > 0 else "-Inf"
    texts = (f"{number:.{precision}e}" for precision in range(17))
    shortest = next(text for text in texts if float(text) == number)
    if number and not -4 <= int(shortest.partition("e")[2]) < 6:
        return shortest
    return repr(float(number)).removesuffix(".0")


def rules_to_thresholds(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row ``(labels, value)`` per numeric failure condition.

    Labels are the operator's name, the rule's additional metadata and its equality conditions;
    every row has the label names of all rows, empty where it has no value of its own.
    """
    rows = []
    for rule in check_rules(rules):
        fixed = {}
        for matcher in rule.metadata_matcher:
            if matcher.operator in EQUALITY:
                numeric = matcher.operator in NUMERIC
                fixed[matcher.key] = _shortest(parse_float(matcher.value)) if numeric else matcher.value
        for condition in rule.failure_conditions:
            if condition.operator in NUMERIC:
                labels = {"operator": condition.operator, **rule.additional_metadata, **fixed}
                rows.append((labels, parse_float(condition.value)))
    names = sorted({name for labels, _ in rows for name in labels})
    filled = [({name: labels.get(name, "") for name in names}, value) for labels, value in rows]
    return spark.createDataFrame(filled, "labels map<string,string>, value double")
