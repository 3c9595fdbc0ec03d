"""SLO definitions: domains, their classes, types, thresholds and alerting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sloflow.functions.text import parse_float
from sloflow.operators.rules import ConfigError, known_keys, read_yaml
from sloflow.session import small_table

# Burn-rate thresholds of domains that do not set their own.
DEFAULT_BURN_RATES = {"1h": "13.44", "6h": "5.6", "1d": "2.8", "3d": "1"}


@dataclass(frozen=True)
class BurnRateThreshold:
    time_range: str
    value: float
    class_: str = ""
    slo_type: str = ""

    def applies(self, class_: str, slo_type: str) -> bool:
        return self.class_ in ("", class_) and self.slo_type in ("", slo_type)


@dataclass(frozen=True)
class SloType:
    threshold: float
    metadata: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Domain:
    name: str
    enabled: bool
    namespace: str
    version: str
    team: str
    escalate: str
    burn_rates: tuple[BurnRateThreshold, ...] | None
    classes: Mapping[str, Mapping[str, SloType]]

    @property
    def labels(self) -> dict[str, str]:
        return {"slo_domain": self.name, "slo_version": self.version, "namespace": self.namespace}

    def thresholds(self) -> tuple[BurnRateThreshold, ...]:
        if self.burn_rates is not None:
            return self.burn_rates
        return tuple(BurnRateThreshold(r, _single(v)) for r, v in DEFAULT_BURN_RATES.items())

    def errors(self) -> list[str]:
        found = []
        for threshold in self.burn_rates or ():
            if threshold.value <= 0:
                found.append("a burn-rate threshold must be greater than 0")
            if threshold.time_range not in DEFAULT_BURN_RATES:
                found.append(f"invalid burn-rate time range {threshold.time_range!r}")
            types = self.classes.get(threshold.class_, {})
            if threshold.class_ and threshold.class_ not in self.classes:
                found.append(f"class {threshold.class_!r} of a condition is not defined")
            if threshold.slo_type and threshold.class_ and threshold.slo_type not in types:
                found.append(
                    f"type {threshold.slo_type!r} of a condition is not defined for class {threshold.class_!r}"
                )
            if threshold.slo_type and not threshold.class_:
                if not any(threshold.slo_type in types for types in self.classes.values()):
                    found.append(f"type {threshold.slo_type!r} of a condition is not defined in any class")
        for class_, types in self.classes.items():
            for name, slo_type in types.items():
                if not 0 <= slo_type.threshold <= 1:
                    found.append(f"threshold of {class_}/{name} must be between 0 and 1")
        return [f"domain {self.name!r}: {error}" for error in found]


def _single(text: str) -> float:
    """Thresholds have single precision; keep the number their shortest text stands for."""
    return float(str(np.float32(parse_float(str(text).rstrip(",")))))


def _domain(config_name: str, config: Mapping) -> Domain:
    config = config or {}
    known_keys(config, {"domain", "enabled", "namespace", "version", "alerting", "classes"})
    alerting = config.get("alerting") or {}
    known_keys(alerting, {"team", "escalate", "burn_rate_thresholds"})
    thresholds = alerting.get("burn_rate_thresholds")
    burn_rates = None
    if thresholds:
        burn_rates = []
        for item in thresholds:
            known_keys(item, {"condition", "value"})
            condition = item.get("condition") or {}
            known_keys(condition, {"class", "slo_type", "time_range"})
            burn_rates.append(
                BurnRateThreshold(
                    condition.get("time_range", ""),
                    _single(item.get("value", "0")),
                    condition.get("class", ""),
                    condition.get("slo_type", ""),
                )
            )
    classes = {}
    for class_, types in (config.get("classes") or {}).items():
        classes[class_] = {}
        for name, slo_type in (types or {}).items():
            known_keys(slo_type, {"slo_threshold", "slo_threshold_metadata"})
            classes[class_][name] = SloType(
                _single(slo_type.get("slo_threshold", "0")), dict(slo_type.get("slo_threshold_metadata") or {})
            )
    return Domain(
        name=config.get("domain") or config_name,
        enabled=str(config.get("enabled", "false")).lower() in ("true", "yes", "on"),
        namespace=config.get("namespace", ""),
        version=str(int(config.get("version") or 0)),
        team=alerting.get("team", ""),
        escalate=alerting.get("escalate", ""),
        burn_rates=tuple(burn_rates) if burn_rates is not None else None,
        classes=classes,
    )


def parse_slo_definitions(text: str) -> list[Domain]:
    """Read and check definitions; all mistakes are reported together."""
    domains = [_domain(name, config) for name, config in (read_yaml(text) or {}).items()]
    errors = [error for domain in domains for error in domain.errors()]
    if errors:
        raise ConfigError(errors)
    return domains


def _table(spark: SparkSession, rows: list[dict], labels: tuple[str, ...]) -> DataFrame:
    """Rows of label columns and a value; labels beyond the common ones become columns too."""
    extra = sorted({name for row in rows for name in row} - set(labels) - {"value"})
    columns = [*labels, *extra]
    schema = ", ".join([f"`{name}` string" for name in columns] + ["value double"])
    return small_table(spark, [tuple(row.get(c) for c in [*columns, "value"]) for row in rows], schema)


def stable_version_df(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    """One row of value 1 per domain; ``escalate`` is NULL where it is not set."""
    rows = [
        {
            **d.labels,
            "team": d.team,
            "enabled": str(d.enabled).lower(),
            "escalate": d.escalate or None,
            "value": 1.0,
        }
        for d in domains
    ]
    return _table(
        spark, rows, ("slo_domain", "slo_version", "namespace", "team", "enabled", "escalate")
    )


def ratio_threshold_df(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    """One row per class and type, with the type's extra labels as columns."""
    rows = [
        {**d.labels, "slo_class": c, "slo_type": t, **slo_type.metadata, "value": slo_type.threshold}
        for d in domains
        for c, types in sorted(d.classes.items())
        for t, slo_type in sorted(types.items())
    ]
    return _table(
        spark, rows, ("slo_domain", "slo_version", "namespace", "slo_class", "slo_type")
    )


def burn_threshold_df(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    """One row per class, type and applicable burn-rate threshold."""
    rows = [
        {
            **d.labels,
            "slo_class": c,
            "slo_type": t,
            "slo_time_range": threshold.time_range,
            "value": threshold.value,
        }
        for d in domains
        for c, types in sorted(d.classes.items())
        for t in sorted(types)
        for threshold in d.thresholds()
        if threshold.applies(c, t)
    ]
    return _table(
        spark,
        rows,
        ("slo_domain", "slo_version", "namespace", "slo_class", "slo_type", "slo_time_range"),
    )
