"""Class matchers: event key (exact or regular expression) to classification."""

from __future__ import annotations

import csv
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow.functions.regex import RegexError, compile_pattern
from sloflow.session import small_table

log = logging.getLogger(__name__)

COLUMNS = ("domain", "app", "class", "endpoint")
MATCHER_SCHEMA = "ord int, domain string, app string, class string, endpoint string"


@dataclass(frozen=True)
class Matcher:
    domain: str
    app: str
    class_: str
    endpoint: str


def read_matchers(paths: Sequence[str]) -> list[Matcher]:
    """Rows of all CSV files in the given order; ``#`` starts a comment line.

    A row without exactly four columns is skipped with a log message, but all rows of a file must
    have as many columns as its first one.
    """
    found = []
    for path in paths:
        with open(path, encoding="utf-8", newline="") as file:
            rows = csv.reader(line for line in file if not line.startswith("#"))
            width = None
            for row in rows:
                if not row:
                    continue
                width = width or len(row)
                if len(row) != width:
                    raise ValueError(f"{path}: {len(row)} columns in {row}, expected {width}")
                if len(row) != len(COLUMNS):
                    log.error("%s: skipped %s, expected %d columns", path, row, len(COLUMNS))
                    continue
                domain, app, class_, endpoint = row
                found.append(Matcher(domain, app, class_, endpoint))
    return found


def valid_patterns(matchers: Sequence[Matcher]) -> list[Matcher]:
    """The matchers whose endpoint is a regular expression; others are skipped with a log message."""
    kept = []
    for matcher in matchers:
        try:
            compile_pattern(matcher.endpoint)
        except RegexError as error:
            log.error("skipped matcher: %s", error)
        else:
            kept.append(matcher)
    return kept


def matchers_df(spark: SparkSession, matchers: Sequence[Matcher]) -> DataFrame:
    rows = [(i, m.domain, m.app, m.class_, m.endpoint) for i, m in enumerate(matchers)]
    return small_table(spark, rows, MATCHER_SCHEMA)


def csv_field(text: Column) -> Column:
    """Quote a CSV field where it needs quotes."""
    needs = text.rlike('[",\\r\\n]|^[ \\t]|^\\\\\\.\\z')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def dump_matchers(matchers: DataFrame) -> DataFrame:
    """CSV lines ``domain,app,class,endpoint`` in the column ``value``; write them with ``write.text``."""
    return matchers.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in COLUMNS]).alias("value"))
