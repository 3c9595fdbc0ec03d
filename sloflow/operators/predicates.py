"""Conditions on metadata values, by name.

An absent key makes every condition false, the negated ones included; so does a value that cannot
be parsed as the condition needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.regex import compile_pattern, matches
from sloflow.functions.text import duration_ns, parse_duration_ns, parse_float, to_float

Test = Callable[[Column], Column]

# name -> (threshold text -> test on the metadata value); extend it to add conditions
PREDICATES: dict[str, Callable[[str], Test]] = {}
# which conditions compare with a number, and which with one certain value
NUMERIC: set[str] = set()
EQUALITY: set[str] = set()


def register(name: str, numeric: bool = False, equality: bool = False):
    def add(factory: Callable[[str], Test]):
        PREDICATES[name] = factory
        if numeric:
            NUMERIC.add(name)
        if equality:
            EQUALITY.add(name)
        return factory

    return add


def predicate(name: str, key: str, value: str, metadata: Column | None = None) -> Column:
    """The named condition on a metadata key as a boolean column that is never NULL."""
    if name not in PREDICATES:
        raise ValueError(f"unknown operator {name!r}, use one of {sorted(PREDICATES)}")
    metadata = F.col("metadata") if metadata is None else metadata
    test = PREDICATES[name](value)
    return F.coalesce(test(strmap.lookup(metadata, key)), F.lit(False))


@register("isEqualTo", equality=True)
def _equal(value: str) -> Test:
    return lambda found: found == F.lit(value)


@register("isNotEqualTo")
def _not_equal(value: str) -> Test:
    return lambda found: found != F.lit(value)


@register("isMatchingRegexp")
def _matching(value: str) -> Test:
    pattern = compile_pattern(value)
    return lambda found: matches(found, pattern)


@register("isNotMatchingRegexp")
def _not_matching(value: str) -> Test:
    pattern = compile_pattern(value)
    return lambda found: ~matches(found, pattern)


def _number_test(compare: Callable[[Column, Column], Column], if_nan: bool = False):
    """Numbers compare as IEEE doubles: any comparison with NaN is false, except "not equal"."""

    def factory(value: str) -> Test:
        threshold = parse_float(value)

        def test(found: Column) -> Column:
            number = to_float(found)
            if math.isnan(threshold):
                return number.isNotNull() & F.lit(if_nan)
            return F.when(F.isnan(number), F.lit(if_nan)).otherwise(
                compare(number, F.lit(threshold))
            )

        return test

    return factory


register("numberIsEqualTo", numeric=True, equality=True)(_number_test(lambda a, b: a == b))
register("numberIsNotEqualTo", numeric=True)(_number_test(lambda a, b: a != b, if_nan=True))
register("numberIsHigherThan", numeric=True)(_number_test(lambda a, b: a > b))
register("numberIsEqualOrHigherThan", numeric=True)(_number_test(lambda a, b: a >= b))
register("numberIsEqualOrLessThan", numeric=True)(_number_test(lambda a, b: a <= b))


@register("durationIsHigherThan")
def _longer(value: str) -> Test:
    threshold = parse_duration_ns(value)
    return lambda found: duration_ns(found) > F.lit(threshold)
