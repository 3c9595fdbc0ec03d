"""Functions on string maps (``MAP<STRING,STRING>``); a NULL map counts as empty."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = "map<string,string>"


def empty() -> Column:
    return F.create_map().cast(_TYPE)


def literal(values: Mapping[str, str]) -> Column:
    if not values:
        return empty()
    flat = [F.lit(str(part)) for key in sorted(values) for part in (key, values[key])]
    return F.create_map(*flat)


def or_empty(m: Column) -> Column:
    return F.coalesce(m, empty())


def lookup(m: Column, key: str) -> Column:
    """Value of a key; NULL means the key is absent."""
    return F.element_at(m, F.lit(key))


def merge(left: Column, right: Column) -> Column:
    """Both maps; the right one wins (``sloflow.session.configure`` sets the policy)."""
    return F.map_concat(or_empty(left), or_empty(right))


def with_key(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(or_empty(m), F.create_map(F.lit(key), value))


def keys(m: Column) -> Column:
    return F.map_keys(or_empty(m))


def sorted_keys(m: Column) -> Column:
    return F.array_sort(keys(m))


def values(m: Column) -> Column:
    return F.map_values(or_empty(m))


def values_by_keys(m: Column, wanted: Iterable[str]) -> Column:
    """Values of the present keys among ``wanted``, in that order."""
    found = [lookup(m, key) for key in wanted]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def is_submap(part: Column, whole: Column) -> Column:
    """Every key of ``part`` is in ``whole`` with the same value."""
    return F.forall(
        F.map_entries(or_empty(part)),
        lambda entry: F.coalesce(F.element_at(or_empty(whole), entry["key"]) == entry["value"], F.lit(False)),
    )


def text(m: Column, separator: str = ",") -> Column:
    """``k="v",...`` sorted by key; equal maps give equal texts."""
    entries = F.array_sort(F.map_entries(or_empty(m)))
    return F.array_join(
        F.transform(
            entries, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
        ),
        separator,
    )


def lowercase(m: Column) -> Column:
    lowered = F.transform_values(or_empty(m), lambda _, value: F.lower(value))
    return F.transform_keys(lowered, lambda key, _: F.lower(key))


def select(m: Column, wanted: Iterable[str]) -> Column:
    wanted = list(wanted)
    if not wanted:
        return empty()
    return F.map_filter(or_empty(m), lambda key, _: key.isin(wanted))


def without(m: Column, unwanted: Iterable[str]) -> Column:
    unwanted = list(unwanted)
    if not unwanted:
        return or_empty(m)
    return F.map_filter(or_empty(m), lambda key, _: ~key.isin(unwanted))


def add_keys(m: Column, names: Iterable[str]) -> Column:
    """Set the given keys to an empty text."""
    return merge(m, literal({name: "" for name in names}))


def drop_null_values(m: Column) -> Column:
    return F.map_filter(m, lambda _, value: value.isNotNull())


def drop_empty_values(m: Column) -> Column:
    return F.map_filter(or_empty(m), lambda _, value: value != "")


def from_columns(columns: Mapping[str, Column]) -> Column:
    """Map of the non-NULL columns."""
    flat = [part for key, column in columns.items() for part in (F.lit(key), column)]
    return drop_null_values(F.create_map(*flat)) if flat else empty()


def from_classification(classification: Column) -> Column:
    return F.create_map(
        F.lit("slo_domain"),
        classification["domain"],
        F.lit("slo_class"),
        classification["class"],
        F.lit("app"),
        classification["app"],
    )


def classification_text(classification: Column) -> Column:
    """``domain:app:class``"""
    return F.concat_ws(":", classification["domain"], classification["app"], classification["class"])
