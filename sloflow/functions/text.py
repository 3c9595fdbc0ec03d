"""Text forms of numbers, durations and names."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of numbers and units of durations.
_DECIMAL = r"\d(?:_?\d)*"
_FLOAT = (
    rf"[+-]?(?:{_DECIMAL}(?:\.(?:{_DECIMAL})?)?|\.{_DECIMAL})(?:[eE][+-]?{_DECIMAL})?"
)
_HEX_FLOAT = (
    r"[+-]?0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?[pP][+-]?\d+"
    r"|[+-]?0[xX]\.[0-9a-fA-F]+[pP][+-]?\d+"
)
_INFINITE = r"[+-]?[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
_NAN = r"[nN][aA][nN]"

UNIT_NANOSECONDS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
_UNIT = "ns|us|µs|μs|ms|s|m|h"
_QUANTITY = rf"(\d+(?:\.\d*)?|\.\d+)({_UNIT})"
_DURATION = rf"[+-]?(?:0|(?:{_QUANTITY.replace('(', '(?:', 1).replace(')(', ')(?:')})+)"

#: Digits of a duration's fraction that count.
_FRACTION_DIGITS = 18

_INFINITY = float("inf")


def to_float(text: Column) -> Column:
    """Text to double; NULL where the text is not a number or is out of range."""
    plain = F.regexp_replace(text, "_", "")
    number = plain.try_cast("double")
    infinite = number.isin(_INFINITY, -_INFINITY)
    return (
        F.when(text.rlike(rf"^(?:{_FLOAT}|{_HEX_FLOAT})\z"), F.when(~infinite, number))
        .when(text.rlike(rf"^{_NAN}\z"), F.lit(float("nan")))
        .when(
            text.rlike(rf"^{_INFINITE}\z"),
            F.when(text.startswith("-"), F.lit(-_INFINITY)).otherwise(F.lit(_INFINITY)),
        )
    )


def parse_float(text: str) -> float:
    """The same rule for configuration values; raises ``ValueError``."""
    text = str(text)
    if re.fullmatch(_FLOAT, text, re.ASCII):
        number = float(text.replace("_", ""))
        if not math.isinf(number):
            return number
    elif re.fullmatch(_HEX_FLOAT, text, re.ASCII):
        return float.fromhex(text.replace("_", ""))
    elif re.fullmatch(f"{_INFINITE}|{_NAN}", text):
        return float(text)
    raise ValueError(f"not a number: {text!r}")


def duration_ns(text: Column) -> Column:
    """Text such as ``1h2m3.5s`` to nanoseconds (BIGINT); NULL where it is not a duration."""
    amounts = F.regexp_extract_all(text, F.lit(_QUANTITY), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_QUANTITY), F.lit(2))
    factors = F.create_map(
        *[F.lit(x) for pair in UNIT_NANOSECONDS.items() for x in pair]
    )

    def nanoseconds(amount: Column, unit: Column) -> Column:
        # More whole digits than a BIGINT has are out of range; digits of the fraction are cut, not rounded.
        whole = F.concat(F.lit("0"), F.ltrim(F.split_part(amount, F.lit("."), F.lit(1)), F.lit("0")))
        part = F.concat(F.lit("0."), F.substring(F.split_part(amount, F.lit("."), F.lit(2)), 1, _FRACTION_DIGITS), F.lit("0"))
        factor = factors[unit].cast("decimal(14,0)")
        exact = F.when(F.length(whole) <= 20, whole).cast("decimal(20,0)") * factor
        return (exact + F.floor(part.cast("decimal(19,18)") * factor)).cast("decimal(38,0)")

    parts = F.zip_with(amounts, units, nanoseconds)
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)"))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.rlike(rf"^{_DURATION}\z"), signed.try_cast("bigint"))


def parse_duration_ns(text: str) -> int:
    """The same rule for configuration values; raises ``ValueError``."""
    text = str(text)
    if not re.fullmatch(_DURATION, text, re.ASCII):
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for amount, unit in re.findall(_QUANTITY, text, re.ASCII):
        whole, _, part = amount.partition(".")
        part = part[:_FRACTION_DIGITS]
        total += int(whole or 0) * UNIT_NANOSECONDS[unit] + int(part or 0) * UNIT_NANOSECONDS[unit] // 10 ** len(part)
    if total > 2**63 - 1:
        raise ValueError(f"duration out of range: {text!r}")
    return -total if text.startswith("-") else total


def nanoseconds_text(nanoseconds: Column) -> Column:
    """``<n>ns``"""
    return F.concat(nanoseconds.cast("bigint").cast("string"), F.lit("ns"))


def rfc3339(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number_text(number: Column, exponents: bool = True) -> Column:
    """Shortest text that reads back as the same double.

    Plain digits for decimal exponents from -4 to 5, otherwise ``d.ddde+XX``; plain digits always
    with ``exponents=False``.  The JVM text has the right digits already (``ddd.ddd`` from 0.001
    to 10 million, ``d.dddE-7`` outside), so only its layout changes.
    """
    raw = number.cast("string")
    scientific = raw.contains("E")
    power = F.split_part(raw, F.lit("E"), F.lit(2)).cast("int")
    plain = F.regexp_replace(raw, r"\.0$", "")
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    digits = F.regexp_replace(mantissa, r"[-.]", "")
    sign = F.when(number < 0, F.lit("-")).otherwise("")
    fraction = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    if exponents:
        million = F.regexp_replace(raw, r"^(-?\d)(\d{6})\.(\d+)$", "$1.$2$3")
        with_power = F.concat(
            mantissa,
            F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")),
        )
        body = (
            F.when(scientific & (power == -4), fraction)
            .when(scientific, with_power)
            .when(
                F.abs(number) >= 1e6,
                F.concat(F.regexp_replace(million, r"\.?0+$", ""), F.lit("e+06")),
            )
            .otherwise(plain)
        )
    else:
        large = F.when(
            F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))
        ).otherwise(
            F.concat(
                F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)
            )
        )
        body = (
            F.when(scientific & (power < 0), fraction)
            .when(scientific, F.concat(sign, large))
            .otherwise(plain)
        )
    return (
        F.when(F.isnan(number), F.lit("NaN"))
        .when(number == _INFINITY, F.lit("+Inf"))
        .when(number == -_INFINITY, F.lit("-Inf"))
        .otherwise(body)
    )


def snake_case(name: str) -> str:
    """Metadata key to a label name part: ``statusCode`` -> ``status_code``."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name.strip())
    spaced = re.sub(r"([a-z])([A-Z])", r"\1_\2", spaced)
    spaced = re.sub(r"([A-Za-z])([0-9])", r"\1_\2", spaced)
    spaced = re.sub(r"([0-9])([A-Za-z])", r"\1_\2", spaced)
    return re.sub(r"[ \-.]", "_", spaced).lower()


def metadata_label(name: str) -> str:
    return "metadata_" + snake_case(name)
