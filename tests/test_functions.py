import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.regex import RegexError, anchored, compile_pattern, expand, matches, required_texts
from sloflow.functions.text import (
    duration_ns,
    metadata_label,
    number_text,
    parse_duration_ns,
    parse_float,
    snake_case,
    to_float,
)


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_to_float(spark):
    cases = {
        "10": 10.0, "1_000.5": 1000.5, ".5": 0.5, "5.": 5.0, "-1e3": -1000.0, "0x1p-2": 0.25,
        "inf": math.inf, "-Infinity": -math.inf, " 10 ": None, "10d": None, "1f": None,
        "1e400": None, "": None, "1__0": None, "-nan": None, "abc": None, "10\n": None,
    }
    assert column(spark, list(cases), "string", to_float) == list(cases.values())
    assert math.isnan(column(spark, ["NaN"], "string", to_float)[0])
    for text, value in cases.items():
        if value is None:
            with pytest.raises(ValueError):
                parse_float(text)
        else:
            assert parse_float(text) == value


def test_duration(spark):
    cases = {
        "1h2m3.5s": 3_723_500_000_000, "32451342ns": 32_451_342, "20s": 20 * 10**9, "5ms": 5 * 10**6,
        "-1.5h": -5400 * 10**9, ".5s": 5 * 10**8, "1.s": 10**9, "3us4µs": 7000, "0": 0,
        "foo": None, "1": None, "": None, "9999999h": None, "5ms\n": None,
    }
    assert column(spark, list(cases), "string", duration_ns) == list(cases.values())
    for text, value in cases.items():
        if value is None:
            with pytest.raises(ValueError):
                parse_duration_ns(text)
        else:
            assert parse_duration_ns(text) == value


def test_number_text(spark):
    cases = {
        1.0: "1", 0.1: "0.1", 123456.0: "123456", 1e6: "1e+06", 1234567.0: "1.234567e+06",
        1e-4: "0.0001", 1e-5: "1e-05", 1.5e300: "1.5e+300", -3.25: "-3.25", 0.0: "0",
        math.inf: "+Inf", -math.inf: "-Inf", 1000000.5: "1.0000005e+06", 1e21: "1e+21",
    }
    assert column(spark, list(cases), "double", number_text) == list(cases.values())
    plain = [1e21, 1.5e-5, 1234567.0]
    assert column(spark, plain, "double", lambda c: number_text(c, exponents=False)) == [
        "1000000000000000000000", "0.000015", "1234567",
    ]


def test_names():
    assert [snake_case(n) for n in ("foo", "fooBar", "FooBar", "foobar", "")] == [
        "foo", "foo_bar", "foo_bar", "foobar", "",
    ]
    assert metadata_label("statusCode") == "metadata_status_code"


@pytest.mark.parametrize(
    "pattern", ["a++", "(?=x)", r"\1", "(a", "a)", "a{2,1}", "*a", "a|*", "(?U)a", "[a", r"\Z", "(?P<x>a)(?P<x>b)"]
)
def test_bad_patterns(pattern):
    with pytest.raises(RegexError):
        compile_pattern(pattern)


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        ("a$", "a\n", False),
        (r"^\s$", "\x0b", False),
        ("(?i)É", "é", True),
        ("a.b", "a\rb", True),
        ("a.b", "a\nb", False),
        ("[]a]", "]", True),
        ("{x}", "{x}", True),
        (r"\Qa.b\E", "axb", False),
        ("[[:digit:]&]+$", "1&2", True),
        (r"[^\S\n]", "\x0b", False),
        ("(?m)^b$", "a\nb", True),
    ],
)
def test_pattern_dialect(spark, pattern, text, found):
    assert column(spark, [text], "string", lambda c: matches(c, compile_pattern(pattern))) == [found]


def test_template(spark):
    pattern = anchored("(?P<kind>[a-z]+)-([0-9]+)")
    templates = {"$kind:$2": "ab:12", "$1x": "", "${1}x$$": "abx$", "$9|": "|", "": ""}
    for template, expected in templates.items():
        assert column(spark, ["ab-12"], "string", lambda c, t=template: expand(t, c, pattern)) == [expected]


def test_string_maps(spark):
    kind = "map<string,string>"
    one = {"a": "1", "B": "X"}

    def of(make, value=one):
        return column(spark, [value], kind, make)[0]

    assert of(lambda m: strmap.merge(m, strmap.literal({"a": "2"}))) == {"a": "2", "B": "X"}
    assert of(lambda m: strmap.merge(m, strmap.empty()), None) == {}
    assert of(strmap.lowercase) == {"a": "1", "b": "x"}
    assert of(strmap.text) == 'B="X",a="1"'
    assert of(lambda m: strmap.select(m, ["a", "z"])) == {"a": "1"}
    assert of(lambda m: strmap.without(m, ["a", "z"])) == {"B": "X"}
    assert of(lambda m: strmap.add_keys(m, ["a", "n"])) == {"a": "", "B": "X", "n": ""}
    assert of(lambda m: strmap.values_by_keys(m, ["B", "z", "a"])) == ["X", "1"]
    assert of(lambda m: strmap.is_submap(strmap.literal({"a": "1"}), m)) is True
    assert of(lambda m: strmap.is_submap(strmap.literal({"a": "2"}), m)) is False
    assert of(lambda m: strmap.is_submap(strmap.literal({"z": ""}), m)) is False


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("99999999999999999999999s", None), ("1.9999999999ns", 1), ("1.9999999999999999999999999999999ns", 1), ("0000000000000000000000001s", 10**9),
        (".5s", 5 * 10**8), ("1.s", 10**9), ("2562047h47m16.854775807s", 2**63 - 1), ("2562047h47m16.854775808s", None), ("-1h0.25m", -3_615_000_000_000),
    ],
)
def test_extreme_durations(spark, text, expected):
    found = spark.createDataFrame([(text,)], "t string").select(duration_ns(F.col("t"))).first()[0]
    assert found == expected
    if expected is None:
        with pytest.raises(ValueError):
            parse_duration_ns(text)
    else:
        assert parse_duration_ns(text) == expected


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("^/api/users/[0-9]+$", ["/api/users/"]), ("a|b", []), ("(?i)abc", []), ("abc?d", ["ab", "d"]), ("ab+c", ["a", "b", "c"]),
        ("(abc)def", ["def"]), (r"\Qa.b\Ec", ["a.bc"]), (r"a\.b\dc", ["a.b", "c"]), ("ab{2}c{0,3}d", ["a", "b", "d"]), ("[]a-]x", ["x"]),
        (r"\x41b", ["b"]), (r"\d{2}a", ["a"]), ("", []), ("a{x", ["a{x"]), (".*", []), ("(a|b)cd(?:e|f)*gh", ["cd", "gh"]), ("(?s)ab", ["ab"]),
    ],
)
def test_required_texts(pattern, expected):
    compile_pattern(pattern)
    assert required_texts(pattern) == expected


def test_required_texts_are_in_every_match():
    rng = random.Random(3)
    pieces = ["a", "b", "ab", "a+", "b?", "(a|b)", "(ab)*", "[ab]", ".", "c{2}", "c{0,1}", "^", "$", r"\.", "(?:b|c)", "|", r"\d", "x", "(a(b)c)?"]
    hits = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        text = "".join(rng.choice("abc.x1") for _ in range(rng.randrange(8)))
        found = re.search(pattern, text)
        if found:
            hits += 1
            assert all(t in found[0] for t in required_texts(pattern)), (pattern, text)
    assert hits > 500
