import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sloflow.operators import classify, counters, shape
from sloflow.operators.predicates import PREDICATES, predicate
from sloflow.operators.relabel import RelabelStep, relabel
from sloflow.operators.rules import ConfigError, Rule, check_rules, evaluate_rules, parse_rules, rules_to_thresholds
from sloflow.operators.scan import with_previous, with_running_sum
from sloflow.operators.statistical import GUESSED_APP, class_weights, classify_statistical, uniform
from sloflow.session import RAW_EVENT
from sloflow.sources.matchers import Matcher, matchers_df

START = datetime(2024, 1, 1)


def raw(spark, rows):
    """Rows of (metadata, classification)."""
    return spark.createDataFrame(
        [(i, START + timedelta(seconds=7 * i), m, c, 1.0) for i, (m, c) in enumerate(rows)], RAW_EVENT
    )


def one(spark, metadata, steps):
    found = relabel(raw(spark, [(metadata, None)]), steps).collect()
    return found[0].metadata if found else None


@pytest.mark.parametrize(
    ("metadata", "step", "expected"),
    [
        ({}, {"target_label": "x", "source_labels": ["a"]}, {}),
        ({"a": "1", "e": ""}, {"target_label": "b", "source_labels": ["a"]}, {"a": "1", "b": "1"}),
        ({"a": "1"}, {"target_label": "b", "source_labels": ["a"], "regex": "2"}, {"a": "1"}),
        ({"a": "x1"}, {"target_label": "b", "source_labels": ["a"], "regex": "1"}, {"a": "x1"}),
        ({"a": "1", "b": "2"}, {"target_label": "b", "source_labels": ["a"], "replacement": ""}, {"a": "1"}),
        ({"a": "k-v"}, {"target_label": "${1}", "source_labels": ["a"], "regex": "(.*)-(.*)", "replacement": "$2"}, {"a": "k-v", "k": "v"}),
        ({"a": "1-v"}, {"target_label": "${1}", "source_labels": ["a"], "regex": "(.*)-(.*)", "replacement": "$2"}, {"a": "1-v"}),
        ({"a": "1", "b": "2"}, {"action": "drop", "source_labels": ["a", "b"], "regex": "1;2"}, None),
        ({"a": "1"}, {"action": "keep", "source_labels": ["a"], "regex": "2"}, None),
        ({"p_a": "1", "p_b": "2", "q": "3"}, {"action": "labelmap", "regex": "p_(.*)"}, {"p_a": "1", "p_b": "2", "q": "3", "a": "1", "b": "2"}),
        ({"p1": "1", "p2": "2"}, {"action": "labelmap", "regex": "p.", "replacement": "same"}, {"p1": "1", "p2": "2", "same": "2"}),
        ({"aa": "1", "b": "2"}, {"action": "labeldrop", "regex": "a+"}, {"b": "2"}),
        ({"aa": "1", "b": "2"}, {"action": "labelkeep", "regex": "a"}, {}),
    ],
)
def test_relabel(spark, metadata, step, expected):
    assert one(spark, metadata, [step]) == expected


def test_relabel_settings(spark):
    for bad in ({"action": "nope"}, {"action": "hashmod", "target_label": "x"}, {"regex": "("}, {"other": 1}, {}):
        with pytest.raises(ValueError):
            RelabelStep.from_config(bad)


@pytest.mark.parametrize(
    ("name", "value", "truths"),
    [
        ("isEqualTo", "5", [False, True, False, False]),
        ("isNotEqualTo", "5", [False, False, True, True]),
        ("isMatchingRegexp", "^$|5", [False, True, False, True]),
        ("isNotMatchingRegexp", "5", [False, False, True, True]),
        ("numberIsEqualTo", "5.0", [False, True, False, False]),
        ("numberIsNotEqualTo", "4", [False, True, False, False]),
        ("numberIsHigherThan", "5", [False, False, False, False]),
        ("numberIsEqualOrHigherThan", "5", [False, True, False, False]),
        ("numberIsEqualOrLessThan", "5", [False, True, False, False]),
        ("durationIsHigherThan", "1s", [False, False, False, False]),
    ],
)
def test_predicates(spark, name, value, truths):
    df = raw(spark, [(m, None) for m in ({}, {"k": "5"}, {"k": "x"}, {"k": ""})])
    rows = df.orderBy("event_id").select(predicate(name, "k", value).alias("p")).collect()
    assert [r.p for r in rows] == truths
    assert len(PREDICATES) == 10


def test_predicate_nan(spark):
    df = raw(spark, [({"k": "NaN"}, None)])
    names = [n for n in PREDICATES if n.startswith("number")]
    row = df.select(*[predicate(n, "k", "1").alias(n) for n in names]).first()
    assert {n for n in names if row[n]} == {"numberIsNotEqualTo"}


def test_rule_errors(spark):
    rules = [Rule.from_config({"failure_conditions": [{"operator": "nope", "key": "a"}]}),
             Rule.from_config({"slo_matcher": {"domain": "("}})]
    with pytest.raises(ConfigError) as error:
        check_rules(rules)
    assert len(error.value.errors) == 2
    for text in ("rules: [{unknown: 1}]", "other: 1", "rules: [{slo_matcher: {domain: a, domain: b}}]"):
        with pytest.raises(ValueError):
            parse_rules(text)


def test_rules(spark):
    rules = parse_rules(
        """
rules:
  - slo_matcher: {domain: test}
    failure_conditions:
      - {operator: numberIsHigherThan, key: code, value: 499}
      - {operator: durationIsHigherThan, key: took, value: 1s}
    additional_metadata: {slo_type: availability, le: 8.0}
  - slo_matcher: {app: "^b$"}
    metadata_matcher:
      - {operator: isEqualTo, key: name, value: x}
      - {operator: numberIsEqualTo, key: n, value: "1e6"}
    failure_conditions: [{operator: numberIsEqualOrLessThan, key: code, value: 7000}]
"""
    )
    cls = {"domain": "my-test-2", "app": "a", "class": "c"}
    df = raw(
        spark,
        [
            ({"code": "500"}, cls),
            ({"code": "x", "took": "2s"}, cls),
            ({"code": "x"}, cls),
            ({"name": "x", "n": "1000000", "code": "1"}, {"domain": "z", "app": "b", "class": "c"}),
            ({"name": "x"}, {"domain": "z", "app": "b", "class": "c"}),
            ({"code": "500"}, {"domain": "test", "app": "", "class": "c"}),
            ({"code": "500"}, None),
        ],
    )
    found = evaluate_rules(df, rules).orderBy("event_id", "rule").collect()
    assert [(r.event_id, r.rule, r.result) for r in found] == [
        (0, 0, "fail"), (1, 0, "fail"), (2, 0, "success"), (3, 1, "fail"),
    ]
    assert found[0].labels == {"slo_type": "availability", "le": "8.0"} and found[3].labels == {}
    rows = {tuple(sorted(r.labels.items())): r.value for r in rules_to_thresholds(spark, rules).collect()}
    filled = {"operator": "numberIsHigherThan", "slo_type": "availability", "le": "8.0", "name": "", "n": ""}
    assert rows[tuple(sorted(filled.items()))] == 499.0
    filled = {"operator": "numberIsEqualOrLessThan", "slo_type": "", "le": "", "name": "x", "n": "1e+06"}
    assert rows[tuple(sorted(filled.items()))] == 7000.0
    assert evaluate_rules(df, []).count() == 0


def test_shape(spark):
    df = raw(spark, [({"a": "1", "b": ""}, None), ({"b": "2"}, None), ({}, None)])
    keyed = shape.generate_event_key(df, ["a", "b"])
    assert [r.k for r in keyed.orderBy("event_id").select(shape.event_key().alias("k")).collect()] == ["1:", "2", ""]
    again = shape.generate_event_key(keyed, ["x"], override=False)
    assert [r.k for r in again.orderBy("event_id").select(shape.event_key().alias("k")).collect()] == ["1:", "2", ""]
    renamed = shape.rename_keys(df, [("a", "c"), ("b", "c"), ("z", "y")], collisions="n").orderBy("event_id").collect()
    assert [r.metadata for r in renamed] == [{"c": "1", "b": ""}, {"c": "2"}, {}]
    assert [r.n for r in renamed] == [1, 0, 0]


def test_sample_events(spark):
    rows = [({"x": "1"}, START, 2.5), ({"x": "2"}, START, 0.0), ({"x": "3"}, START, -1.0)]
    samples = spark.createDataFrame(rows, "labels map<string,string>, ts timestamp, value double")
    events = shape.samples_to_events(samples, drop=["x"], add={"x": "new", "y": "z"}).collect()
    assert len(events) == 3 and {e.quantity for e in events} == {1.0}
    assert events[0].metadata == {"x": "new", "y": "z", "prometheusQueryResult": "2.5", "unixTimestamp": "1704067200"}
    assert [e.quantity for e in shape.samples_to_events(samples, result_as_quantity=True).collect()] == [2.5]


# ------------------------------------------------------------------------------ brute force


def random_events(seed, count=300):
    """Mostly one hot key; some events come classified, some only partly."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        key = "hot" if rng.random() < 0.6 else rng.choice(["GET:/a", "POST:/b", "other", "GET:/z"])
        roll = rng.random()
        if roll < 0.1:
            cls = {"domain": rng.choice("de"), "app": "own", "class": rng.choice("xy")}
        elif roll < 0.15:
            cls = {"domain": "part", "app": "", "class": ""}
        else:
            cls = None
        rows.append(({"__eventKey": key}, cls))
    return rows


def classify_one_by_one(rows, exact, regexp):
    """The classifier with its cache, event after event."""
    import re

    cache = {m.endpoint: (m.domain, m.app, m.class_) for m in exact}
    out = []
    for metadata, cls in rows:
        key = metadata["__eventKey"]
        if cls and all(cls.values()):
            cache[key] = (cls["domain"], cls["app"], cls["class"])
            out.append((cache[key], None))
            continue
        if key in cache:
            out.append((cache[key], "exact"))
            continue
        found = next((m for m in regexp if re.search(m.endpoint, key)), None)
        if found:
            cache[key] = (found.domain, found.app, found.class_)
            out.append((cache[key], "regexp"))
        else:
            out.append(((cls["domain"], cls["app"], cls["class"]) if cls else None, ""))
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 60), (2, 7), (3, 100_000)])
def test_classification_against_model(spark, seed, chunk):
    rows = random_events(seed)
    exact = [Matcher("old", "m", "c", "POST:/b"), Matcher("csv", "m", "c", "POST:/b")]
    regexp = [Matcher("r1", "m", "c", "^GET:/a"), Matcher("r2", "m", "c", "^GET:")]
    found = classify.classify_dynamic(
        raw(spark, rows), matchers_df(spark, exact), regexp,
        chunk=F.floor(F.unix_micros("event_time") / (chunk * 1_000_000)),
    ).orderBy("event_id").collect()
    got = [(tuple(r.classification) if r.classification else None, r.classified_by) for r in found]
    assert got == classify_one_by_one(rows, exact, regexp)


def test_scan_against_model(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b"]), rng.randrange(40), rng.random() < 0.3, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, k string, t int, flag boolean, v double")
    found = with_previous(
        df, ["k"], ["t", "i"], {"any": (F.col("v"), None), "flagged": (F.col("v"), F.col("flag"))}, F.floor(F.col("t") / 6)
    )
    found = with_running_sum(found, ["k"], ["t", "i"], {"total": F.col("v")}, F.floor(F.col("t") / 6))
    got = {r.i: (r.any, r.flagged, r.total) for r in found.collect()}
    for i, k, t, _, v in rows:
        before = sorted((x for x in rows if x[1] == k and (x[2], x[0]) < (t, i)), key=lambda x: (x[2], x[0]))
        marked = [x for x in before if x[3]]
        assert got[i] == (
            before[-1][4] if before else None, marked[-1][4] if marked else None, sum(x[4] for x in before) + v
        )


@pytest.mark.parametrize("limit", [0, 1, 3, 100])
def test_cap_against_model(spark, limit):
    rng = random.Random(limit)
    rows = [(i, START + timedelta(seconds=i // 3), i, rng.choice("abcdefgh")) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, event_time timestamp, rule int, event_key string")
    admitted, expected = set(), []
    for row in rows:
        if limit and row[3] not in admitted and len(admitted) >= limit:
            expected.append("cardinalityLimitExceeded")
        else:
            admitted.add(row[3])
            expected.append(row[3])
    capped = counters.cap_event_keys(df, limit).orderBy("event_id").collect()
    assert [r.event_key for r in capped] == expected


@pytest.mark.parametrize("limit", [0, 1, 2, 100])
def test_cap_of_counters_is_cap_of_events(spark, limit):
    rng = random.Random(limit)
    rows = [
        (rng.choice("abcd"), rng.choice(["fail", "success"]), rng.choice("de"), "c", "a", {"t": rng.choice("xy")}, 1.5, {"u": str(i % 3)})
        for i in range(40)
    ]
    df = slo_rows(spark, rows).withColumn("rule", F.lit(0))

    def plain(table):
        return sorted((r.metric, str(sorted(r.labels.items())), r.value, str(r.exemplar)) for r in table.collect())

    expected = counters.cascade_counters(counters.cap_event_keys(df, limit), exemplar_keys=["u"])
    assert plain(counters.capped_counters(df, limit, exemplar_keys=["u"])) == plain(expected)


def slo_rows(spark, rows):
    schema = (
        "event_id int, event_time timestamp, event_key string, result string, slo_domain string, slo_class string, "
        "slo_app string, labels map<string,string>, quantity double, metadata map<string,string>"
    )
    return spark.createDataFrame([(i, START + timedelta(seconds=i), *row) for i, row in enumerate(rows)], schema)


def test_counters(spark):
    rows = [
        ("k", "fail", "d", "c", "a", {"t": "x"}, 2.0, {"u": "1"}),
        ("k", "fail", "d", "c", "a", {"t": "x"}, 3.0, {"u": "é" * 128}),
        ("j", "success", "d", "c", "b", {"t": "x", "slo_class": "own", "result": "lost"}, 1.0, {}),
        ("k", "strange", "d", "c", "a", {}, 9.0, {}),
    ]
    found = counters.cascade_counters(slo_rows(spark, rows), exemplar_keys=["u", "v"]).collect()
    values = {(r.metric, tuple(sorted(r.labels.items()))): r for r in found}
    assert len(values) == len(found) == 14
    top = values[("slo_domain:slo_events_total", (("result", "fail"), ("slo_domain", "d"), ("t", "x")))]
    assert top.value == 5.0 and top.exemplar.labels == 'u="1"' and top.exemplar.value == 2.0
    own = values[
        ("slo_domain_slo_class:slo_events_total",
         (("result", "fail"), ("slo_class", "own"), ("slo_domain", "d"), ("t", "x")))
    ]
    assert own.value == 0.0 and own.exemplar is None
    lines = {r.value for r in counters.to_exposition(counters.cascade_counters(slo_rows(spark, rows))).collect()}
    assert 'slo_domain:slo_events_total{result="success",slo_domain="d",t="x"} 1' in lines


def test_statistical(spark):
    cls = {"domain": "d", "app": "a", "class": "c"}
    rows = [({}, None)] * 9 + [({}, cls)] * 9 + [({}, None)] * 600
    df = raw(spark, rows)
    found = classify_statistical(df, window=120, interval=60).collect()
    by_id = {r.event_id: r for r in found}
    # before the first completed interval with a classified event nothing can be guessed
    first_interval_end = (9 * 7 // 60 + 1) * 60 // 7
    assert all(i not in by_id for i in range(9))
    assert all(by_id[i].classification.app == "a" for i in range(9, 18))
    guessed = [i for i in by_id if i >= 18]
    assert guessed and min(guessed) >= first_interval_end
    assert all(by_id[i].classification.app == GUESSED_APP and by_id[i].classification.domain == "d" for i in guessed)
    # the last classified event is in the interval of second 119, so the guess ends 120s after it
    assert max(guessed) * 7 < (17 * 7 // 60 + 3) * 60
    drawn = classify_statistical(raw(spark, [({}, None)] * 2000), defaults=[("x", "1", 3.0), ("y", "2", 1.0)])
    counts = {r["domain"]: r["count"] for r in drawn.groupBy("classification.domain").count().collect()}
    assert sum(counts.values()) == 2000 and 1400 < counts["x"] < 1600
    assert classify_statistical(raw(spark, [({}, None)] * 5), defaults=[("x", "1", 0.0)]).count() == 0
    spread = spark.range(1000).select(uniform(F.lit(1), F.col("id")).alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 <= spread[0] < 0.01 and 0.99 < spread[1] < 1


def test_many_relabel_steps_stay_small(spark):
    """Filters after long chains of steps must not multiply the expressions of the chain."""
    df = raw(spark, [({"a": "x-1", "b": "y"}, None)] * 3)
    replace = {"source_labels": ["a", "b"], "separator": "/", "regex": "(.*)-(\\d)/(.*)", "replacement": "$1-$2"}
    steps = [{**replace, "target_label": name} for name in "acadaeafagah"]
    steps += [{"source_labels": ["a"], "regex": "z", "action": "drop"}] * 2
    done = shape.classify_from_metadata(relabel(df, steps), "a", "b", "c")
    slo = evaluate_rules(shape.require_classified(done), parse_rules("rules: [{slo_matcher: {domain: x}}]"))
    plan = slo._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
    assert slo.count() == 3


def test_write_counters(spark, tmp_path):
    rows = [("k", "fail", "d", "c", "a", {}, 2.0, {})]
    found = counters.cascade_counters(slo_rows(spark, rows))
    counters.write_counters(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("level").count().count() == 4


def test_observed_counts(spark):
    from sloflow.operators.quality import observed, standard_counts

    df, observation = observed(raw(spark, [({}, None), ({}, {"domain": "d", "app": "a", "class": "c"})]), "q", standard_counts())
    assert df.count() == 2 and observation.get == {"events": 2, "unclassified": 1}


def test_materialize(spark):
    from sloflow.session import materialize

    df = raw(spark, [({"a": "1"}, None)])
    assert materialize(df, "events").collect() == df.collect()


def test_weights_against_a_list_of_intervals(spark):
    """Changes of weights and their running sum against sums over the intervals of the window."""
    rng = random.Random(8)
    seen = sorted((rng.randrange(40 * 60), rng.choice("ab"), rng.choice("xy")) for _ in range(200))
    rows = [(i, START + timedelta(seconds=s), {}, {"domain": d, "app": "a", "class": c}, 1.0) for i, (s, d, c) in enumerate(seen)]
    found = class_weights(spark.createDataFrame(rows, RAW_EVENT), window=300, interval=60).collect()
    got = {(r["domain"], r["class"], n): r["weight"] for r in found for n in range(r["since"], r["until"])}
    zero, expected = int(START.replace(tzinfo=timezone.utc).timestamp()) // 60, {}
    for s, d, c in seen:
        for n in range(zero + s // 60 + 1, zero + s // 60 + 6):
            expected[d, c, n] = expected.get((d, c, n), 0) + 1
    assert got == expected


def test_draws_follow_many_classes(spark):
    """Every draw falls to the class whose stretch of the total holds it, with more classes than slots."""
    rng = random.Random(9)
    rows = [(i, START + timedelta(seconds=rng.randrange(60)), {}, {"domain": f"d{rng.randrange(150)}", "app": "a", "class": "c"}, 1.0) for i in range(900)]
    rows += [(1000 + i, START + timedelta(seconds=60 + rng.randrange(60)), {}, None, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, RAW_EVENT)
    counts = sorted(Counter(r[3]["domain"] for r in rows if r[3]).items())
    draws = {r[0]: r[1] for r in df.filter("event_id >= 1000").select("event_id", uniform(F.lit(0), F.col("event_id"))).collect()}
    got = {r.event_id: r.classification.domain for r in classify_statistical(df, window=60, interval=60).collect() if r.event_id >= 1000}
    for ident, draw in draws.items():
        upto = 0
        for domain, n in counts:
            upto += n
            if upto > draw * 900:
                assert got[ident] == domain
                break


def test_pattern_index_against_all_patterns(spark):
    """The first of hundreds of patterns in file order, from the index as from a plain loop; invalid ones are left out."""
    rng = random.Random(4)
    parts = ["/api", "/v[0-9]", "/users", "/a", "b+", "(x|y)", ".*", "/", "z?", "[abc]", "/users/12"]
    patterns = ["^" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)] + ["(", "^$", "q"]
    keys = ["".join(rng.choice(["/api", "/v1", "/users", "/a", "b", "x", "/12", "z", "c"]) for _ in range(rng.randrange(5))) for _ in range(200)]
    matchers = [Matcher(f"d{i}", "m", "c", p) for i, p in enumerate(patterns)]
    df = raw(spark, [({shape.EVENT_KEY: k}, None) for k in keys])
    for given in (matchers, matchers_df(spark, matchers)):
        found = classify.classify_regexp(df, given).orderBy("event_id").collect()
        expected = [next((f"d{i}" for i, p in enumerate(patterns) if p != "(" and re.search(p, k)), None) for k in keys]
        assert [r.classification.domain if r.classification else None for r in found] == expected
