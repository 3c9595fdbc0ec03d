"""Queries over single events: sources, relabelling, classification, rules, counters."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow import fixtures as fx
from sloflow.functions import strmap
from sloflow.functions.regex import anchored, expand, matches
from sloflow.functions.text import duration_ns, metadata_label, number_text, to_float
from sloflow.operators import classify, counters, quality, shape
from sloflow.operators.predicates import predicate
from sloflow.operators.relabel import relabel
from sloflow.operators.rules import evaluate_rules, parse_rules, rules_to_thresholds
from sloflow.operators.series import RANGES, Grid, instant_vector
from sloflow.operators.statistical import class_weights, classify_statistical
from sloflow.operators.vector import select_series
from sloflow.plans import slo, stages
from sloflow.sources import accesslog, definitions, loglines, messages
from sloflow.sources.matchers import Matcher, dump_matchers, matchers_df

KEYS = ["httpMethod", "endpoint"]
CAP = 4


def _pick(df: DataFrame, keys: dict[str, str], *others, column: str = "metadata") -> DataFrame:
    chosen = [strmap.lookup(F.col(column), key).alias(name) for name, key in keys.items()]
    return df.select(*others, *chosen)


def _class_columns(column: str = "classification"):
    return [F.col(f"{column}.{part}").alias(part) for part in ("domain", "app", "class")]


# ---------------------------------------------------------------------------------- sources


def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = loglines.parse_log_lines(fx.log_lines(spark, sf), fx.LINE_RE, "^-$")
    names = ("ip", "time", "httpMethod", "httpPath", "statusCode", "referer", "requestDuration")
    return _pick(loglines.well_formed(parsed), {n: n for n in names}, "event_id", "quantity")


def log_malformed(spark: SparkSession, sf: str) -> DataFrame:
    parsed = loglines.parse_log_lines(fx.log_lines(spark, sf), fx.LINE_RE, "^-$")
    return loglines.malformed(parsed).select("event_id", "value")


def kafka_decode(spark: SparkSession, sf: str) -> DataFrame:
    decoded = messages.decode_messages(fx.messages(spark, sf))
    return _pick(
        loglines.well_formed(decoded),
        {"path": "path", "code": "code"},
        "event_id",
        "quantity",
        *_class_columns(),
    )


def kafka_malformed(spark: SparkSession, sf: str) -> DataFrame:
    decoded = messages.decode_messages(fx.messages(spark, sf))
    return loglines.malformed(decoded).select("event_id")


def _access(spark: SparkSession, sf: str, kind: str, keys: dict[str, str]) -> DataFrame:
    flat = accesslog.explode_log_batches(fx.access_logs(spark, sf)).filter(F.col("log_type") == kind)
    return _pick(
        flat,
        keys,
        "event_id",
        F.col("entry").cast("bigint").alias("entry"),
        F.size("metadata").cast("bigint").alias("n_keys"),
        "quantity",
    )


COMMON_KEYS = {
    "route": "routeName",
    "started": "startTime",
    "last_rx": "timeToLastRxByte",
    "remote": "downstreamRemoteAddress",
    "port": "downstreamRemotePort",
    "sample_rate": "sampleRate",
}


def access_log_http(spark: SparkSession, sf: str) -> DataFrame:
    keys = {
        **COMMON_KEYS,
        "path": "path",
        "method": "requestMethod",
        "protocol": "protocolVersion",
        "code": "responseCode",
        "body_bytes": "requestBodyBytes",
        "header": "http_x-user",
        "sent_header": "sent_http_x-user",
        "sent_trailer": "sent_trailer_x-user",
    }
    return _access(spark, sf, "HTTP", keys)


def access_log_tcp(spark: SparkSession, sf: str) -> DataFrame:
    return _access(spark, sf, "TCP", {**COMMON_KEYS, "received": "receivedBytes", "sent": "sentBytes"})


def access_log_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return accesslog.unknown_batches(fx.access_logs(spark, sf)).select("event_id")


def samples_simple(spark: SparkSession, sf: str) -> DataFrame:
    made = shape.samples_to_events(
        fx.samples_map(spark, sf), drop=["__name__", "unixTimestamp"], add={"source": "metrics", "unixTimestamp": "now"}
    )
    keys = {
        "type": "type",
        "result": "result",
        "name": "__name__",
        "query_result": shape.RESULT_VALUE,
        "time": shape.RESULT_TIME,
        "source": "source",
    }
    return _pick(made, keys, F.unix_seconds("event_time").alias("sec"), "quantity")


def samples_quantity(spark: SparkSession, sf: str) -> DataFrame:
    shifted = fx.samples_map(spark, sf).withColumn("value", F.col("value") - 3)
    made = shape.samples_to_events(shifted, result_as_quantity=True)
    return _pick(
        made, {"type": "type", "result": "result"}, F.unix_seconds("event_time").alias("sec"), "quantity"
    )


def select_labels(spark: SparkSession, sf: str) -> DataFrame:
    chosen = select_series(
        fx.samples_map(spark, sf),
        [("type", "=~", "vi.*|click"), ("result", "!=", "fail"), ("enabled", "!=", "false"), ("type", "!~", "cl")],
    )
    return _pick(chosen, {"type": "type", "result": "result"}, F.unix_seconds("ts").alias("sec"), "value", column="labels")


def instant_poll(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.samples_map(spark, sf)
    seen = instant_vector(samples, Grid.over(samples, 60).with_step(600), lookback=300, offset=60)
    return _pick(seen, {"type": "type", "result": "result"}, F.unix_seconds("ts").alias("sec"), "value", column="labels")


# ------------------------------------------------------------------------------- relabelling


def _relabelled(spark, sf, steps, keys) -> DataFrame:
    return _pick(relabel(fx.raw_events(spark, sf), steps), keys, "event_id")


def relabel_replace(spark: SparkSession, sf: str) -> DataFrame:
    steps = [
        {"source_labels": ["httpPath"], "regex": "/api/(\\w+)/(\\d+)", "target_label": "httpPath",
         "replacement": "/api/$1/0"},
        {"source_labels": ["httpMethod", "statusCode", "referer"], "separator": "|",
         "regex": "(?P<m>[A-Z]+)\\|(.)..\\|(.*)", "target_label": "joined", "replacement": "${m}-${2}xx-$3x"},
        {"source_labels": ["referer"], "regex": "ref[12]", "target_label": "referer", "replacement": ""},
        {"source_labels": ["statusCode"], "regex": "50", "target_label": "unused"},
    ]
    return _relabelled(
        spark, sf, steps, {"path": "httpPath", "joined": "joined", "referer": "referer", "unused": "unused"}
    )


def relabel_keep(spark: SparkSession, sf: str) -> DataFrame:
    step = {"source_labels": ["statusCode", "httpMethod"], "regex": "(404|503);POST", "action": "keep"}
    return _relabelled(spark, sf, [step], {"code": "statusCode", "method": "httpMethod"})


def relabel_drop(spark: SparkSession, sf: str) -> DataFrame:
    step = {"source_labels": ["statusCode"], "regex": "40.", "action": "drop"}
    return _relabelled(spark, sf, [step], {"code": "statusCode"})


def relabel_labelmap(spark: SparkSession, sf: str) -> DataFrame:
    step = {"regex": "http(.+)", "replacement": "req$1", "action": "labelmap"}
    return _relabelled(spark, sf, [step], {"method": "reqMethod", "path": "reqPath", "old": "httpMethod"})


def relabel_labeldrop(spark: SparkSession, sf: str) -> DataFrame:
    step = {"regex": "http.*|referer", "action": "labeldrop"}
    kept = relabel(fx.raw_events(spark, sf), [step])
    return kept.select("event_id", F.array_join(strmap.sorted_keys(F.col("metadata")), ",").alias("keys"))


def relabel_labelkeep(spark: SparkSession, sf: str) -> DataFrame:
    step = {"regex": "http.*|referer", "action": "labelkeep"}
    kept = relabel(fx.raw_events(spark, sf), [step])
    return kept.select("event_id", F.array_join(strmap.sorted_keys(F.col("metadata")), ",").alias("keys"))


def relabel_hashmod(spark: SparkSession, sf: str) -> DataFrame:
    step = {"source_labels": ["httpPath", "referer"], "modulus": 16, "target_label": "shard", "action": "hashmod"}
    return _relabelled(spark, sf, [step], {"shard": "shard"})


def relabel_url(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages").select(
        "page_id", F.create_map(F.lit("url"), F.col("url")).alias("metadata")
    )
    steps = [
        {"source_labels": ["url"], "regex": "https?://([^/]+)/.*", "target_label": "host"},
        {"source_labels": ["url"], "regex": ".*[?&]page=(\\d+).*", "target_label": "page"},
        {"source_labels": ["url"], "regex": "https?://[^/]+(/[^?#]*).*", "target_label": "path"},
        {"source_labels": ["path"], "regex": "/(\\w+)/\\d+(.*)", "target_label": "path", "replacement": "/$1/0$2"},
    ]
    done = relabel(pages, steps)
    return _pick(done, {"host": "host", "page": "page", "path": "path"}, "page_id")


# ------------------------------------------------------------------- shape, key, own class


def rename_keys(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [("httpPath", "path"), ("referer", "userId"), ("absent", "x"), ("path", "route")]
    renamed = shape.rename_keys(fx.raw_events(spark, sf), pairs, collisions="collisions")
    keys = {"http_path": "httpPath", "path": "path", "route": "route", "referer": "referer", "user": "userId"}
    return _pick(renamed, keys, "event_id", F.col("collisions").cast("bigint").alias("collisions"))


def event_key(spark: SparkSession, sf: str) -> DataFrame:
    first = shape.generate_event_key(fx.raw_events(spark, sf), ["referer", "absent"], "+")
    second = shape.generate_event_key(first, KEYS, override=False)
    return second.select("event_id", shape.event_key().alias("event_key"))


def classify_metadata(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_events(spark, sf)
    forced = shape.classify_from_metadata(raw, "httpMethod", "referer", "endpoint")
    gentle = shape.classify_from_metadata(forced, "statusCode", "statusCode", "statusCode", override=False)
    return gentle.select("event_id", *_class_columns(), shape.is_classified().cast("int").alias("classified"))


def drop_unclassified(spark: SparkSession, sf: str) -> DataFrame:
    kept = shape.require_classified(fx.raw_events(spark, sf))
    partly = shape.classification_matches(F.col("classification"), domain="shop", class_="low")
    return kept.select("event_id", *_class_columns(), partly.cast("int").alias("shop_low"))


def _predicate_query(name: str, key: str, value: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return fx.raw_events(spark, sf).select(
            "event_id", predicate(name, key, value).cast("int").alias("holds")
        )

    return query


PREDICATE_CASES = {
    "isEqualTo": ("referer", "ref3"),
    "isNotEqualTo": ("referer", "ref3"),
    "isMatchingRegexp": ("httpPath", "/1\\d$"),
    "isNotMatchingRegexp": ("referer", "f[0-3]"),
    "numberIsEqualTo": ("statusCode", "404.0"),
    "numberIsNotEqualTo": ("statusCode", "2e2"),
    "numberIsHigherThan": ("requestDuration", "0.75"),
    "numberIsEqualOrHigherThan": ("statusCode", "404"),
    "numberIsEqualOrLessThan": ("referer", "5"),
    "durationIsHigherThan": ("duration", "1.5s"),
}


# ----------------------------------------------------------------------------- classification


def _keyed(spark, sf) -> DataFrame:
    return shape.generate_event_key(fx.raw_events(spark, sf), KEYS)


def class_exact(spark: SparkSession, sf: str) -> DataFrame:
    done = classify.classify_exact(_keyed(spark, sf), matchers_df(spark, fx.EXACT_MATCHERS))
    return done.select("event_id", "event_key", *_class_columns())


def class_regexp(spark: SparkSession, sf: str) -> DataFrame:
    done = classify.classify_regexp(_keyed(spark, sf), fx.REGEXP_MATCHERS)
    return done.select("event_id", *_class_columns())


def class_many_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Four hundred patterns, each for the users of one remainder, tried on the distinct keys."""
    keyed = shape.generate_event_key(fx.raw_events(spark, sf), ["userId"])
    matchers = [Matcher(f"d{n}", "web", "low", f"^[0-9]*{n % 10}{n // 10 % 10}{n // 100}$") for n in range(400)]
    done = classify.classify_regexp(keyed, matchers)
    return done.select("event_id", *_class_columns())


def class_pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of patterns with one for each user that occurs, and one for all that is left."""
    users = fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user")).distinct()
    own = users.select(
        F.col("user").cast("long").alias("ord"), F.concat(F.lit("u"), F.col("user").cast("long") % 10).alias("domain"),
        F.lit("web").alias("app"), F.lit("low").alias("class"), F.concat(F.lit("^/api/(view|click)/"), "user", F.lit("$")).alias("endpoint"),
    )
    rest = spark.range(1).select(F.lit(1 << 40).alias("ord"), F.lit("rest").alias("domain"), F.lit("web").alias("app"), F.lit("high").alias("class"), F.lit("^.*$").alias("endpoint"))
    keyed = shape.generate_event_key(fx.raw_events(spark, sf), ["httpPath"])
    done = classify.classify_regexp(keyed, own.unionByName(rest))
    return done.select("event_id", *_class_columns())


def class_learned(spark: SparkSession, sf: str) -> DataFrame:
    done = classify.classify_learned(_keyed(spark, sf))
    return done.select("event_id", *_class_columns())


def dynamic_events(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify_dynamic(
        _keyed(spark, sf), matchers_df(spark, fx.EXACT_MATCHERS), fx.REGEXP_MATCHERS
    )


def class_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    return dynamic_events(spark, sf).select("event_id", "classified_by", *_class_columns())


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    done = classify.classify_dynamic(
        _keyed(spark, sf), matchers_df(spark, fx.EXACT_MATCHERS[:1]), fx.REGEXP_MATCHERS[:1]
    )
    return classify.classification_report(done, ["statusCode", "httpMethod"])


def matcher_dump(spark: SparkSession, sf: str) -> DataFrame:
    given = matchers_df(spark, fx.EXACT_MATCHERS)
    return dump_matchers(classify.learned_matchers(dynamic_events(spark, sf), given)).withColumnRenamed("value", "line")


def class_weights_query(spark: SparkSession, sf: str) -> DataFrame:
    return class_weights(dynamic_events(spark, sf), window=86400, interval=60)


def class_statistical(spark: SparkSession, sf: str) -> DataFrame:
    guessed = classify_statistical(
        _keyed(spark, sf), window=7200, interval=600, defaults=[("default", "low", 3.0), ("other", "high", 1.0)]
    )
    return guessed.select("event_id", "statistical_result", *_class_columns())


# --------------------------------------------------------------------------- rules, counters


def slo_events(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate_rules(dynamic_events(spark, sf), parse_rules(fx.RULES))


def rules_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return slo_events(spark, sf).select(
        "event_id", F.col("rule").cast("bigint").alias("rule"), "event_key", "result",
        "slo_domain", "slo_class", "slo_app", strmap.text(F.col("labels")).alias("labels"), "quantity",
    )


def slo_labels(spark: SparkSession, sf: str) -> DataFrame:
    return slo_events(spark, sf).select(
        "event_id", F.col("rule").cast("bigint").alias("rule"), strmap.text(counters.slo_labels()).alias("labels")
    )


def _level(level: int | None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = counters.cascade_counters(slo_events(spark, sf))
        if level:
            rows = rows.filter(F.col("level") == level)
        return rows.select("metric", strmap.text(F.col("labels")).alias("labels"), "value")

    return query


def zero_init(spark: SparkSession, sf: str) -> DataFrame:
    return counters.densify_results(slo_events(spark, sf), ["event_key", "slo_domain", "rule"]).select(
        "event_key", "slo_domain", F.col("rule").cast("bigint").alias("rule"), "result", "value"
    )


def string_map_fns(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_events(spark, sf)
    m = F.col("metadata")
    small = strmap.select(m, ["statusCode", "referer", "absent"])
    return raw.select(
        "event_id",
        strmap.text(strmap.merge(small, strmap.literal({"statusCode": "x", "y": "z"}))).alias("merged"),
        strmap.text(strmap.with_key(small, "referer", F.lit("r"))).alias("with_key"),
        F.array_join(strmap.values_by_keys(m, ["referer", "absent", "statusCode"]), "|").alias("by_keys"),
        strmap.is_submap(small, m).cast("int").alias("sub"),
        strmap.is_submap(strmap.literal({"statusCode": "200", "referer": "ref1"}), m).cast("int").alias("sub_literal"),
        strmap.text(strmap.lowercase(strmap.select(m, ["httpMethod"]))).alias("lowered"),
        F.array_join(strmap.sorted_keys(strmap.without(m, ["httpMethod", "httpPath", "duration"])), ",").alias("without"),
        strmap.text(strmap.add_keys(small, ["statusCode", "n"])).alias("added"),
        strmap.classification_text(F.col("classification")).alias("class_text"),
        strmap.text(strmap.from_classification(F.col("classification"))).alias("class_map"),
        F.lit(counters.level_metric_name(["slo_domain", "slo_class"])).alias("metric"),
        F.lit(metadata_label("statusCode")).alias("label"),
    )


def scalar_fns(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_events(spark, sf)
    m = F.col("metadata")
    pattern = anchored("/api/(?P<kind>\\w+)/(\\d+)")
    path = strmap.lookup(m, "httpPath")
    return raw.select(
        "event_id",
        to_float(strmap.lookup(m, "requestDuration")).alias("seconds"),
        to_float(strmap.lookup(m, "referer")).alias("not_a_number"),
        duration_ns(strmap.lookup(m, "duration")).alias("nanoseconds"),
        number_text(to_float(strmap.lookup(m, "statusCode"))).alias("number"),
        number_text(to_float(strmap.lookup(m, "userId")) * 1_000_000).alias("large"),
        expand("$kind:${2}!$$", path, pattern).alias("expanded"),
        matches(path, anchored("/api/view.*")).cast("int").alias("is_view"),
    )


def quality_stats(spark: SparkSession, sf: str) -> DataFrame:
    rules = parse_rules(fx.RULES)[1:]
    events = classify.classify_dynamic(_keyed(spark, sf), None, fx.REGEXP_MATCHERS[:1])
    return quality.count_events(events, quality.standard_counts(rules))


def capped_events(spark: SparkSession, sf: str) -> DataFrame:
    return counters.cap_event_keys(slo_events(spark, sf), CAP)


def cap_keys(spark: SparkSession, sf: str) -> DataFrame:
    capped = capped_events(spark, sf)
    return capped.groupBy("event_key", "key_capped").agg(
        F.count("*").alias("events"), F.min("event_id").alias("first_id")
    ).withColumn("key_capped", F.col("key_capped").cast("int"))


def capped_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = counters.capped_counters(slo_events(spark, sf), CAP)
    return rows.select("metric", strmap.text(F.col("labels")).alias("labels"), "value")


def event_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    return counters.event_key_stats(slo_events(spark, sf), CAP)


def exemplars(spark: SparkSession, sf: str) -> DataFrame:
    rows = counters.cascade_counters(slo_events(spark, sf), exemplar_keys=["httpPath", "referer"])
    return rows.select(
        "metric",
        strmap.text(F.col("labels")).alias("labels"),
        "value",
        F.col("exemplar.at.event_id").alias("exemplar_id"),
        F.col("exemplar.value").alias("exemplar_value"),
        F.col("exemplar.labels").alias("exemplar_labels"),
    )


def exposition(spark: SparkSession, sf: str) -> DataFrame:
    rows = counters.cascade_counters(slo_events(spark, sf))
    return counters.to_exposition(rows).withColumnRenamed("value", "line")


def rule_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Each threshold against the events of its rule: how many there are by result, and how many are above it."""
    rows = rules_to_thresholds(spark, parse_rules(fx.RULES)).select(
        strmap.lookup(F.col("labels"), "operator").alias("operator"),
        strmap.lookup(F.col("labels"), "slo_type").alias("slo_type"),
        strmap.text(F.col("labels")).alias("labels"),
        F.col("value").alias("threshold"),
    )
    kind = strmap.lookup(F.col("labels"), "slo_type")
    number = F.when(kind == "availability", strmap.lookup(F.col("metadata"), "statusCode")).otherwise(
        strmap.lookup(F.col("metadata"), "requestDuration")
    )
    measured = slo_events(spark, sf).select(kind.alias("slo_type"), "result", to_float(number).alias("number"))
    return rows.join(measured, "slo_type").groupBy("slo_type", "operator", "labels", "threshold", "result").agg(
        F.count("*").alias("events"), F.count_if(F.col("number") > F.col("threshold")).alias("above")
    )


def _increments(spark: SparkSession, sf: str, by: Sequence[str]) -> DataFrame:
    failed = F.when(F.col("result") == "fail", F.col("quantity")).otherwise(0.0)
    return fx.slo_increments(spark, sf).groupBy(*by).agg(F.sum("quantity").alias("total"), F.sum(failed).alias("fail"))


def stable_version(spark: SparkSession, sf: str) -> DataFrame:
    """Which domains with events have a definition, and which definitions have events."""
    by = ["slo_domain", "namespace", "slo_version"]
    stable = definitions.stable_version_df(spark, definitions.parse_slo_definitions(fx.DEFINITIONS))
    state = (
        F.when(F.col("team").isNull(), "undefined")
        .when(F.col("total").isNull(), "silent")
        .when(F.col("enabled") == "false", "disabled")
        .otherwise("watched")
    )
    known = stable.join(_increments(spark, sf, by), by, "full").withColumn("state", state)
    return known.select(*by, "team", "enabled", F.coalesce("total", F.lit(0.0)).alias("total"), "state")


def _ratio_thresholds(spark: SparkSession) -> DataFrame:
    return definitions.ratio_threshold_df(spark, definitions.parse_slo_definitions(fx.DEFINITIONS)).drop("le", "percentile")


def ratio_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The share of good events of each SLO beside its threshold; either may be missing."""
    measured = 1 - F.col("fail") / F.col("total")
    known = _ratio_thresholds(spark).join(_increments(spark, sf, slo.SLO), list(slo.SLO), "full")
    return known.select(
        *slo.SLO,
        F.col("value").alias("threshold"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "fail")],
        F.round(measured, 9).alias("measured"),
        (measured >= F.col("value")).cast("int").alias("met"),
    )


def burn_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The burn rate over the last of each range, at the newest event, beside its threshold."""
    limits = definitions.burn_threshold_df(spark, definitions.parse_slo_definitions(fx.DEFINITIONS))
    rows = fx.slo_increments(spark, sf)
    newest = rows.agg(F.max(F.unix_micros("event_time"))).scalar()
    age = newest - F.unix_micros("event_time")
    ranges = F.array(*[F.when(age < RANGES[r] * 1_000_000, F.lit(r)) for r in slo.WINDOWS])
    failed = F.when(F.col("result") == "fail", F.col("quantity")).otherwise(0.0)
    recent = (
        rows.withColumn("slo_time_range", F.explode(F.array_compact(ranges)))
        .groupBy(*slo.SLO, "slo_time_range")
        .agg(F.sum("quantity").alias("total"), F.sum(failed).alias("fail"))
    )
    allowed = _ratio_thresholds(spark).filter("value < 1").withColumnRenamed("value", "threshold")
    burn = F.col("fail") / F.col("total") / (1 - F.col("threshold"))
    known = limits.join(allowed, list(slo.SLO)).join(recent, [*slo.SLO, "slo_time_range"], "left")
    return known.select(
        *slo.SLO,
        "slo_time_range",
        F.col("value").alias("burn_limit"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.round(burn, 9).alias("burn"),
        (burn > F.col("value")).cast("int").alias("exceeded"),
    )


STAGES = {
    "pipeline": ["tailer", "relabel", "eventMetadataRenamer", "eventKeyGenerator", "metadataClassifier"],
    "modules": {
        "tailer": {"loglineParseRegexp": fx.LINE_RE, "emptyGroupRE": "^-$"},
        "relabel": {
            "eventRelabelConfigs": [
                {"source_labels": ["statusCode"], "regex": "404", "action": "drop"},
                {"source_labels": ["httpPath"], "regex": "(/api/[a-z]+)/.*", "target_label": "endpoint"},
            ]
        },
        "eventMetadataRenamer": {
            "eventMetadataRenamerConfigs": [
                {"source": "requestDuration", "destination": "seconds"}, {"source": "ip", "destination": "referer"},
            ]
        },
        "eventKeyGenerator": {"metadataKeys": KEYS},
        "metadataClassifier": {
            "sloDomainMetadataKey": "httpMethod", "sloClassMetadataKey": "statusCode", "sloAppMetadataKey": "endpoint",
        },
    },
}


def _staged(spark: SparkSession, sf: str):
    return stages.run_with_reports(spark, json.dumps(STAGES), {"tailer": fx.log_lines(spark, sf)})


def stages_events(spark: SparkSession, sf: str) -> DataFrame:
    """A declarative run over log lines."""
    done = _staged(spark, sf)[0]
    keys = {"seconds": "seconds", "ip": "ip", "event_key": "__eventKey"}
    return _pick(done, keys, "event_id", "quantity", *_class_columns())


def stages_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the lines of that run, one row per report and number, counted while it ran."""
    sink = lambda done: done.write.format("noop").mode("overwrite").save()
    counts, _ = stages.run_counted(spark, json.dumps(STAGES), sink, {"tailer": fx.log_lines(spark, sf)})
    rows = [(report, name, value) for report, numbers in counts.items() for name, value in numbers.items()]
    return spark.createDataFrame(rows, "report string, name string, value bigint")


QUERIES = {
    "stages_events": stages_events,
    "stages_reports": stages_reports,
    "log_parse": log_parse,
    "log_malformed": log_malformed,
    "kafka_decode": kafka_decode,
    "kafka_malformed": kafka_malformed,
    "access_log_http": access_log_http,
    "access_log_tcp": access_log_tcp,
    "access_log_unknown": access_log_unknown,
    "samples_simple": samples_simple,
    "samples_quantity": samples_quantity,
    "select_labels": select_labels,
    "instant_poll": instant_poll,
    "relabel_replace": relabel_replace,
    "relabel_keep": relabel_keep,
    "relabel_drop": relabel_drop,
    "relabel_labelmap": relabel_labelmap,
    "relabel_labeldrop": relabel_labeldrop,
    "relabel_labelkeep": relabel_labelkeep,
    "relabel_hashmod": relabel_hashmod,
    "relabel_url": relabel_url,
    "rename_keys": rename_keys,
    "event_key": event_key,
    "classify_metadata": classify_metadata,
    "drop_unclassified": drop_unclassified,
    **{f"pred_{name}": _predicate_query(name, *case) for name, case in PREDICATE_CASES.items()},
    "class_exact": class_exact,
    "class_regexp": class_regexp,
    "class_many_patterns": class_many_patterns,
    "class_pattern_table": class_pattern_table,
    "class_learned": class_learned,
    "class_dynamic": class_dynamic,
    "class_report": class_report,
    "matcher_dump": matcher_dump,
    "class_weights": class_weights_query,
    "class_statistical": class_statistical,
    "rules_fanout": rules_fanout,
    "slo_labels": slo_labels,
    "counters_domain": _level(1),
    "counters_class": _level(2),
    "counters_app": _level(3),
    "counters_key": _level(4),
    "counters_all": _level(None),
    "zero_init": zero_init,
    "string_map_fns": string_map_fns,
    "scalar_fns": scalar_fns,
    "quality_stats": quality_stats,
    "cap_keys": cap_keys,
    "capped_counters": capped_counters,
    "event_key_stats": event_key_stats,
    "exemplars": exemplars,
    "exposition": exposition,
    "rule_thresholds": rule_thresholds,
    "stable_version": stable_version,
    "ratio_thresholds": ratio_thresholds,
    "burn_thresholds": burn_thresholds,
}
