"""Views over the test tables that have the shapes the operators work on.

Every view is derived by Spark from the given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sloflow.operators.series import MINUTE, ceil_time
from sloflow.operators.shape import classification
from sloflow.sources.matchers import Matcher

#: The lines of :func:`log_lines`, field by field.
LINE_RE = "".join(
    (
        r"^(?P<ip>10(?:\.\d{1,3}){3})",
        r" - \[(?P<time>\d{4}-\d\d-\d\d [\d:]{8})\]",
        r' "(?P<httpMethod>[A-Z]+) (?P<httpPath>/[^" ]*)"',
        r" (?P<statusCode>[1-5]\d\d)",
        r' "(?P<referer>-|ref\d)"',
        r' rt="(?P<requestDuration>[0-9.]+)"$',
    )
)

EXACT_MATCHERS = [
    Matcher("signup", "web", "critical", "POST:/api/signup"),
    Matcher("shop", "web", "critical", "POST:/api/error"),
    Matcher("shop", "web", "low", "POST:/api/error"),
]
REGEXP_MATCHERS = [
    Matcher("browse", "web", "low", "^GET:/api/(view|click)$"),
    Matcher("other", "web", "low", "^GET:"),
]

RULES = """
rules:
  - slo_matcher: {domain: ".*"}
    failure_conditions:
      - {operator: numberIsHigherThan, key: statusCode, value: 499}
    additional_metadata: {slo_type: availability, slo_version: 1, namespace: production}
  - slo_matcher: {class: critical}
    metadata_matcher:
      - {operator: isEqualTo, key: httpMethod, value: POST}
    failure_conditions:
      - {operator: durationIsHigherThan, key: duration, value: 3s}
      - {operator: isEqualTo, key: statusCode, value: "503"}
    additional_metadata: {slo_type: latency90, slo_version: 1, namespace: production, le: "3.0"}
  - slo_matcher: {domain: ^browse$, class: low}
    failure_conditions:
      - {operator: numberIsEqualOrHigherThan, key: requestDuration, value: 4.5}
    additional_metadata: {slo_type: latency99, slo_version: 1, namespace: test}
"""

DEFINITIONS = """
click-config:
  domain: click
  enabled: true
  namespace: production
  version: 1
  alerting: {team: team.click@example.org, escalate: sre@example.org}
  classes:
    critical:
      availability: {slo_threshold: 0.95}
      latency90: {slo_threshold: 0.90, slo_threshold_metadata: {percentile: 90, le: 0.6}}
    low:
      availability: {slo_threshold: 0.90}
error:
  enabled: true
  namespace: production
  version: 1
  alerting:
    team: team.error@example.org
    escalate: sre@example.org
    burn_rate_thresholds:
      - {condition: {class: critical, time_range: 1h}, value: 0.5}
      - {condition: {slo_type: availability, time_range: 6h}, value: 0.8}
      - {condition: {class: "", slo_type: "", time_range: 1d}, value: 0.9}
      - {condition: {class: low, slo_type: availability, time_range: 3d}, value: 0.7}
  classes:
    critical:
      availability: {slo_threshold: 0.97}
      latency90: {slo_threshold: 0.85}
    low:
      availability: {slo_threshold: 1.0}
purchase:
  enabled: true
  namespace: test
  version: 1
  alerting:
    team: team.purchase@example.org
    burn_rate_thresholds:
      - {condition: {time_range: 1h}, value: 0.2}
      - {condition: {time_range: 6h}, value: 0.3}
      - {condition: {time_range: 1d}, value: 0.4}
      - {condition: {time_range: 3d}, value: 0.5}
  classes:
    critical:
      availability: {slo_threshold: 0.96}
    low:
      availability: {slo_threshold: 0.80}
signup:
  enabled: false
  namespace: production
  version: 1
  alerting: {team: team.signup@example.org, escalate: sre@example.org}
  classes:
    critical:
      availability: {slo_threshold: 0.99}
    low:
      availability: {slo_threshold: 0.95}
view:
  enabled: true
  namespace: test
  version: 1
  alerting: {team: team.view@example.org, escalate: sre@example.org}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_columns(events: DataFrame) -> DataFrame:
    """Plain columns of one request per row of ``events``; works on a stream as well."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    base = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
    )
    return base.withColumns(
        {
            "status_code": F.when(F.col("k") >= 95, "503").when(F.col("k") >= 90, "404").otherwise("200"),
            "http_method": F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST"),
            "http_path": F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string")),
            "duration_ms": F.floor(F.col("value") * 10).cast("bigint"),
            "cents": F.round(F.col("value") * 100).cast("bigint"),
            "slo_class": F.when(F.col("k") % 2 == 0, "critical").otherwise("low"),
            "result": F.when(F.col("k") >= 95, "fail").otherwise("success"),
        }
    )


def e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_columns(table(spark, sf_dir, "events"))


def with_metadata(base: DataFrame) -> DataFrame:
    """Raw events: metadata map, own classification of some purchases, quantity 1."""
    entries = {
        "statusCode": F.col("status_code"),
        "httpMethod": F.col("http_method"),
        "httpPath": F.col("http_path"),
        "endpoint": F.concat(F.lit("/api/"), "event_type"),
        "requestDuration": F.concat(
            F.floor(F.col("cents") / 10000).cast("string"),
            F.lit("."),
            F.lpad((F.col("cents") % 10000).cast("string"), 4, "0"),
        ),
        "duration": F.concat(F.col("duration_ms").cast("string"), F.lit("ms")),
        "userId": F.col("user_id").cast("string"),
        "referer": F.when(F.col("k") % 5 != 0, F.concat(F.lit("ref"), (F.col("k") % 7).cast("string"))),
    }
    flat = [part for key, column in entries.items() for part in (F.lit(key), column)]
    own = classification(F.lit("shop"), F.lit("api"), F.col("slo_class"))
    return base.select(
        "event_id",
        "event_time",
        F.map_filter(F.create_map(*flat), lambda _, value: value.isNotNull()).alias("metadata"),
        F.when((F.col("event_type") == "purchase") & (F.col("k") % 3 == 0), own).alias("classification"),
        F.lit(1.0).alias("quantity"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metadata(e(spark, sf_dir))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines; every seventeenth one lacks its method."""
    return lines_of(e(spark, sf_dir))


def lines_of(base: DataFrame) -> DataFrame:
    """The text lines of requests; works on a stream as well."""
    method = F.when(F.col("event_id") % 17 == 0, "???").otherwise(F.col("http_method"))
    referer = F.when(F.col("k") % 5 == 0, "-").otherwise(
        F.concat(F.lit("ref"), (F.col("k") % 7).cast("string"))
    )
    line = F.concat(
        F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"),
        F.lit(" - ["), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit('] "'),
        method, F.lit(" "), "http_path", F.lit('" '), "status_code",
        F.lit(' "'), referer, F.lit('" rt="'), F.col("duration_ms").cast("string"), F.lit('"'),
    )
    return base.select("event_id", line.alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kafka-shaped messages; broken in several ways, by event id."""
    base = e(spark, sf_dir)
    kind = F.col("event_id") % 20
    text = F.concat(
        F.lit('{"metadata":{"path":"'), "http_path", F.lit('","code":"'), "status_code", F.lit('"}'),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit(',"quantity":'), F.col("k").cast("string"))).otherwise(""),
        F.when(
            F.col("k") % 3 == 0,
            F.concat(F.lit(',"slo_classification":{"domain":"'), "event_type",
                     F.lit('","app":"web","class":"'), "slo_class", F.lit('"}')),
        ).otherwise(""),
        F.lit("}"),
    )
    body = (
        F.when(kind == 1, F.concat(text, F.lit(" tail")))
        .when(kind == 2, F.concat(F.lit("["), text, F.lit("]")))
        .when(kind == 3, F.lit('{"metadata":{"n":1}}'))
        .when(kind == 4, F.lit('{"quantity":"1"}'))
        .when(kind == 5, F.lit("null"))
        .when(kind == 6, F.lit('{"unknown":[1,2]}'))
        .when(kind == 7, F.lit(""))
        .otherwise(text)
    )
    version = F.when(kind == 8, "v2").otherwise("v1")
    headers = F.when(
        kind == 9, F.array().cast("array<struct<key:string,value:binary>>")
    ).otherwise(F.array(F.struct(F.lit("schema-version").alias("key"), version.cast("binary").alias("value"))))
    return base.select(
        "event_id", F.lit(None).cast("binary").alias("key"), body.cast("binary").alias("value"),
        headers.alias("headers"),
    )


def access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log service messages: two HTTP entries, one TCP entry or nothing, by event id."""
    base = e(spark, sf_dir)

    def socket(address):
        return F.struct(
            F.struct(address.alias("address"), (F.col("user_id") + 1000).alias("port_value")).alias("socket_address")
        )

    duration = F.struct(
        F.floor(F.col("duration_ms") / 1000).alias("seconds"),
        (F.col("duration_ms") % 1000 * 1_000_000).cast("int").alias("nanos"),
    )
    address = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    from sloflow.sources.accesslog import ADDRESSES, DURATIONS, HTTP_TYPE, TCP_TYPE

    def common():
        parts = {name: F.lit(None) for name in [*ADDRESSES, *DURATIONS]}
        parts["downstream_remote_address"] = F.when(F.col("k") % 4 != 0, socket(address))
        parts["time_to_last_rx_byte"] = F.when(F.col("k") % 5 != 0, duration)
        parts["route_name"] = F.col("event_type")
        parts["upstream_cluster"] = F.lit("backend")
        parts["upstream_transport_failure_reason"] = F.lit(None)
        parts["start_time"] = F.struct(F.unix_seconds("event_time").alias("seconds"), F.lit(0).alias("nanos"))
        parts["sample_rate"] = F.col("value")
        return F.struct(*[column.alias(name) for name, column in parts.items()])

    headers = F.create_map(F.lit("x-user"), F.col("user_id").cast("string"))

    def http(path):
        request = F.struct(
            F.lit("example.org").alias("authority"), F.lit(None).alias("forwarded_for"),
            F.lit(None).alias("original_path"), path.alias("path"), F.lit(None).alias("referer"),
            F.lit("id").alias("request_id"), F.col("http_method").alias("request_method"),
            F.lit("https").alias("scheme"), F.lit("agent").alias("user_agent"),
            F.col("k").alias("request_body_bytes"), F.lit(None).alias("request_headers_bytes"),
            headers.alias("request_headers"),
        )
        response = F.struct(
            F.lit(None).alias("response_code_details"), F.lit(10).alias("response_body_bytes"),
            F.col("status_code").cast("bigint").alias("response_code"),
            F.lit(None).alias("response_headers_bytes"), headers.alias("response_headers"),
            F.when(F.col("k") % 3 == 0, headers).alias("response_trailers"),
        )
        return F.struct(
            common().alias("common_properties"), F.lit("HTTP11").alias("protocol_version"),
            request.alias("request"), response.alias("response"),
        ).cast(HTTP_TYPE)

    tcp = F.struct(
        common().alias("common_properties"),
        F.struct(F.col("k").alias("received_bytes"), F.col("user_id").alias("sent_bytes")).alias("connection_properties"),
    ).cast(TCP_TYPE)
    kind = F.col("event_id") % 10
    return base.select(
        "event_id",
        F.when(kind < 7, F.array(http(F.col("http_path")), http(F.concat(F.col("http_path"), F.lit("/b"))))).alias("http_logs"),
        F.when((kind == 7) | (kind == 8), F.array(tcp)).alias("tcp_logs"),
    )


SLO_SERIES = ("namespace", "slo_class", "slo_domain", "slo_type", "slo_version", "result")


def slo_increments(spark: SparkSession, sf_dir: str, more: dict[str, str] | None = None) -> DataFrame:
    """One row per request and result of its SLO, with the labels of the definitions above.

    ``more`` names further columns of the events, by the names they get.
    """
    base = e(spark, sf_dir)
    return base.select(
        "event_id",
        "event_time",
        F.when(F.col("event_type").isin("purchase", "view"), "test").otherwise("production").alias("namespace"),
        "slo_class",
        F.col("event_type").alias("slo_domain"),
        F.lit("availability").alias("slo_type"),
        F.lit("1").alias("slo_version"),
        "result",
        (1.0 + F.col("k") % 7).alias("quantity"),
        *[F.col(column).alias(name) for name, column in (more or {}).items()],
    )


def scraped_counters(increments: DataFrame, series, step: int = MINUTE) -> DataFrame:
    """Counters as scraped at the end of every minute with events; they restart every seventh day.

    Events are summed per minute first, so the running sum has one row per series and minute.
    """
    minute = ceil_time(F.col("event_time"), step)
    per_minute = increments.groupBy(*series, minute.alias("ts")).agg(F.sum("quantity").alias("growth"))
    epoch = F.floor(F.unix_seconds("ts") / F.lit(7 * 86400))
    running = (
        Window.partitionBy(*series, "epoch").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        per_minute.withColumn("epoch", epoch)
        .withColumn("value", F.sum("growth").over(running))
        .select(*series, "ts", "value")
    )


def samples_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scraped_counters(slo_increments(spark, sf_dir), SLO_SERIES)


def samples_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`samples_counter`, but every third day nothing is recorded from 6 to 18 o'clock."""
    second = F.unix_seconds("event_time")
    gap = (F.floor(second / 86400) % 3 == 0) & (F.floor(second % 86400 / 3600).between(6, 17))
    return scraped_counters(slo_increments(spark, sf_dir).filter(~gap), SLO_SERIES)


def samples_map(spark: SparkSession, sf_dir: str, step: int = MINUTE) -> DataFrame:
    """The same kind of counters per event type and result, with labels in a map."""
    base = e(spark, sf_dir).withColumn("quantity", F.lit(1.0))
    counters = scraped_counters(base, ["event_type", "result"], step)
    labels = F.create_map(
        F.lit("__name__"), F.lit("requests_total"), F.lit("type"), F.col("event_type"), F.lit("result"), F.col("result")
    )
    return counters.select(labels.alias("labels"), "ts", "value")


BUCKETS = ("10", "50", "100", "+Inf")


def samples_hist(spark: SparkSession, sf_dir: str, step: int = 300) -> DataFrame:
    """Cumulative histogram of ``value`` per event type, scraped every five minutes."""
    base = e(spark, sf_dir)
    cell = ceil_time(F.col("event_time"), step).alias("ts")
    counts = base.groupBy("event_type", cell).agg(
        *[F.count_if(F.col("value") <= float(b)).cast("double").alias(b) if b != "+Inf"
          else F.count("*").cast("double").alias(b) for b in BUCKETS]
    )
    running = Window.partitionBy("event_type").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select("event_type", "ts", *[F.sum(F.col(f"`{b}`")).over(running).alias(b) for b in BUCKETS])
    long = sums.unpivot(["event_type", "ts"], list(BUCKETS), "le", "value")
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("le"), F.col("le"))
    return long.select(labels.alias("labels"), "ts", "value")


def samples_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``up`` sample per event type and active minute: 0 in minutes with a failed request."""
    base = e(spark, sf_dir)
    return (
        base.groupBy(
            F.concat(F.lit("app-"), F.col("event_type")).alias("app_label"),
            F.lit("production").alias("namespace"),
            ceil_time(F.col("event_time"), MINUTE).alias("ts"),
        )
        .agg(F.when(F.min("result") == "success", 1.0).otherwise(0.0).alias("value"))
    )


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular measurements: the value of each event, by event type."""
    return e(spark, sf_dir).select("event_type", F.col("event_time").alias("ts"), "value")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data correction windows per event type: 1 while active, else 0."""
    return e(spark, sf_dir).select(
        F.col("event_type").alias("incident"),
        F.col("event_time").alias("ts"),
        (F.col("k") < 30).cast("double").alias("value"),
    )


# metric name -> growth of the counter per request, as SQL over the columns of ``e``
HEALTH_COUNTERS = {
    "lines_read_total": "CASE WHEN k < 50 THEN 1 ELSE 0 END",
    "file_size_bytes": "cents * 100",
    "file_offset_bytes": "CASE WHEN k < 80 THEN cents * 100 ELSE 0 END",
    "malformed_lines_total": "CASE WHEN k >= 50 THEN k ELSE 0 END",
    "unsupported_results_total": "CASE WHEN k >= 90 THEN k - 85 ELSE 0 END",
    "query_fails_total": "k % 20",
    "events_not_matching_any_rule": "CASE WHEN k >= 97 THEN 1 ELSE 0 END",
    "unclassified_total": "k % 2",
}
HEALTH_GAUGES = {
    "up": "CASE WHEN max(k) >= 95 THEN 0 ELSE 1 END",
    "ready": "CASE WHEN max(k) >= 98 THEN 0 ELSE 1 END",
    "event_keys": "max(user_id % 10)",
    "event_keys_limit": "9",
}


def health_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's own series per instance (event type), one sample per active minute."""
    base = e(spark, sf_dir)
    sums = [F.expr(f"sum({sql})").cast("double").alias(name) for name, sql in HEALTH_COUNTERS.items()]
    gauges = [F.expr(sql).cast("double").alias(name) for name, sql in HEALTH_GAUGES.items()]
    cells = base.groupBy(
        F.col("event_type").alias("instance"), ceil_time(F.col("event_time"), MINUTE).alias("ts")
    ).agg(*sums, *gauges)
    running = Window.partitionBy("instance").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    totals = cells.select(
        "instance", "ts", *[F.sum(n).over(running).alias(n) for n in HEALTH_COUNTERS], *HEALTH_GAUGES
    )
    names = [*HEALTH_COUNTERS, *HEALTH_GAUGES]
    long = totals.unpivot(["instance", "ts"], names, "name", "value")
    unclassified = F.col("name") == "unclassified_total"
    return long.select(
        F.when(unclassified, "events_processed_total").otherwise(F.col("name")).alias("metric"),
        F.lit("production").alias("namespace"),
        "instance",
        F.col("instance").alias("pod"),
        F.when(unclassified, "unclassified").otherwise("").alias("result"),
        F.when(unclassified & (F.col("instance") == "error"), "500").otherwise("").alias("status_code"),
        "ts",
        "value",
    )
