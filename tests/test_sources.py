import pytest
from pyspark.sql import functions as F

from sloflow.operators.rules import ConfigError
from sloflow.sources import accesslog, definitions, loglines, messages
from sloflow.sources.matchers import dump_matchers, matchers_df, read_matchers, valid_patterns

LINE = r'^(?P<ip>[0-9a-f.:]+) "(?P<method>GET|POST) (?P<path>\S+)" (?P<code>\d+) (?P<took>\d+(\.\d+)?)'


def test_log_lines(spark):
    lines = [
        '1.2.3.4 "GET /a" 200 0.5',
        '::1 "POST -" 404 7 trailing',
        "garbage",
        '1.1.1.1 "GET /a\x01b" 200 1.25',
        None,
    ]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, value string")
    rows = loglines.parse_log_lines(df, LINE, "^-$").orderBy("i").collect()
    assert [r.malformed for r in rows] == [False, False, True, False, True]
    assert rows[0].metadata == {"ip": "1.2.3.4", "method": "GET", "path": "/a", "code": "200", "took": "0.5"}
    assert rows[1].metadata == {"ip": "::1", "method": "POST", "code": "404", "took": "7"}
    assert rows[3].metadata["path"] == "/a\x01b"


@pytest.mark.parametrize(
    ("body", "version", "expected"),
    [
        ("{}", None, ({}, 1.0, None)),
        ("null", "v1", ({}, 1.0, None)),
        ('{"quantity": 2.5, "metadata": {"a": "b", "n": null}}', "v1", ({"a": "b", "n": ""}, 2.5, None)),
        ('{"Quantity": 3, "unknown": [1]}', "v1", ({}, 3.0, None)),
        ('{"slo_classification": {"domain": "d", "app": "a"}}', "v1", ({}, 1.0, ("d", "a", ""))),
        (' {"metadata": {}} \n', "v1", ({}, 1.0, None)),
        ("{}", "v2", None),
        ('{"quantity": "1"}', "v1", None),
        ('{"quantity": 1e999}', "v1", None),
        ('{"metadata": {"a": 1}}', "v1", None),
        ('{"metadata": []}', "v1", None),
        ('{"slo_classification": "x"}', "v1", None),
        ("[{}]", "v1", None),
        ("{} {}", "v1", None),
        ("{}]", "v1", None),
        ("{}, {}", "v1", None),
        ('{}}, {"a": 1}', "v1", None),
        ("", "v1", None),
        ("{", "v1", None),
    ],
)
def test_messages(spark, body, version, expected):
    headers = [] if version is None else [("other", b"x"), ("schema-version", version.encode()), ("schema-version", b"v9")]
    df = spark.createDataFrame(
        [(None, body.encode(), headers)], "key binary, value binary, headers array<struct<key:string,value:binary>>"
    )
    row = messages.decode_messages(df).first()
    assert row.malformed == (expected is None)
    if expected:
        metadata, quantity, classification = expected
        assert (row.metadata, row.quantity) == (metadata, quantity)
        assert (tuple(row.classification) if row.classification else None) == classification


def test_kafka_options():
    options = messages.kafka_options(["a:1", "b:2"], "t", "g", "LastOffset")
    assert options["kafka.bootstrap.servers"] == "a:1,b:2"
    assert options["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        messages.kafka_options(["a"], "t", start="Middle")


def test_access_log(spark):
    schema = "id int, " + accesslog.BATCH_TYPE
    common = {
        "downstream_remote_address": {"socket_address": {"address": "1.2.3.4", "port_value": 80}},
        "upstream_local_address": {"socket_address": None},
        "time_to_last_rx_byte": {"seconds": 1, "nanos": 5},
        "time_to_first_upstream_rx_byte": {"seconds": 1, "nanos": -5},
        "start_time": {"seconds": 0, "nanos": 1},
        "sample_rate": 0.00001,
    }
    http = {
        "common_properties": common,
        "protocol_version": "HTTP2",
        "request": {"path": "/x", "request_headers": {"k": "v"}},
        "response": {"response_code": 503, "response_trailers": {"t": "u"}},
    }
    tcp = {"common_properties": {}, "connection_properties": {"received_bytes": 7}}
    rows = [(1, [http], [tcp]), (2, None, [tcp, tcp]), (3, None, None), (4, [], [tcp])]
    df = spark.createDataFrame(rows, schema)
    found = accesslog.explode_log_batches(df).orderBy("id", "entry").collect()
    assert [(r.id, r.log_type) for r in found] == [(1, "HTTP"), (2, "TCP"), (2, "TCP")]
    m = found[0].metadata
    assert m["downstreamRemoteAddress"] == "1.2.3.4" and m["downstreamRemotePort"] == "80"
    assert "upstreamLocalAddress" not in m and "timeToFirstUpstreamRxByte" not in m
    assert m["timeToLastRxByte"] == "1000000005ns" and m["startTime"] == "1970-01-01T00:00:00Z"
    assert m["sampleRate"] == "0.00001" and m["responseCode"] == "503" and m["userAgent"] == ""
    assert m["http_k"] == "v" and m["sent_trailer_t"] == "u"
    assert found[1].metadata["receivedBytes"] == "7" and found[1].metadata["sentBytes"] == "0"
    assert [r.id for r in accesslog.unknown_batches(df).collect()] == [3]
    skipped = df.filter("id = 1").select(accesslog.skipped_fields(F.col("http_logs")[0]["common_properties"]).alias("s"))
    assert tuple(skipped.first().s) == (1, 1, 0)


def test_matchers(spark, tmp_path):
    first, second, uneven = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    first.write_text('# comment\nd,a,c,"^x,(y)$"\n')
    second.write_text("d,a,c,(\nd2,a,c,ok\n")
    uneven.write_text("d,a,c,x\nd,a\n")
    found = read_matchers([str(first), str(second)])
    assert [m.endpoint for m in found] == ["^x,(y)$", "(", "ok"]
    assert [m.endpoint for m in valid_patterns(found)] == ["^x,(y)$", "ok"]
    assert dump_matchers(matchers_df(spark, found[:1])).first().value == 'd,a,c,"^x,(y)$"'
    with pytest.raises(ValueError):
        read_matchers([str(uneven)])


def test_definitions(spark):
    text = """
    one:
      enabled: true
      namespace: n
      version: 6
      alerting:
        team: t
        burn_rate_thresholds:
          - {condition: {class: critical, slo_type: availability, time_range: 1h}, value: 13.44}
          - {condition: {time_range: 6h}, value: 33.12}
      classes:
        critical: {availability: {slo_threshold: 0.99}}
        low: {latency90: {slo_threshold: 0.9, slo_threshold_metadata: {le: 0.8}}}
    two-config:
      domain: two
      classes: {c: {availability: {slo_threshold: 0.5}}}
    """
    domains = definitions.parse_slo_definitions(text)
    stable = definitions.stable_version_df(spark, domains).orderBy("slo_domain").collect()
    assert [(r.slo_domain, r.enabled, r.escalate, r.slo_version) for r in stable] == [
        ("one", "true", None, "6"), ("two", "false", None, "0"),
    ]
    ratios = definitions.ratio_threshold_df(spark, domains).collect()
    assert {(r.slo_class, r.slo_type, r.le, r.value) for r in ratios} == {
        ("critical", "availability", None, 0.99), ("low", "latency90", "0.8", 0.9), ("c", "availability", None, 0.5),
    }
    burn = definitions.burn_threshold_df(spark, domains).filter("slo_domain = 'one'").collect()
    assert {(r.slo_class, r.slo_time_range, r.value) for r in burn} == {
        ("critical", "1h", 13.44), ("critical", "6h", 33.12), ("low", "6h", 33.12),
    }
    assert definitions.burn_threshold_df(spark, domains).filter("slo_domain = 'two'").count() == 4


def test_definition_errors():
    text = """
    bad:
      alerting:
        burn_rate_thresholds:
          - {condition: {class: nope, time_range: 2h}, value: 0}
          - {condition: {slo_type: none, time_range: 1h}, value: 1}
      classes: {c: {availability: {slo_threshold: 1.5}}}
    """
    with pytest.raises(ConfigError) as error:
        definitions.parse_slo_definitions(text)
    assert len(error.value.errors) == 5
    with pytest.raises(ValueError):
        definitions.parse_slo_definitions("a: {unknown: 1}")
