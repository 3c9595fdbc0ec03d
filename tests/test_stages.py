import pytest
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.operators import counters
from sloflow.operators.rules import ConfigError
from sloflow.session import SAMPLE
from sloflow.streaming import staged
from sloflow.plans.stages import Pipeline, run_counted, run_pipeline, run_with_reports, stage_names

# A scenario of our own: lines of a batch scheduler, one per finished run.
LINE_RE = (
    r"^(?P<when>[^|]*)\|job=(?P<job>[a-z/0-9-]+)\|queue=(?P<queue>\w+)\|exit=(?P<exit>\d+)\|secs=(?P<secs>[\d.]+)"
    r"\|owner=(?P<owner>[\w-]*),(?P<tier>[\w-]*),(?P<unit>[\w-]*)$"
)
RULES = """
rules:
  - slo_matcher: {domain: "nightly.*"}
    failure_conditions: [{operator: isNotEqualTo, key: exit, value: "0"}]
    additional_metadata: {slo_type: finished, slo_version: 2}
  - slo_matcher: {class: urgent}
    failure_conditions: [{operator: numberIsEqualOrHigherThan, key: secs, value: 90}]
    additional_metadata: {slo_type: in_time, slo_version: 2, share: 75}
"""
CONFIG = """
pipeline: [tailer, relabel, eventKeyGenerator, metadataClassifier, dynamicClassifier, %s sloEventProducer, prometheusExporter]
modules:
  tailer:
    tailedFile: ./runs.txt
    loglineParseRegexp: '%s'
    emptyGroupRE: '^none$'
  relabel:
    eventRelabelConfigs:
      - {source_labels: [queue], regex: "scratch|test", action: drop}
      - {source_labels: [job], regex: "(.*)/run-[0-9]+", target_label: job, replacement: "$1"}
  eventKeyGenerator: {filedSeparator: "@", overrideExistingEventKey: false, metadataKeys: [job, queue]}
  metadataClassifier: {sloDomainMetadataKey: owner, sloClassMetadataKey: tier, sloAppMetadataKey: unit}
  dynamicClassifier:
    regexpMatchesCsvFiles: [known.csv]
  statisticalClassifier:
    historyWindowSize: 15m
    defaultWeights: [{weight: 3, classification: {sloDomain: nightly, sloClass: relaxed}}]
  sloEventProducer: {rulesFiles: [rules.yaml]}
  prometheusExporter: {maximumUniqueEventKeys: 50, ExceededKeyLimitPlaceholder: others}
"""


def ran(job, code=0, secs=12.5, queue="main", owner=("none", "none", "none")):
    return f"monday|job={job}|queue={queue}|exit={code}|secs={secs}|owner={','.join(owner)}"


def run(spark, tmp_path, lines, extra=""):
    (tmp_path / "runs.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "known.csv").write_text('nightly,etl,urgent,"^load/[a-z]+@"\n')
    (tmp_path / "rules.yaml").write_text(RULES)
    result = run_pipeline(spark, CONFIG % (extra, LINE_RE), base_dir=str(tmp_path))
    return {row.value for row in counters.to_exposition(result).collect()}


def test_runs_are_counted_by_pattern(spark, tmp_path):
    lines = [ran("load/orders/run-7"), ran("load/orders/run-8", code=3, secs=90), ran("load/orders/run-9", queue="scratch"), "not a run"]
    got = run(spark, tmp_path, lines)
    # Two objectives, two results, four levels of detail; the scratch run and the odd line are gone.
    assert len(got) == 16
    prefix = "slo_domain_slo_class_slo_app_event_key:slo_events_total"
    rest = 'slo_app="etl",slo_class="urgent",slo_domain="nightly"'
    key = 'event_key="load/orders@main"'
    for result in ("success", "fail"):
        assert f'{prefix}{{{key},result="{result}",{rest},slo_type="finished",slo_version="2"}} 1' in got
        assert f'{prefix}{{{key},result="{result}",share="75",{rest},slo_type="in_time",slo_version="2"}} 1' in got


def test_own_class_is_remembered_for_the_key(spark, tmp_path):
    own = ran("load/stock", owner=("nightly-eu", "relaxed", "import"))
    got = run(spark, tmp_path, [ran("load/stock"), own, ran("load/stock", code=1)])
    name = "slo_domain_slo_class:slo_events_total"
    assert f'{name}{{result="success",slo_class="urgent",slo_domain="nightly",slo_type="finished",slo_version="2"}} 1' in got
    relaxed = 'slo_class="relaxed",slo_domain="nightly-eu",slo_type="finished",slo_version="2"'
    assert f'{name}{{result="success",{relaxed}}} 1' in got and f'{name}{{result="fail",{relaxed}}} 1' in got


def test_default_weights_classify_the_rest(spark, tmp_path):
    got = run(spark, tmp_path, [ran("report/daily")], "statisticalClassifier,")
    assert any('slo_app="statistically-guessed",slo_class="relaxed"' in text for text in got)


def test_history_needs_event_times(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a")], "event_id bigint, value string")
    text = "pipeline: [tailer, statisticalClassifier]\nmodules: {tailer: {loglineParseRegexp: '(?P<a>.)'}, statisticalClassifier: {}}"
    with pytest.raises(ConfigError, match="event times"):
        run_pipeline(spark, text, {"tailer": lines})
    timed = run_pipeline(spark, text, {"tailer": lines}, event_time=lambda df: F.timestamp_seconds(F.col("event_id")))
    assert timed.count() == 0


def test_reports(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(RULES)
    (tmp_path / "known.csv").write_text('nightly,etl,urgent,"^load/[a-z]+@"\n')
    lines = [ran("load/stock"), ran("load/stock", queue="scratch"), ran("report/daily"), "not a run"]
    (tmp_path / "runs.txt").write_text("\n".join(lines) + "\n")
    _, reports = run_with_reports(spark, CONFIG % ("", LINE_RE), base_dir=str(tmp_path))
    assert tuple(reports["lines"].first()) == (4, 1)
    assert reports["events after relabel"].first().events == 2
    found = {(r.result, r.events) for r in reports["classification"].collect()}
    assert found == {("classified", 1), ("unclassified", 1)}
    assert reports["results"].first().invalid_results == 0
    assert tuple(reports["event_keys"].first()) == (1, 50)


def test_samples_stage(spark):
    rows = [({"h": "/a"}, "2024-01-01 00:00:10", 1.0), ({"h": "/a"}, "2024-01-01 00:00:50", 4.0)]
    samples = spark.createDataFrame(rows, "labels map<string,string>, t string, value double").select(
        "labels", F.col("t").cast("timestamp").alias("ts"), "value"
    )
    config = """
pipeline: [prometheusIngester, eventKeyGenerator]
modules:
  prometheusIngester:
    apiUrl: http://localhost
    queryTimeout: 30s
    queries:
      - {type: counter_increase, query: requests_total, interval: 30s, offset: 5m, additionalLabels: {kind: http}}
      - {type: simple, query: up, dropLabels: [h]}
  eventKeyGenerator: {metadataKeys: [kind, h]}
"""
    inputs = {"prometheusIngester": {"requests_total": samples, "up": samples.limit(1)}}
    found = run_pipeline(spark, config, inputs).select(
        strmap.lookup(F.col("metadata"), "__eventKey").alias("k"), "quantity"
    )
    assert sorted(map(tuple, found.collect())) == [("", 1.0), ("http:/a", 3.0)]


@pytest.mark.parametrize(
    "text",
    [
        "pipeline: [relabel]\nmodules: {relabel: {}}",
        "pipeline: [tailer, prometheusExporter]\nmodules: {tailer: {}, prometheusExporter: {}}",
        "pipeline: [nope]\nmodules: {nope: {}}",
        "pipeline: [tailer]\nmodules: {}",
        "pipeline: [tailer]\nmodules: {tailer: {}}\nother: 1",
    ],
)
def test_bad_pipelines(text):
    with pytest.raises(ConfigError):
        Pipeline.parse(text)


def test_unknown_setting(spark):
    lines = spark.createDataFrame([("x",)], "value string")
    text = "pipeline: [tailer]\nmodules: {tailer: {loglineParseRegexp: x, surprise: 1}}"
    with pytest.raises(ConfigError, match="surprise"):
        run_pipeline(spark, text, {"tailer": lines})
    assert len(stage_names()) == 12


def test_counts_of_the_run_itself(spark, tmp_path):
    """One run counts what the lazy reports would count in a run each."""
    (tmp_path / "rules.yaml").write_text(RULES)
    (tmp_path / "known.csv").write_text('nightly,etl,urgent,"^load/[a-z]+@"\n')
    lines = [ran("load/stock"), ran("load/stock", queue="scratch"), ran("report/daily"), "not a run"]
    (tmp_path / "runs.txt").write_text("\n".join(lines) + "\n")
    text = CONFIG % ("", LINE_RE)
    results = []
    counts, others = run_counted(spark, text, lambda df: results.append(df.collect()), base_dir=str(tmp_path))
    done, reports = run_with_reports(spark, text, base_dir=str(tmp_path))
    assert sorted(map(str, results[0])) == sorted(map(str, done.collect()))
    assert counts and counts == {name: reports[name].first().asDict() for name in counts}
    assert set(counts) | set(others) == set(reports)


def lines_in_parts():
    """Three files of lines; the second and third need what the ones before them taught."""
    own = ("nightly", "urgent", "etl")
    parts = [
        [ran("load/orders", owner=own), ran("save/a"), ran("save/b", owner=("nightly", "calm", "etl")), "not a run"],
        [ran("load/orders", code=1), ran("save/a", owner=own), ran("save/b", secs=99), ran("load/items/run-3", secs=91)],
        [ran("save/a", code=2), ran("load/orders", owner=("nightly", "calm", "etl")), ran("save/b"), ran("save/new", queue="test")],
        [ran("load/orders"), ran("save/a", secs=200), ran("save/new")],
    ]
    return [[line.replace("monday", f"2024-05-01 10:{7 * n:02d}:{k:02d}") for k, line in enumerate(part)] for n, part in enumerate(parts)]


@pytest.mark.parametrize("extra", ["", "statisticalClassifier,"])
def test_stream_counts_like_a_batch_run(spark, tmp_path, extra):
    parts = lines_in_parts()
    time = lambda rows: F.to_timestamp(strmap.lookup(F.col("metadata"), "when"))
    (tmp_path / "known.csv").write_text('nightly,etl,urgent,"^load/[a-z]+@"\n')
    (tmp_path / "rules.yaml").write_text(RULES)
    (tmp_path / "runs.txt").write_text("\n".join(sum(parts, [])) + "\n")
    # One weight only: a draw does not depend on the id, which the two runs number differently.
    text = CONFIG % (extra, LINE_RE)
    expected = run_pipeline(spark, text, base_dir=str(tmp_path), event_time=time)
    (tmp_path / "in").mkdir()
    stream_text = text.replace("./runs.txt", "in").replace("    emptyGroupRE", "    follow: false\n    emptyGroupRE")
    for n, part in enumerate(parts):
        (tmp_path / "in" / f"{n}.log").write_text("\n".join(part) + "\n")
        staged.stream_pipeline(spark, stream_text, str(tmp_path / "out"), base_dir=str(tmp_path), event_time=time).awaitTermination()
    plain = lambda df: {(r.metric, r.labels): r.value for r in df.select("metric", strmap.text(F.col("labels")).alias("labels"), "value").collect()}
    got = plain(staged.read_counted(spark, str(tmp_path / "out")))
    assert got == plain(expected) and sum(got.values()) > 0


def test_stream_of_samples_grows_like_a_batch_run(spark, tmp_path):
    text = """
pipeline: [prometheusIngester, relabel]
modules:
  prometheusIngester:
    queries:
      - {query: hits, type: counter_increase, interval: 1m, additionalLabels: {from: hits}}
      - {query: took, type: histogram_increase, interval: 1m, dropLabels: [job]}
      - {query: level, type: simple, resultAsQuantity: false}
  relabel:
    eventRelabelConfigs: []
"""
    def rows(minutes):
        hits = [({"job": job}, minute * 60, float(10 * minute * (1 + (job == "b")))) for minute in minutes for job in "ab"]
        took = [({"job": "a", "le": le}, minute * 60, float(n * minute)) for minute in minutes for le, n in (("1", 2), ("2", 5), ("+Inf", 6))]
        level = [({"job": "a"}, minute * 60, 0.5 * minute) for minute in minutes]
        frame = lambda values: spark.createDataFrame(values, "labels map<string,string>, ts bigint, value double").withColumn("ts", F.timestamp_seconds("ts"))
        return {"hits": frame(hits), "took": frame(took), "level": frame(level)}

    plain = lambda df: sorted((str(r.event_time), sorted(r.metadata.items()), r.quantity) for r in df.collect())
    expected = plain(run_pipeline(spark, text, {"prometheusIngester": rows(range(1, 10))}))
    for minutes in (range(1, 4), range(4, 5), range(5, 10)):
        for name, frame in rows(minutes).items():
            frame.write.mode("append").parquet(str(tmp_path / name))
        streams = {name: spark.readStream.schema(SAMPLE).parquet(str(tmp_path / name)) for name in ("hits", "took", "level")}
        staged.stream_pipeline(spark, text, str(tmp_path / "out"), {"prometheusIngester": streams}, available_now=True).awaitTermination()
    got = staged.read_staged(spark, str(tmp_path / "out"))
    assert plain(got) == expected and len(expected) > 30
    assert {r.batch_id for r in got.collect()} >= {0, 1, 2}


def test_stream_without_rows_given(spark, tmp_path):
    with pytest.raises(ConfigError):
        staged.stream_pipeline(spark, "pipeline: [envoyAccessLogServer]\nmodules: {envoyAccessLogServer: {}}", str(tmp_path))
