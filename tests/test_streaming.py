"""A drained stream of several micro-batches gives the result of one batch run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sloflow.operators import counters
from sloflow.operators.classify import classify_dynamic
from sloflow.operators.series import counter_increase, held_for
from sloflow.session import RAW_EVENT, SAMPLE
from sloflow.sources.loglines import parse_log_lines, read_log_stream
from sloflow.sources.matchers import Matcher, matchers_df
from sloflow.streaming import jobs
from sloflow.streaming.state import DeltaState
from test_events import START, classify_one_by_one, random_events, raw

EXACT = [Matcher("csv", "m", "c", "POST:/b")]
REGEXP = [Matcher("r1", "m", "c", "^GET:/a")]


def feed(spark, df, folder, order, parts=3):
    """Write the rows as files that arrive one after the other."""
    total = df.count()
    ranked = df.orderBy(order).collect()
    for part in range(parts):
        rows = ranked[part * total // parts : (part + 1) * total // parts]
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(folder)
        yield part


def files(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_learned_over_batches_and_restarts(spark, tmp_path):
    rows = random_events(9, 150)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    given = matchers_df(spark, EXACT)
    for _ in feed(spark, raw(spark, rows), source, "event_id"):
        # each file is handled by a new query that resumes from the checkpoint
        jobs.classify_stream(files(spark, source, RAW_EVENT), path, given, REGEXP).awaitTermination()
    schema = classify_dynamic(raw(spark, rows), given, REGEXP).schema
    found = jobs.read_batches(spark, f"{path}/events", schema).orderBy("event_id").collect()
    got = [(tuple(r.classification) if r.classification else None, r.classified_by) for r in found]
    assert got == classify_one_by_one(rows, EXACT, REGEXP)


def test_increase_over_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, second = [], 0
    for i in range(120):
        second += rng.choice([10, 30, 400])
        rows.append(({"n": rng.choice("ab")}, START + timedelta(seconds=second), float(rng.randrange(50))))
    df = spark.createDataFrame(rows, SAMPLE)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    list(feed(spark, df, source, "ts"))
    jobs.increase_stream(files(spark, source, SAMPLE), path, 60, 300).awaitTermination()
    events = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/events")
    streamed = events.groupBy("event_time", F.element_at("metadata", "n").alias("n")).agg(F.sum("quantity").alias("q"))
    batch = counter_increase(df, 60, 300).filter("value > 0")
    assert {(r.event_time, r.n, r.q) for r in streamed.collect()} == {
        (r.poll_ts, r.labels["n"], r.value) for r in batch.collect()
    }


def test_old_series_leave_the_state(spark, tmp_path):
    rows = [({"n": "old"}, START, 1.0), ({"n": "new"}, START + timedelta(hours=2), 2.0), ({"n": "new"}, START + timedelta(hours=3), 5.0)]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    list(feed(spark, spark.createDataFrame(rows, SAMPLE), source, "ts"))
    jobs.increase_stream(files(spark, source, SAMPLE), path, 60, 300, lateness=60).awaitTermination()
    left = jobs.sample_state(path).read(spark).collect()
    assert [(r.labels, r.value) for r in left] == [({"n": "new"}, 5.0)]


def test_ended_runs_leave_the_state(spark, tmp_path):
    rows = [("a", START), ("b", START + timedelta(hours=1)), ("b", START + timedelta(hours=1, seconds=60))]
    df = spark.createDataFrame(rows, "k string, ts timestamp").withColumn("value", F.lit(1.0))
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    list(feed(spark, df, source, "ts"))
    jobs.hold_stream(files(spark, source, df.schema), path, ["k"], 60, 60).awaitTermination()
    left = jobs.hold_state(path, ["k"]).read(spark).collect()
    assert [r.k for r in left] == ["b"]
    assert [r.k for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows").collect()] == ["b"]


@pytest.mark.parametrize("live", [False, True])
def test_future_rows_end_no_other(spark, tmp_path, live):
    """One batch with a wrong clock in a replay, or one in every batch of a live stream."""
    start = datetime.now().replace(microsecond=0) - timedelta(seconds=300) if live else START
    at = lambda s: start + timedelta(seconds=s)
    normal = [[("a", at(0), 1.0), ("b", at(0), 2.0)], [("a", at(60), 5.0), ("b", at(60), 3.0)], [("a", at(120), 6.0), ("b", at(120), 9.0)]]
    ahead = [[("c", at(10**6 + 60 * k), 1.0)] for k in range(3)]
    parts = [n + a for n, a in zip(normal, ahead, strict=True)] if live else [normal[0], ahead[0], *normal[1:]]
    samples, held = str(tmp_path / "samples"), str(tmp_path / "held")
    for part in parts:
        rows = [({"n": k}, ts, v) for k, ts, v in part]
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(samples)
        spark.createDataFrame(part, "k string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(held)
    jobs.increase_stream(files(spark, samples, SAMPLE), str(tmp_path / "i"), 60, 300, lateness=60).awaitTermination()
    events = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "i/events"))
    growth = {r.n: r.q for r in events.groupBy(F.element_at("metadata", "n").alias("n")).agg(F.sum("quantity").alias("q")).collect()}
    batch = counter_increase(spark.read.parquet(samples), 60, 300).filter("value > 0")
    twin = {r.n: r.q for r in batch.groupBy(F.element_at("labels", "n").alias("n")).agg(F.sum("value").alias("q")).collect()}
    assert growth == twin and growth["a"] == 5.0 and growth["b"] == 7.0
    table = spark.read.parquet(held)
    jobs.hold_stream(files(spark, held, table.schema), str(tmp_path / "h"), ["k"], 120, 60).awaitTermination()
    streamed = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "h/rows"))
    expected = {(r.k, r.ts) for r in held_for(table, ["k"], 120, 60).collect()}
    assert {(r.k, r.ts) for r in streamed.collect()} == expected and ("a", at(120)) in expected


def test_cap_over_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, START + timedelta(seconds=i), 0, rng.choice("abcdefgh")) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, event_time timestamp, rule int, event_key string")
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    list(feed(spark, df, source, "event_id", 4))
    jobs.cap_stream(files(spark, source, df.schema), path, 5).awaitTermination()
    streamed = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/events")
    batch = counters.cap_event_keys(df, 5)
    assert {(r.event_id, r.event_key) for r in streamed.collect()} == {(r.event_id, r.event_key) for r in batch.collect()}


def test_counters_over_batches(spark, tmp_path):
    rows = [
        (i, START, "k", "fail" if i % 5 == 0 else "success", "d", "c", "a", {"t": str(i % 2)}, 1.0) for i in range(30)
    ]
    schema = (
        "event_id int, event_time timestamp, event_key string, result string, slo_domain string, slo_class string, "
        "slo_app string, labels map<string,string>, quantity double"
    )
    df = spark.createDataFrame(rows, schema)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    list(feed(spark, df, source, "event_id"))
    jobs.counter_stream(files(spark, source, df.schema), path).awaitTermination()

    def plain(table):
        return {(r.metric, tuple(sorted(r.labels.items())), r.value) for r in table.collect()}

    assert plain(jobs.read_counters(spark, path)) == plain(counters.cascade_counters(df))


def test_hold_over_batches(spark, tmp_path):
    seconds = [0, 60, 120, 300, 360, 420, 480, 540, 600, 900]
    rows = [(k, START + timedelta(seconds=s)) for k in ("a", "b") for s in seconds if k == "a" or s != 420]
    df = spark.createDataFrame(rows, "k string, ts timestamp").withColumn("value", F.lit(1.0))
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    list(feed(spark, df, source, "ts", 4))
    jobs.hold_stream(files(spark, source, df.schema), path, ["k"], 120, 60).awaitTermination()
    streamed = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    assert {(r.k, r.ts) for r in streamed.collect()} == {
        (r.k, r.ts) for r in held_for(df, ["k"], 120, 60).collect()
    }


def test_log_stream_resumes(spark, tmp_path):
    logs, path = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    for part, text in enumerate(("a=1\nbad\n", "a=2\n")):
        (logs / f"log.{part}").write_text(text)
        parsed = parse_log_lines(read_log_stream(spark, str(logs)), r"^a=(?P<a>\d)$")
        jobs.append_to(parsed, path).awaitTermination()
    found = spark.read.parquet(f"{path}/rows")
    assert sorted((r.value, r.malformed) for r in found.collect()) == [("a=1", False), ("a=2", False), ("bad", True)]


def test_repeats_and_windows(spark, tmp_path):
    rows = [(i // 2, START + timedelta(seconds=30 * i), "x", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, event_time timestamp, k string, quantity double")
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    once = jobs.without_repeats(files(spark, source, df.schema).withColumn("event_time", F.col("event_time")))
    jobs.append_to(once, str(tmp_path / "once")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once") + "/rows").count() == 100


def test_backlog(spark):
    progress = [
        {
            "timestamp": "t",
            "sources": [
                {"description": "files", "metrics": {"numBytesOutstanding": "2000000"}},
                {"description": "kafka", "endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7, "2": 3}}},
            ],
        }
    ]
    rows = {r.source: (r.unit, r.backlog) for r in jobs.source_backlog(spark, progress).collect()}
    assert rows == {"files": ("bytes", 2_000_000), "kafka": ("records", 7)}
    assert jobs.source_backlog(spark, progress, 1024**2).count() == 1


STATE = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("at", T.LongType())])


def test_state_follows_the_changes(spark, tmp_path):
    """Random updates against a dict, with repeated batches, ended rows, and whole buckets now and then."""
    state = DeltaState(str(tmp_path / "s"), STATE, lambda: F.col("k"), lambda: F.col("at"), buckets=8, least=2)
    rng = random.Random(1)
    expected, mark = {}, None
    for number in range(9):
        rows = {f"k{rng.randrange(60)}": (rng.randrange(1000), 100 * number + rng.randrange(50)) for _ in range(40 if number == 0 else 6)}
        changes = spark.createDataFrame([(k, v, at) for k, (v, at) in rows.items()], STATE)
        if number == 6:  # a batch that failed half-way is repeated with other results
            state.write(spark.createDataFrame([("k1", -1, 600), ("zz", -1, 600)], STATE), number)
        touched = state.touched(changes)
        seen = {r.k: (r.v, r["at"]) for r in state.read(spark, number, touched).collect()}
        assert {k: seen.get(k) for k in rows} == {k: expected.get(k) for k in rows}
        state.advance(spark, number, 100 * number, 350)
        state.write(changes, number)
        mark = 100 * (number - 1) - 350 if number else None
        expected = {k: x for k, x in {**expected, **rows}.items() if mark is None or x[1] >= mark}
        assert {r.k: (r.v, r["at"]) for r in state.read(spark).collect()} == expected
    assert list((tmp_path / "s/whole").iterdir())


def test_small_batches_write_little(spark, tmp_path):
    state = DeltaState(str(tmp_path / "s"), STATE, lambda: F.col("k"))
    state.write(spark.range(20_000).select(F.concat(F.lit("key-"), "id").alias("k"), F.col("id").alias("v"), F.lit(0).alias("at")), 0)
    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    first = size(tmp_path / "s")
    for number in range(1, 8):
        batch = spark.createDataFrame([(f"key-{number}", number, number)], STATE)
        known = state.read(spark, number, state.touched(batch))
        assert len(known.inputFiles()) < 12 and known.count() < 1_000
        state.write(batch, number)
    assert size(tmp_path / "s") - first < first / 4
    assert state.read(spark).count() == 20_000 and state.read(spark).filter("v = at AND v > 0").count() == 7


def test_capped_counters_with_exemplars_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [
        (i, START + timedelta(seconds=rng.randrange(400)), 0, rng.choice("abcdefgh"), rng.choice(["fail", "success", "odd"]), "d", rng.choice("xy"), "a",
         {"t": str(i % 2)}, float(rng.randrange(3)), {"m": rng.choice("pq")})
        for i in range(80)
    ]
    schema = (
        "event_id long, event_time timestamp, rule int, event_key string, result string, slo_domain string, slo_class string, "
        "slo_app string, labels map<string,string>, quantity double, metadata map<string,string>"
    )
    df = spark.createDataFrame(rows, schema)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in feed(spark, df, source, "event_time", 4):
        jobs.counter_stream(files(spark, source, df.schema), path, limit=4, exemplar_keys=["m"]).awaitTermination()
    valid = df.filter(F.col("result").isin("fail", "success"))
    batch = counters.cascade_counters(counters.cap_event_keys(valid, 4), exemplar_keys=["m"])

    def plain(table):
        return {
            (r.metric, tuple(sorted(r.labels.items())), r.value, (r.exemplar["at"]["event_id"], r.exemplar["value"], r.exemplar["labels"]) if r.exemplar else None)
            for r in table.collect()
        }

    assert plain(jobs.read_counters(spark, path, exemplars=True)) == plain(batch)
