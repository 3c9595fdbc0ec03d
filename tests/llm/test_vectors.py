"""Hard negatives, collision search and whitening against brute force, and on odd rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sloflow.llm import block_whitening, collision_search, onebit_negatives, query_blocks

DDL = "vec_id long, label string, embedding array<double>, row int, score string, unit string, kind string, size string, index string, x string, n string, component int"
CLASH = (1, "s", "u", "k", "z", "i", "x", "n", 3)


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, *CLASH) for i, label, v in rows], DDL).repartition(3)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(query_blocks, "QUERY_BLOCK", 7)
    monkeypatch.setattr(query_blocks, "ROW_BLOCK", (20, 60))


# ---- hard negatives ----


def slow_negatives(rows, modulus, positives=5, negatives=3):
    rows = [(n, i, label, [int(np.floor(256 * x)) for x in v]) for n, (i, label, v) in enumerate(rows) if label is not None and fine(v)]
    found = []
    for n, i, label, v in rows:
        if i is None or i % modulus:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j, m, other) for m, j, other, w in rows if m != n and len(w) == len(v)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for score, _, j, _, _ in [s for s in scored if s[4] == label][:positives]:
            fit = [s for s in scored if s[4] != label and 50 * -score <= 100 * -s[0] <= 95 * -score]
            found += [(i, j, rank + 1, s[2], -score, -s[0]) for rank, s in enumerate(fit[:negatives])]
    return sorted(found, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 30), st.integers(0, 2**32))
def test_intervals_hold(size, n, seed):
    rng = np.random.default_rng(seed)
    q, x = (rng.integers(-300, 300, (n, size)) * rng.integers(0, 2, (n, 1)) for _ in range(2))
    turn = onebit_negatives._turn(size)
    codes, aligned, rest = onebit_negatives.encode(x, turn)
    low, high = onebit_negatives._Queries(q, turn).interval(np.arange(n), codes, aligned, np.sqrt((x * x).sum(1)), rest)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    # Each code takes the best multiple of it away, so the rest is never longer.
    assert (rest <= np.sqrt((x * x).sum(1)) + 1e-6).all()


def test_rests_are_short():
    x = np.floor(np.random.default_rng(1).standard_normal((500, 64)) * 256)
    _, _, rest = onebit_negatives.encode(x, onebit_negatives._turn(64))
    assert (rest / np.sqrt((x * x).sum(1))).mean() < 0.25


@pytest.mark.parametrize("size", [3, 40, 130])
def test_hard_negatives(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((4, size))
    rows = []
    for i in range(300):
        v = centres[rng.integers(4)] + rng.standard_normal(size) * 0.6
        rows.append((i, "abcde"[min(4, int(rng.integers(9)))], (v / np.linalg.norm(v)).round(2).tolist()))
    rows += [(1000 + i, "ab"[i % 2], rows[0][2]) for i in range(40)]  # copies: ties, also of an anchor
    odd = [(400, None, rows[0][2]), (404, "a", None), (408, "a", [None] * size), (412, "a", [float("nan")] * size), (416, "a", [float("inf")] * size), (420, "a", []), (424, "a", [0.0] * size), (428, "alone", rows[5][2]), (432, "a", [0.5, 0.5])]
    got = onebit_negatives.hard_negatives(table(spark, rows + odd), F.col("vec_id") % 4 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == slow_negatives(rows + odd, 4) and got


def test_hard_negatives_of_odd_tables(spark):
    one = [(0, "a", [0.5, 0.5, 0.1]), (0, "a", [0.5, 0.5, 0.1]), (None, "b", [0.4, 0.4, 0.1]), (3, "b", [0.4, 0.4, 0.1])]
    got = onebit_negatives.hard_negatives(table(spark, one), F.col("vec_id") == 0).collect()
    # A repeated anchor is two anchors, each the positive of the other; the row without vec_id comes last.
    assert sorted(map(tuple, got), key=repr) == slow_negatives(one, 1_000_000) and len(got) == 4
    empty = table(spark, one).limit(0)
    assert onebit_negatives.hard_negatives(empty, F.col("vec_id") == 0).count() == 0
    assert onebit_negatives.hard_negatives(table(spark, one), F.col("vec_id") == 77).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        onebit_negatives.hard_negatives(table(spark, [(0, "a", [1e30])]), F.col("vec_id") == 0).count()


def test_long_scores_are_exact():
    q = np.array([[2**31 - 1, 2**31 - 1]], np.int32)
    assert onebit_negatives._scores(q, np.array([[2**31 - 1, -(2**31)]], np.int32)).tolist() == [-(2**31 - 1)]


# ---- collision search ----


def slow_nearest(rows, modulus, k=5):
    rows = [(n, i, np.array(v, float)) for n, (i, _, v) in enumerate(rows) if fine(v) and any(v)]
    found = {}
    for n, i, v in rows:
        if i is None or i % modulus:
            continue
        others = [(m, j, w) for m, j, w in rows if m != n and len(w) == len(v)]
        x = collision_search._tame(np.array([v] + [w for _, _, w in others])).T
        every = np.arange(1, len(others) + 1)
        size = collision_search.lengths(x)
        score = collision_search.dots(x, np.zeros_like(every), x, every) / (size[0] * size[1:])
        ranked = sorted((-s, j is None, j or 0, m) for s, (m, j, _) in zip(score, others, strict=True))[:k]
        found[n] = [(i, rank + 1, None if none else j, -s) for rank, (s, none, j, _) in enumerate(ranked)]
    return found


@pytest.mark.parametrize("size", [2, 24, 64])
def test_nearest(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((6, size))
    near = [centres[rng.integers(6)] + rng.standard_normal(size) * rng.choice([0.05, 1]) for _ in range(600)]
    apart = list(rng.standard_normal((900, size)))
    rows = [(i, "l", (v * 10.0 ** rng.integers(-3, 4)).tolist()) for i, v in enumerate(near + apart)]
    rows += [(5000 + i, "l", rows[0][2]) for i in range(30)]  # a group of copies around a query
    odd = [(6000, None, None), (6010, "a", [None] * size), (6020, "a", [float("nan")] * size), (6030, "a", [0.0] * size), (6040, "a", []), (6050, "a", [1e300] * size), (6060, "a", [1e-300] * size)]
    expected = [r for v in slow_nearest(rows + odd, 10).values() for r in v]
    got = [tuple(r) for r in collision_search.nearest(table(spark, rows + odd), F.col("vec_id") % 10 == 0).collect()]
    assert {(q, rank) for q, rank, _, _ in got} == {(q, rank) for q, rank, _, _ in expected}
    assert len(set(got) & set(expected)) >= 0.97 * len(expected)
    # The copies are tied exactly, so the smallest ids come first.
    assert [r for r in sorted(got) if r[0] == 0] == [r for r in sorted(expected) if r[0] == 0]
    exact = {(q, j): s for q, _, j, s in expected}
    assert all(exact.get((q, j), s) == s for q, _, j, s in got)


def test_nearest_of_odd_tables(spark):
    rows = [(0, "a", [1.0, 0.0]), (0, "a", [1.0, 0.0]), (None, "a", [1.0, 0.1]), (7, "a", [-1.0, 0.0]), (8, "a", [1.0, 2.0, 3.0])]
    got = [tuple(r) for r in collision_search.nearest(table(spark, rows), F.col("vec_id") == 0).collect()]
    assert sorted(got, key=repr) == sorted((r for v in slow_nearest(rows, 1_000_000).values() for r in v), key=repr)
    assert [r[2] for r in sorted(got)[:2]] == [0, 0]
    assert collision_search.nearest(table(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0
    assert collision_search.nearest(table(spark, rows), F.col("vec_id") == 8).count() == 0


def test_threshold():
    assert 0 < collision_search.threshold() < collision_search.TABLES
    assert collision_search.threshold(miss=0.001) < collision_search.threshold(miss=0.05)


# ---- whitening ----


@pytest.mark.parametrize(("size", "blocks"), [(3, (8, 1024)), (40, (16, 1024)), (40, (16, 9))])
def test_whiten(spark, monkeypatch, size, blocks):
    monkeypatch.setattr(block_whitening, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(block_whitening, "BLOCK_COLUMNS", blocks[1])
    rng = np.random.default_rng(size)
    data = rng.standard_normal((200, size)) @ rng.standard_normal((size, size)) + 3
    rows = [(i, "a", v.tolist()) for i, v in enumerate(data)] + [(3, None, data[3].tolist()), (None, "b", data[4].tolist())]
    odd = [(900, "a", None), (901, "a", [None] * size), (902, "a", [float("nan")] * size), (903, "a", [float("-inf")] * size), (904, "a", [])]
    got = block_whitening.whiten(table(spark, rows + odd)).collect()
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, _, v in rows])
    n, total = len(x), x.sum(0)
    off = n * x - total
    centred = off / n
    variance = centred.T @ centred / n
    values, axes = np.linalg.eigh(variance)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    count = min(32, size)
    assert len(got) == n * count and {r["n"] for r in got} == {n}
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["component"]), set()).add((r["deviation"], r["whitened"], r["explained"]))
    flipped = {}
    for (i, _, _), z, d in zip(rows, centred @ axes / np.sqrt(values), (off * off).sum(1), strict=True):
        for c in range(count):
            deviation, whitened, explained = min(by_id[i, c + 1])
            assert deviation == d and explained == pytest.approx(values[c] / np.trace(variance), rel=1e-9)
            flipped.setdefault(c, []).append((whitened, z[c]))
    for pairs in flipped.values():
        a, b = np.array(pairs).T
        assert np.allclose(a, b, atol=1e-6) or np.allclose(a, -b, atol=1e-6)


def test_whiten_of_odd_tables(spark):
    assert block_whitening.whiten(table(spark, [(1, "a", [0.5])]).limit(0)).count() == 0
    assert block_whitening.whiten(table(spark, [(1, "a", None)])).count() == 0
    same = block_whitening.whiten(table(spark, [(1, "a", [0.5, 1.0]), (2, "a", [0.5, 1.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"]) for r in same) == [(i, c, 0, None, 0.0) for i in (1, 2) for c in (1, 2)]
    line = block_whitening.whiten(table(spark, [(i, "a", [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    with pytest.raises(ValueError, match="entries"):
        block_whitening.whiten(table(spark, [(1, "a", [0.5]), (2, "a", [0.5, 1.0])]))
