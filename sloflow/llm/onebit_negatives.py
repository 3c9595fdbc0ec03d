"""Hard negatives by rotated one-bit codes with error intervals, and integer scores for what the intervals leave.

Vectors become integers, ``floor(scale * x)``, and are turned by one random rotation.  The signs of a turned
vector are its code ``c`` (of length one), and the stored alignment ``a = <x, c>`` is the best multiple of it; the
rest ``x - a * c`` is coded the same way, ``CODES`` times, until its stored length is about a sixth of the
vector's.  A query is turned too and written in ``BITS`` bit planes, so its product with a code is a sum of
popcounts.  The sum of alignment times product estimates the score; by Cauchy and Schwarz it is wrong by at most
the lengths of the two rests times those of their partners.  Where this interval meets neither the best scores so
far nor the window that is asked for, the row is out for certain; the others are scored exactly.
Nothing is left to chance: the result equals that of scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloflow.llm.common import written
from sloflow.llm.query_blocks import Best, against_all, matrix, usable

SCALE = 256
CODES, BITS = 4, 6
SEED = 11
_TILE = 128
#: Score below every other.
_NONE = np.iinfo(np.int64).min
_CODED = "row long, vec_id long, label string, anchor boolean, size int, whole binary, codes binary, aligned binary, length double, rest double"


def _turn(size: int) -> np.ndarray:
    """A random rotation of ``size`` dimensions, which are padded to full words of 64."""
    padded = -(-size // 64) * 64
    return np.linalg.qr(np.random.default_rng([SEED, padded]).standard_normal((padded, padded)))[0][:size]


def encode(whole: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x CODES x words, lowest bit first), alignments (rows x CODES) and the length of what they leave."""
    left = whole.astype(np.float64) @ turn
    size = left.shape[1]
    codes = np.zeros((len(left), CODES, size // 64), np.uint64)
    aligned = np.zeros((len(left), CODES))
    for level in range(CODES):
        sign = left >= 0
        codes[:, level] = np.packbits(sign, axis=1, bitorder="little").view("<u8")
        aligned[:, level] = np.abs(left).sum(1) / np.sqrt(size)
        left = left - np.where(sign, 1.0, -1.0) * (aligned[:, level] / np.sqrt(size))[:, None]
    return codes, aligned, np.sqrt((left * left).sum(1))


class _Queries:
    """Bit planes of turned queries, and the bounds that go with them."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray):
        turned = whole.astype(np.float64) @ turn
        low = turned.min(1)
        step = (turned.max(1) - low) / ((1 << BITS) - 1)
        number = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
        told = low[:, None] + step[:, None] * number
        bits = (number[:, None, :] >> np.arange(BITS, dtype=np.uint8)[None, :, None]) & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view("<u8")
        self.low, self.step, self.sum = low, step, told.sum(1)
        self.told, self.missed = np.sqrt((told * told).sum(1)), np.sqrt(((turned - told) ** 2).sum(1))
        self.size = turned.shape[1]

    def interval(self, own: np.ndarray, codes: np.ndarray, aligned: np.ndarray, length: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each query ``own`` with each row."""
        estimate = np.zeros((len(own), len(codes)))
        for level in range(codes.shape[1]):
            weighed = np.zeros(estimate.shape, np.uint32)
            ones = np.zeros(len(codes), np.uint32)
            for word in range(codes.shape[2]):
                code = np.ascontiguousarray(codes[:, level, word])
                ones += np.bitwise_count(code)
                for plane in range(BITS):
                    weighed += np.bitwise_count(self.planes[own, plane, word][:, None] & code).astype(np.uint32) << np.uint32(plane)
            within = self.step[own][:, None] * weighed + self.low[own][:, None] * ones
            estimate += (2 * within - self.sum[own][:, None]) * (aligned[:, level] / np.sqrt(self.size))
        # The last term covers the rounding of all sums above.
        wrong = self.told[own][:, None] * rest + self.missed[own][:, None] * length + 1e-9 * (self.told[own][:, None] * length + 1)
        return estimate - wrong, estimate + wrong


def coded(vectors: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """The usable rows of ``vectors`` (vec_id, label, embedding) with their integers, codes, alignments and rest."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    rows = rows.where(F.col("label").isNotNull() & usable("embedding") & (F.size("embedding") > 0)).withColumn("row", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(4)).to_numpy()
            for d in np.unique(size).tolist():
                own = batch.take(pa.array(np.flatnonzero(size == d)))
                x = np.floor(scale * own.column(4).flatten().to_numpy().reshape(-1, d))
                if x.size and np.abs(x).max() >= 2**31:
                    raise ValueError(f"a component times {scale} does not fit in 32 bits")
                whole = x.astype("<i4")
                codes, aligned, rest = encode(whole, _turn(d))
                wide = whole.astype(np.float64)
                binary = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (whole, codes, aligned)]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), own.column(3), pa.array(np.full(len(x), d, np.int32)), *binary, pa.array(np.sqrt((wide * wide).sum(1))), pa.array(rest)],
                    names=["row", "vec_id", "label", "anchor", "size", "whole", "codes", "aligned", "length", "rest"],
                )

    return rows.select("row", "vec_id", "label", "anchor", "embedding").mapInArrow(work, _CODED)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond 64 bits an error."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    exact = [sum(a * b for a, b in zip(p, r, strict=True)) for p, r in zip(q.tolist(), x.tolist(), strict=True)]
    return np.array(exact, np.int64)


class _Side:
    """Rows of one size out of a table: integers, codes and bounds."""

    def __init__(self, table: pa.Table, size: int):
        words = -(-size // 64)
        self.whole = matrix(table.column("whole"), "<i4", size)
        self.codes = matrix(table.column("codes"), "<u8", CODES * words).reshape(-1, CODES, words)
        self.aligned = matrix(table.column("aligned"), "<f8", CODES)
        self.length, self.rest, self.row = (table.column(c).to_numpy() for c in ("length", "rest", "row"))
        self.label = np.array(table.column("label").to_pylist(), object)
        ids = table.column("vec_id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        self.id = pc.fill_null(ids, 0).to_numpy()


def _by_size(table: pa.Table) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    size = table.column("size").to_numpy()
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, table.take(pa.array(at)), at


class _Cell:
    """Shared by both passes: queries of each size, and pairs whose interval may count."""

    def __init__(self, queries: pa.Table):
        self.queries = {d: (_Side(part, d), _Queries(matrix(part.column("whole"), "<i4", d), _turn(d)), at) for d, part, at in _by_size(queries)}

    def rows(self, chunk: pa.Table) -> None:
        for d, part, _ in _by_size(chunk):
            if d in self.queries:
                self.meet(*self.queries[d], _Side(part, d))


class _Positives(_Cell):
    """The best rows of the query's own label."""

    def __init__(self, queries: pa.Table, k: int):
        super().__init__(queries)
        self.best = Best(queries.num_rows, k, np.int64(_NONE))
        self.query_row = queries.column("row").to_numpy()

    def meet(self, asked: _Side, planes: _Queries, slots: np.ndarray, there: _Side) -> None:
        for label in set(asked.label) & set(there.label):
            mine, theirs = np.flatnonzero(asked.label == label), np.flatnonzero(there.label == label)
            for i in range(0, len(mine), _TILE):
                own = mine[i : i + _TILE]
                _, high = planes.interval(own, there.codes[theirs], there.aligned[theirs], there.length[theirs], there.rest[theirs])
                p, q = np.nonzero((high >= self.best.bar[slots[own]][:, None]) & (asked.row[own][:, None] != there.row[theirs]))
                p, q = own[p], theirs[q]
                self.best.add(slots[p], _scores(asked.whole[p], there.whole[q]), there.id[q], there.row[q], there.known[q])

    def result(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_row[b.slot]), pa.array(b.id, mask=~b.known), pa.array(b.row), pa.array(b.score)], names=["anchor_row", "positive_id", "positive_row", "positive_score"]
        )


class _Negatives(_Cell):
    """The best rows of other labels within the window of each positive."""

    def __init__(self, queries: pa.Table, k: int, low: int, high: int):
        super().__init__(queries)
        wanted = queries.column("positives").combine_chunks()
        self.of = np.repeat(np.arange(queries.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64))
        positive = wanted.flatten()
        self.positive_row, self.positive = (positive.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        self.anchor_row = queries.column("row").to_numpy()[self.of]
        # Least and greatest whole score of each window; there is none in an empty one.
        self.least, self.most = -(-low * self.positive // 100), high * self.positive // 100
        self.first = np.searchsorted(self.of, np.arange(queries.num_rows + 1))
        self.best = Best(len(self.of), k, np.int64(_NONE))
        self.slots = queries.num_rows

    def meet(self, asked: _Side, planes: _Queries, slots: np.ndarray, there: _Side) -> None:
        # A query's bounds are those of its windows taken together.
        floor, ceiling = np.full(self.slots, np.inf), np.full(self.slots, -np.inf)
        for i in range(0, len(slots), _TILE):
            own = np.arange(i, min(i + _TILE, len(slots)))
            open_ = self.least <= self.most
            np.minimum.at(floor, self.of[open_], np.maximum(self.least, self.best.bar)[open_].astype(np.float64))
            np.maximum.at(ceiling, self.of[open_], self.most[open_].astype(np.float64))
            low, high = planes.interval(own, there.codes, there.aligned, there.length, there.rest)
            fit = (high >= floor[slots[own]][:, None]) & (low <= ceiling[slots[own]][:, None]) & (asked.label[own][:, None] != there.label)
            p, q = np.nonzero(fit)
            p = own[p]
            score = _scores(asked.whole[p], there.whole[q])
            # Each pair once per window of its query.
            start, count = self.first[slots[p]], self.first[slots[p] + 1] - self.first[slots[p]]
            pair = np.repeat(np.arange(len(p)), count)
            window = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(pair))
            inside = (score[pair] >= self.least[window]) & (score[pair] <= self.most[window])
            pair, window = pair[inside], window[inside]
            self.best.add(window, score[pair], there.id[q[pair]], there.row[q[pair]], there.known[q[pair]])
            floor[slots[own]], ceiling[slots[own]] = np.inf, -np.inf

    def result(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchor_row[b.slot]), pa.array(self.positive_row[b.slot]), pa.array(b.id, mask=~b.known), pa.array(b.row), pa.array(b.score)],
            names=["anchor_row", "positive_row", "negative_id", "negative_row", "negative_score"],
        )


def hard_negatives(
    vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Per anchor and positive the best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    ``vectors`` has vec_id, label (any type) and embedding; other columns are not looked at.  A row's score is its
    inner product with the anchor in integers ``floor(scale * x)``, higher first, ties to the smaller vec_id (null
    last), then in order of reading.  Rows with a null label, a null vector, or null or non-finite components take no
    part.  Only vectors of equal size meet; an empty one takes no part.  A repeated row is another row:
    also another anchor, and a positive of its copy.  The windows of a negative score are empty.  A component that
    does not fit in 32 bits, or a score beyond 64, is an error.  No rows or no anchors give an empty table.

    Each block of rows hands on at most ``positives`` rows per anchor, or ``negatives`` per positive, so the
    shuffle after a pass follows the anchors times the blocks of rows.
    """
    table = written(coded(vectors, anchor, scale), "coded-vectors")
    names = ["row", "vec_id", "label", "size", "whole", "codes", "aligned", "length", "rest"]
    rows, anchors = table.select(*names), table.where("anchor").select(*names)
    ddl = "anchor_row long, positive_id long, positive_row long, positive_score long"
    found = against_all(anchors, rows, ["label"], lambda queries: _Positives(queries, positives), ddl)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    best = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")
    wanted = best.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("positive_row", "positive_score"))).alias("positives"))
    asked = anchors.join(wanted, "row")
    ddl = "anchor_row long, positive_row long, negative_id long, negative_row long, negative_score long"
    found = against_all(asked, rows, ["label"], lambda queries: _Negatives(queries, negatives, low, high), ddl)
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(best, ["anchor_row", "positive_row"]).join(named, "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
