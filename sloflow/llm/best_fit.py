"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces of at most ``size`` tokens; only longer documents are cut.  The pieces are sorted
by length over the cluster with a range partitioning, which gives every piece its global rank.  Lengths
and gaps are integers up to ``size``, so the sorted pieces are at most ``size`` runs of equal length and
the sorted gaps as many runs of equal gap.  A round takes the longest unplaced run as a whole: the
successor sweep goes up the sorted gaps from the smallest that fits, pieces that want the same gap are
served by rank, the gaps shrink, and the next round follows.  What the rounds work on has a size given by
``size`` and not by the data; the pieces stay on the executors, which look up their rank in the rounds'
outcome.  This is best-fit decreasing, exactly.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import text_batches, written
from sloflow.llm.wordcodes import word_ids

SIZE = 4096

_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id long, text): ids of the whole text and the end id, cut every ``size``.

    Null text is empty and gives a piece with the end id alone.  ``with_ids`` adds the ids as bytes of
    little-endian unsigned 32-bit integers.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch, texts in text_batches(batches):
            columns: list[list] = [[] for _ in schema]
            for name, ids in zip(batch.column(0).to_pylist(), coder.with_end(texts, end_id), strict=True):
                for number, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    raw = part.tobytes()
                    for column, value in zip(columns, (name, number, start, len(part), zlib.crc32(raw), raw), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(cut, _PIECE_DDL + ", ids binary" * with_ids)


def rounds(runs: list[tuple[int, int]], size: int = SIZE) -> np.ndarray:
    """Best fit over runs (length, count) in descending order of length.

    Returns rows (rank of the first piece, first sequence, pieces per sequence, first offset, length) in
    order of rank: piece ``rank`` goes to sequence ``first + (rank - from) // per`` and stands there after
    ``(rank - from) % per`` others of its length.
    """
    gaps: list[int] = []  # sorted; of each the stretches of sequences that have it
    open_: dict[int, list[tuple[int, int]]] = {}
    rank, sequences, found = 0, 0, []

    def put(gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, count))

    for length, left in runs:
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                gap, first, count = size, sequences, -(-left // (size // length))
                sequences += count
            per = gap // length
            full, rest = divmod(min(left, count * per), per)
            used = full + (rest > 0)
            found.append((rank, first, per, size - gap, length))
            put(gap - per * length, first, full)
            put(gap - rest * length, first + full, used - full)
            put(gap, first + used, count - used)
            rank += full * per + rest
            left -= full * per + rest
    return np.array(found, np.int64).reshape(-1, 5)


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A piece longer than ``size`` or without tokens is an error of the caller.  Equal lengths are served in
    order of doc_id, piece and reading.
    """
    spark = parts.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = written(parts.withColumn("read", F.monotonically_increasing_id()), "pieces")
    keys = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("read")]
    ordered = written(
        kept.repartitionByRange(count, *keys).sortWithinPartitions(*keys).drop("read")
        # The number of the part in the upper bits, the place in it below.
        .withColumn("place", F.monotonically_increasing_id()),
        "sorted-pieces",
    )
    # One row per part and one per length: bounded by the partitions and by ``size``.
    held = dict(ordered.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    runs = sorted(((r["length"], r["count"]) for r in ordered.groupBy("length").count().collect()), reverse=True)
    if runs and (runs[0][0] > size or runs[-1][0] < 1):
        raise ValueError(f"pieces must have 1 to {size} tokens")
    part_numbers = np.array(sorted(held), np.int64)
    before = np.cumsum([0, *(held[x] for x in part_numbers.tolist())])[:-1]
    plan = spark.sparkContext.broadcast(rounds(runs, size))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(len(names)).to_numpy(zero_copy_only=False)
            rank = before[np.searchsorted(part_numbers, place >> 33)] + (place & ((1 << 33) - 1))
            step = steps[np.searchsorted(steps[:, 0], rank, side="right") - 1]
            whole, turn = np.divmod(rank - step[:, 0], step[:, 2])
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(step[:, 1] + whole), pa.array(step[:, 3] + turn * step[:, 4])], names=[*names, "sequence_id", "offset"]
            )

    return ordered.select(*names, "place").mapInArrow(placed, _PIECE_DDL + ", sequence_id long, offset long")
