"""Token-id files with fixed-width bit packing.

Format: a folder of Parquet files; a row is a block of whole consecutive documents, closed once it holds
``block_ids`` ids.

| column | content |
|---|---|
| shard, first | number of the part, and the ids before this block in it; shards follow each other in order of document id |
| n_ids, bits | ids in the block; bits per id, the fewest that hold every id of the vocabulary |
| payload | ids from the lowest bit up, without gaps: 64 ids take ``8 * bits`` bytes |
| doc_ids, doc_ends | the documents, and where each ends in the block |
| least, most | smallest and largest document id, for skipping row groups |

As the width is fixed, id ``i`` of a block stands at bit ``i * bits``: any stretch is unpacked with numpy
without reading what lies before it.  Spark writes the files, so a lost executor leaves no half a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sloflow.llm.common import text_batches
from sloflow.llm.wordcodes import word_ids

BLOCK_IDS = 65_536
#: Payload that a worker gathers before it hands blocks over.
_HANDED_BYTES = 4_000_000

_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("bits", pa.int32()),
        ("payload", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int64())),
        ("least", pa.int64()),
        ("most", pa.int64()),
    ]
)
_BLOCK_DDL = (
    "shard int, first long, n_ids long, bits int, payload binary, doc_ids array<long>, doc_ends array<long>, "
    "least long, most long"
)


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold the ids below ``vocab_size``."""
    return max(1, (max(vocab_size, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each without gaps; groups of 64 ids are packed side by side."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for lane in range(64):
        at, shift = divmod(lane * bits, 64)
        words[:, at] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block, read from the bytes that hold them."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    group, last = start // 64, -(-stop // 64)
    part = payload[group * 8 * bits : last * 8 * bits]
    words = np.zeros(((last - group) * bits,), "<u8")
    words.view(np.uint8)[: len(part)] = np.frombuffer(part, np.uint8)
    words = words.reshape(-1, bits)
    mask = np.uint64((1 << bits) - 1)
    lanes = np.empty((last - group, 64), np.uint32)
    for lane in range(64):
        at, shift = divmod(lane * bits, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, at + 1] << np.uint64(64 - shift))
        lanes[:, lane] = value & mask
    return lanes.reshape(-1)[start - group * 64 : stop - group * 64]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id long, text) and write them in ascending order of doc_id.

    Null text is empty: the document has the end id only.  A null doc_id comes first; rows with equal ids
    are kept, in order of reading.  Documents are dealt out by ranges of (doc_id, order of reading), so
    one repeated id does not fill one part.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "read"]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("read"))
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        bits = bits_for(max(coder.vocab_size, end_id + 1))
        shard = TaskContext.get().partitionId()
        first, ids, names = 0, [], []
        rows: list[dict] = []

        def close() -> None:
            nonlocal first, ids, names
            ends = np.cumsum([len(x) for x in ids])
            known = [x for x in names if x is not None]
            rows.append(
                {
                    "shard": shard, "first": first, "n_ids": int(ends[-1]), "bits": bits,
                    "payload": pack(np.concatenate(ids), bits), "doc_ids": names, "doc_ends": ends.tolist(),
                    "least": min(known, default=None), "most": max(known, default=None),
                }
            )
            first += int(ends[-1])
            ids, names = [], []

        held = 0
        for batch, texts in text_batches(batches):
            for name, got in zip(batch.column(0).to_pylist(), coder.with_end(texts, end_id), strict=True):
                ids.append(got)
                names.append(name)
                held += len(got)
                if held >= block_ids:
                    close()
                    held = 0
            if sum(len(r["payload"]) for r in rows) >= _HANDED_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)
                rows = []
        if ids:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    ordered.mapInArrow(blocks, _BLOCK_DDL).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of a token folder: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, the ids."""
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)
    fields = [("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    ddl = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                ends = row["doc_ends"]
                starts = [0, *ends[:-1]]
                each = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["shard"]] * len(ends), pa.int32()),
                    pa.array([row["first"] + a for a in starts], pa.int64()),
                    pa.array([len(x) for x in each], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    needed = blocks.select("shard", "first", "n_ids", "bits", "payload", "doc_ids", "doc_ends")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written part, so the table to broadcast is as small as the list of files.
    bases = (
        blocks.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return (
        needed.mapInArrow(documents, ddl)
        .join(F.broadcast(bases), "shard")
        .withColumn("start", F.col("start") + F.col("base"))
        .drop("shard", "base")
    )
