"""Shards by a k-d tree: nodes are split at weighted medians along their widest metadata dimension.

A node that is to become ``m`` shards is split so that its halves hold ``m // 2`` and the rest of its bytes
in that proportion; leaves are shards of nearly equal bytes.  The cut is the weighted quantile in the
order (dimension, hash of the text, hash of the row), found for all nodes of a level together: the cluster
sums the bytes in a few hundred intervals per node, the interval with the quantile is cut again, until the
bytes in it no longer matter.  Rows with equal text and metadata are neighbours in that order, so they
share a shard unless a cut through them is needed to keep sizes equal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sloflow.llm.common import column_or_null, written

#: Intervals that a node's range is cut into at once; a round returns at most shards x INTERVALS sums.
INTERVALS = 2048
#: A cut may miss its quantile by this share of one shard.
TOLERANCE = 0.001
#: An open range with so few rows is read as it is, and the cut falls between two of them.
FEW_ROWS = 1_000
DIMENSIONS = ("size", "lang_code", "source_code")
#: Order inside equal values of the split dimension.
_TIES = ("text_hash", "row_hash")
_NODE_DDL = "node int, axis int, depth int, lead long, tie long, low long, high long, width long, right int"


@dataclass
class _Node:
    """A node and the search for its cut: the order's leading keys at the cut so far, and the open range."""

    first: int  # number of its first shard, by which it is known
    shards: int
    axis: int = 0
    lead: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    below: int = 0  # bytes before the open range
    target: int = 0
    few: bool = False
    done: bool = False

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // INTERVALS))

    def row(self) -> tuple:
        lead = [*self.lead, 0, 0]
        right = self.first + self.shards // 2
        return (self.first, self.axis, len(self.lead), lead[0], lead[1], self.low, self.high, self.width, right)

    def narrow(self, sums: list[tuple[int, int, int]], tolerance: float, ranges: dict[str, tuple[int, int]]) -> None:
        """Choose the interval with the quantile, from the bytes and rows of the intervals in order."""
        total = self.below
        for place, (part, size, count) in enumerate(sums):
            start = self.low + part * self.width
            if total + size <= self.target and place + 1 < len(sums):
                total += size
                continue
            if self.target - total <= tolerance:
                self.low, self.done = start, True
            elif total + size - self.target <= tolerance:
                self.low, self.done = min(start + self.width, self.high + 1), True
            elif self.width > 1:
                self.low, self.high, self.below = start, min(start + self.width - 1, self.high), total
            elif len(self.lead) < len(_TIES):
                # One value holds the quantile: go on by the next key among its rows.
                self.below = total
                self.low, self.high = ranges[_TIES[len(self.lead)]]
                self.lead.append(start)
            else:
                nearer = self.target - total > total + size - self.target
                self.low, self.done = start + nearer, True
            self.few = not self.done and count <= FEW_ROWS
            return
        self.done = True

    def finish(self, ordered: list[tuple[int, int, int, int]]) -> None:
        """Cut beside the row with the quantile; ``ordered`` has the open range's keys and sizes."""
        total = self.below
        for *keys, size in ordered:
            if total + size <= self.target:
                total += size
                continue
            after = self.target - total > total + size - self.target
            self.lead, self.low = keys[:2], keys[2] + after
            break
        else:
            *self.lead, last = ordered[-1][:3]
            self.low = last + 1
        self.done = True


def _on(rows: DataFrame, nodes: list[_Node]) -> DataFrame:
    """``rows`` beside their nodes, of which there are fewer than shards; rows of other nodes get nulls."""
    table = rows.sparkSession.createDataFrame([n.row() for n in nodes], _NODE_DDL)
    joined = rows.join(F.broadcast(table), "node", "left")
    return joined.withColumn("first_key", F.element_at(F.array(*DIMENSIONS), F.col("axis") + 1))


def _key():
    return F.when(F.col("depth") == 0, F.col("first_key")).when(F.col("depth") == 1, F.col("text_hash")).otherwise(F.col("row_hash"))


def _open_rows(rows: DataFrame, nodes: list[_Node]) -> DataFrame:
    """The rows in the nodes' open ranges, with the key that is searched."""
    leads = (F.col("depth") < 1) | (F.col("first_key") == F.col("lead"))
    ties = (F.col("depth") < 2) | (F.col("text_hash") == F.col("tie"))
    return _on(rows, nodes).where(leads & ties & _key().between(F.col("low"), F.col("high"))).withColumn("key", _key())


def _sums(rows: DataFrame, nodes: list[_Node]) -> dict[int, list[tuple[int, int, int]]]:
    """Interval, bytes and rows of the nodes' open ranges."""
    counted = _open_rows(rows, nodes).groupBy("node", F.expr("(key - low) div width").alias("part")).agg(F.sum("size"), F.count("*"))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for node, *sums in counted.collect():
        found.setdefault(node, []).append(tuple(sums))
    return {k: sorted(v) for k, v in found.items()}


def _finish(rows: DataFrame, nodes: list[_Node]) -> None:
    """Cut the nodes whose open ranges hold at most ``FEW_ROWS`` rows each."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for node, *keys in _open_rows(rows, nodes).select("node", "first_key", *_TIES, "size").collect():
        found.setdefault(node, []).append(tuple(keys))
    for node in nodes:
        node.finish(sorted(found[node.first]))


def _split(rows: DataFrame, nodes: list[_Node]) -> DataFrame:
    """``rows`` with node replaced by that of the half they belong to."""
    names = rows.columns
    lead, tie, low = F.col("lead"), F.col("tie"), F.col("low")
    first, text, own = F.col("first_key"), F.col("text_hash"), F.col("row_hash")
    left = (
        F.when(F.col("depth") == 0, first < low)
        .when(F.col("depth") == 1, (first < lead) | ((first == lead) & (text < low)))
        .otherwise((first < lead) | ((first == lead) & ((text < tie) | ((text == tie) & (own < low)))))
    )
    return _on(rows, nodes).withColumn("node", F.when(F.col("axis").isNull() | left, F.col("node")).otherwise(F.col("right"))).select(*names)


def kd_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Per document (doc_id, text, and lang, source where there are): doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text, none for null, plus 8.  Dimensions are the size, the language and
    the source; null metadata count as one value.  Shards are 0 to ``shards`` - 1, slots count from 0
    without gaps in each.  An empty table has no rows; repeated rows get places of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda name: F.coalesce(F.crc32(column_or_null(docs, name, "string").cast("binary")), F.lit(-1).cast("long"))
    # Half of the 64 bits, so that differences of hashes are longs.
    hashed = lambda *names: F.shiftrightunsigned(F.xxhash64(*names), 1)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        code("lang").alias("lang_code"),
        code("source").alias("source_code"),
        hashed(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = written(slim.withColumn("row_hash", hashed("doc_id", "at")).withColumn("node", F.lit(0)), "kd-rows")
    bounds = [f(c).alias(f"{n}_{c}") for c in (*DIMENSIONS, *_TIES) for n, f in (("low", F.min), ("high", F.max))]
    whole = rows.agg(F.sum("size").alias("bytes"), *bounds).first()
    ranges = {c: (whole[f"low_{c}"], whole[f"high_{c}"]) for c in (*DIMENSIONS, *_TIES)}
    tolerance = TOLERANCE * (whole["bytes"] or 0) / max(1, shards)
    nodes = [_Node(0, shards)] if whole["bytes"] else []
    while large := [n for n in nodes if n.shards > 1]:
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *bounds).collect()}
        large = [n for n in large if n.first in stats]
        for node in large:
            own = stats[node.first]
            spread = [(own[f"high_{c}"] - own[f"low_{c}"]) / max(1, ranges[c][1] - ranges[c][0]) for c in DIMENSIONS]
            node.axis = max(range(len(spread)), key=lambda i, spread=spread: (spread[i], -i))
            node.low, node.high = own[f"low_{DIMENSIONS[node.axis]}"], own[f"high_{DIMENSIONS[node.axis]}"]
            node.target = math.floor(own["bytes"] * (node.shards // 2) / node.shards)
            node.few = own["rows"] <= FEW_ROWS
        while waiting := [n for n in large if not n.done and not n.few]:
            sums = _sums(rows, waiting)
            for node in waiting:
                node.narrow(sums.get(node.first, []), tolerance, ranges)
        if few := [n for n in large if n.few and not n.done]:
            _finish(rows, few)
        if not large:
            break
        rows = _split(rows, large)
        nodes = [_Node(first, n) for node in large for first, n in ((node.first, node.shards // 2), (node.first + node.shards // 2, node.shards - node.shards // 2))]
    return numbered(rows.withColumnRenamed("node", "shard")).select("doc_id", "size", "text_crc32", "shard", "slot")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with shard and at, a number whose upper bits name the part it was read in) with slot.

    Rows are numbered inside each part, which has a bounded size; the parts' counts give the first slot of
    each.  No shard is brought to one task.
    """
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    return rows.withColumn("own", own).join(first, ["shard", "part"]).withColumn("slot", (F.col("own") + F.col("first")).cast("long"))
