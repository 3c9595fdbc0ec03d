"""Near-duplicates by SimHash: every pair of fingerprints at a few differing bits, by a Gray-order index.

Fingerprints are cut into blocks of bits.  Two that differ in at most ``distance`` bits agree in all but
``distance`` of the blocks, so for some choice of the remaining blocks they share a whole bit pattern: the
top nodes of the index, one set of them per choice, which also deal the index over the cluster.  Under a
top node the fingerprints are sorted by Gray rank, and every 16 neighbours form a node, every 16 nodes the
next one.  A node keeps the bit pattern that all members share under the mask where they agree.  The
search walks pairs of nodes from the top: the bits in which the shared patterns differ accumulate to a
lower bound, a pair of whole groups beyond the distance is pruned, and a pair whose members already belong
together is not opened either.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sloflow.llm.buckets import by_bucket, dealt, whole_buckets
from sloflow.llm.common import text_batches, written
from sloflow.llm.components import connected, roots, unite

DISTANCE = 4
WORDS = 4
SEED = 42
#: Children of a node.
FAN = 16
#: Node pairs that are opened at once.
_OPENED = 20_000


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer.

    Words are separated by ASCII white space and A-Z is lower-cased; shingles have ``WORDS`` words and
    repeats count.  A shorter text is one shingle; a text without words has fingerprint zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - WORDS + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        part = hashes[i : i + 100_000]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of column text in a long column ``name``; null text is empty."""
    ddl = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            own = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, name])

    return docs.mapInArrow(marked, ddl)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of bit patterns (uint64) in Gray order, where neighbours differ in one bit."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_choices(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the bits that two fingerprints share under one choice of blocks; one top level per mask.

    Any choice finds all pairs.  More blocks mean more copies of a fingerprint and fewer members per top
    node; the cut with the least expected work for ``n`` fingerprints is taken.
    """
    best: tuple[float, list[int]] = (float("inf"), [])
    for blocks in range(distance + 1, distance + 5):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        chosen = [sum(x) for x in combinations(masks, blocks - distance)]
        work = sum(64 + n / 2 ** m.bit_count() for m in chosen)
        if work < best[0]:
            best = (work, chosen)
    return best[1]


class _Level:
    """Nodes over consecutive members: the bits set in all of them, those set in any, and their children."""

    def __init__(self, all_: np.ndarray, any_: np.ndarray, starts: np.ndarray):
        sizes = np.diff(starts, append=len(all_))
        pieces = -(-sizes // FAN)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.child = np.repeat(starts, pieces) + FAN * (np.arange(pieces.sum()) - first)
        self.n_children = np.minimum(FAN, np.repeat(starts + sizes, pieces) - self.child)
        self.all = np.bitwise_and.reduceat(all_, self.child)
        self.any = np.bitwise_or.reduceat(any_, self.child)
        self.starts = np.cumsum(pieces) - pieces


def _apart(a_all, a_any, b_all, b_any) -> np.ndarray:
    """Bits in which every member of one node differs from every member of the other."""
    return np.bitwise_count((a_all & ~b_any) | (b_all & ~a_any))


def link_sorted(values: np.ndarray, starts: np.ndarray, usable, distance: int = DISTANCE) -> np.ndarray:
    """The index search: parents that unite all rows of a bucket linked by at most ``distance`` bits.

    ``values`` (uint64) are sorted by Gray rank inside the buckets that begin at ``starts``; ``usable``
    says of rows i, j (arrays) whether this task compares them.
    """
    parent = np.arange(len(values))
    levels: list[_Level] = []
    all_, any_, begin = values, values, starts
    while not levels or len(all_) > len(starts):
        levels.append(_Level(all_, any_, begin))
        all_, any_, begin = levels[-1].all, levels[-1].any, levels[-1].starts
    top = len(levels) - 1
    whole = np.flatnonzero(np.diff(starts, append=len(values)) > 1)
    stack = [(top, whole[i : i + _OPENED], whole[i : i + _OPENED]) for i in range(0, len(whole), _OPENED)]
    while stack:
        level, a, b = stack.pop()
        now = levels[level]
        pairs = now.n_children[a] * now.n_children[b]
        at = np.repeat(np.arange(len(a)), pairs)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        width = now.n_children[b][at]
        i, j = now.child[a][at] + turn // width, now.child[b][at] + turn % width
        if level:
            below = levels[level - 1]
            near = (i <= j) & (_apart(below.all[i], below.any[i], below.all[j], below.any[j]) <= distance)
            i, j = i[near], j[near]
            if len(i):
                # Whole groups that already belong together need no look at their members.
                first = _leaf(levels, level - 1, np.concatenate([i, j]))
                root = roots(parent, first[0])
                one = _one_set(parent, levels, level - 1, np.concatenate([i, j]), root)
                open_ = ~(one[: len(i)] & one[len(i) :] & (root[: len(i)] == root[len(i) :]))
                i, j = i[open_], j[open_]
            stack += [(level - 1, i[k : k + _OPENED], j[k : k + _OPENED]) for k in range(0, len(i), _OPENED)]
        else:
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= distance)
            i, j = i[near], j[near]
            near = usable(i, j)
            unite(parent, i[near], j[near])
    roots(parent, np.arange(len(parent)))
    return parent


def _leaf(levels: list[_Level], level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of nodes and the row after their last one."""
    first, last = nodes, nodes
    for k in range(level, -1, -1):
        first, last = levels[k].child[first], levels[k].child[last] + levels[k].n_children[last] - 1
    return first, last + 1


def _one_set(parent: np.ndarray, levels: list[_Level], level: int, nodes: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether all rows of each node have the node's ``root``; only asked of leaf nodes, others are opened."""
    if level:
        return np.zeros(len(nodes), bool)
    first, stop = _leaf(levels, 0, nodes)
    same = np.ones(len(nodes), bool)
    for step in range(1, FAN):
        inside = np.flatnonzero(same & (first + step < stop))
        same[inside] = roots(parent, first[inside] + step) == root[inside]
    return same


def links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column fp, that join all at ``distance`` or fewer bits.

    Per bucket a fingerprint is linked with the first one of its set, so the result grows with the
    fingerprints and not with their pairs.
    """
    masks = block_choices(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tops = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for k, m in enumerate(signed)]))
    rows = fps.select("fp", tops.alias("top")).select("fp", "top.choice", "top.shared")
    keys = ["choice", "shared"]
    rows = dealt(rows, keys, F.xxhash64("fp"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_buckets(batches, [*keys, "of_a", "of_b"]):
            values = table.column("fp").to_numpy().view(np.uint64)
            sizes = np.diff(starts, append=len(values))
            bucket = np.repeat(np.arange(len(starts)), sizes)
            order = np.lexsort((gray_rank(values), bucket))
            values = values[order]
            own = table.column("own").to_numpy()[order]
            mixed = (table.column("of_a").to_numpy() != table.column("of_b").to_numpy())[order]
            # Rows of one block meet where both blocks are their own, and only there.
            parent = link_sorted(values, starts, lambda i, j, own=own, mixed=mixed: ~mixed[i] | (own[i] != own[j]), distance)
            linked = np.flatnonzero(parent != np.arange(len(parent)))
            ids = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[parent[linked]]), pa.array(ids[linked])], names=["a", "b"])

    return by_bucket(rows.select("fp", *keys, "of_a", "of_b", "own"), [*keys, "of_a", "of_b"], [], search, "a long, b long")


def groups(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per distinct fingerprint of ``marked`` (fp, doc_id, row): fp, component_id and stays.

    component_id is the smallest doc_id of the fingerprints that links reach, null where none has an id.
    ``stays`` is the ``row`` of the one document that represents the group: the smallest doc_id, then the
    smallest row.  Row must be unique.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    classes = written(marked.groupBy("fp").agg(first.alias("best")), "classes")
    joined = connected(links(classes.select("fp"), classes.count(), distance))
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select("fp", "root").join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("stays"))


def without_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` (any columns, with doc_id and text) that represent their groups, one for each.

    The smallest doc_id stays, of rows with equal ids the one that was read first; rows without an id stay
    only where their group has none with one.  Empty and null texts are one group, as their fingerprints
    are equal.
    """
    names = docs.columns
    row, fp = _free("row", names), _free("fp", names)
    kept = written(fingerprints(docs, fp).withColumn(row, F.monotonically_increasing_id()), "marked-documents")
    marked = kept.select(F.col(fp).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"))
    stays = groups(marked, distance).select(F.col("stays").alias(row)).distinct()
    return kept.join(stays.hint("shuffle_hash"), row, "left_semi").select(*[F.col(f"`{n}`") for n in names])


def _free(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to clash with no column."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name
