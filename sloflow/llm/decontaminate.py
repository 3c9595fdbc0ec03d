"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-cased letters and digits with single blanks between them.  A passage is a
window of ``WINDOW`` characters of a benchmark item, or the whole item if that is shorter, found in a
document with at most one edit per ``WINDOW / EDITS`` characters.  Two strings of ``w`` characters within ``k``
edits share at least ``w + 1 - q * (k + 1)`` q-grams, whose diagonals (place in the document less place in
the item) differ by ``k`` at most.  So the shared q-grams are counted per item in diagonal bands that
overlap by ``k + 1``, the stretches that reach the bound within one window are kept, and an alignment
inside the band decides.  The filter loses no passage.  Texts that repeat themselves share very many q-grams;
bands are counted one by one, so these are taken in ranges of diagonals of at most ``HITS`` hits, with the same
result.  What a single diagonal step holds is bounded by the shorter of the two texts.

The benchmark is taken in blocks of bounded size; each block's index goes to the workers, and the documents
are read once per block without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import text_batches

Q, WINDOW, EDITS = 10, 60, 4
#: An item with fewer characters is too short for edits: it is a passage where it stands as whole words.
LEAST_CHARS = 20
#: Characters of benchmark text per block; the index takes about 20 bytes for each.
BLOCK_CHARS = 2_000_000
#: Shared q-grams that are held at once; more are taken in ranges of diagonals.
HITS = 4_000_000
#: Windows that are aligned at once.
_ALIGNED = 20_000
_DIAGONALS = 16  # in a step of a range
_BITMAP_BITS = 22
_END = 0x110000  # stands behind each text; no character
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each 16-bit character its lower case, or 0 where it is neither letter nor digit."""
    if not _fold:
        lower = [c.lower() if c.isalnum() else "\0" for c in map(chr, range(1 << 16))]
        _fold.append(np.array([ord(c) if len(c) == 1 else ord(c[0]) for c in lower], np.uint32))
    return _fold[0]


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, their places, starts): the normalised texts one after the other, each with an end mark
    behind it; the place of each character in the joined texts; where the texts start in those."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    folded = _folding()[np.minimum(raw, 0xFFFF)]
    folded = np.where(raw > 0xFFFF, raw, folded)
    folded[starts + sizes] = _END
    gap = folded == 0
    # A blank stays if a letter stands before it and it is the first of its run.
    lead = np.empty(len(folded), bool)
    lead[:1] = True
    lead[1:] = gap[:-1] | (folded[:-1] == _END)
    places = np.flatnonzero(~gap | ~lead)
    chars = folded[places]
    chars[chars == 0] = 32
    return chars, places, starts


def _qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the ``q`` characters from each place on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, hashes, size = np.array([_BASE], np.uint64), chars.astype(np.uint64), 1
    done, done_size = None, 0
    want = q
    while want:
        if want & 1:
            if done is None:
                done, done_size = hashes, size
            else:
                done = done[: len(done) - size] * power + hashes[done_size:][: len(done) - size]
                done_size += size
        want >>= 1
        if want:
            hashes = hashes[: len(hashes) - size] * power + hashes[size:]
            power, size = power * power, size * 2
    return done[:n] * _MIX


@dataclass
class Index:
    """A block of benchmark items: their q-grams by hash, and what each item demands."""

    ids: list[int | None]
    chars: np.ndarray
    start: np.ndarray
    length: np.ndarray
    window: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: Per q-gram its place among all characters, and that place behind the number of its hash: in order.
    at: np.ndarray
    key: np.ndarray
    #: By length the items below ``LEAST_CHARS``: hashes in order, and their items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str]) -> Index:
        chars, _, _ = normalized(texts)
        ends = np.flatnonzero(chars == _END)
        start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        length = ends - start
        # A blank at the end is the end of the last word.
        length -= (length > 0) & (chars[np.maximum(ends - 1, 0)] == 32)
        window = np.minimum(length, WINDOW)
        edits = window * EDITS // WINDOW
        hashes = _qgrams(chars)
        item = np.repeat(np.arange(len(ids)), np.where(length >= LEAST_CHARS, length - Q + 1, 0))
        first = np.repeat(np.cumsum(np.bincount(item, minlength=len(ids))) - np.bincount(item, minlength=len(ids)), np.bincount(item, minlength=len(ids)))
        place = np.arange(len(item)) - first
        own = hashes[start[item] + place] if len(item) else np.zeros(0, np.uint64)
        order = np.argsort(own, kind="stable")
        own, item, place = own[order], item[order], place[order]
        at = start[item] + place
        number = np.cumsum(np.append(False, own[1:] != own[:-1])[: len(own)])
        short = {}
        for size in np.unique(length[(length > 0) & (length < LEAST_CHARS)]).tolist():
            these = np.flatnonzero(length == size)
            words = _qgrams(chars, size)[start[these]]
            by_hash = np.argsort(words, kind="stable")
            short[size] = words[by_hash], these[by_hash]
        return cls(
            ids, chars, start, length, window, edits, window + 1 - Q * (edits + 1), own, item, place, at, number * (len(chars) + 1) + at, short
        )

    def bitmap(self) -> np.ndarray:
        seen = np.zeros(1 << _BITMAP_BITS, bool)
        seen[self.hashes >> np.uint64(64 - _BITMAP_BITS)] = True
        return seen


def _edits(index: Index, chars: np.ndarray, item: np.ndarray, at: np.ndarray, low: np.ndarray, band: int) -> np.ndarray:
    """Fewest edits between the item's window at ``at`` and any stretch of ``chars`` that starts on one of
    the ``band`` diagonals from ``low`` on and stays on them.  All windows have one size."""
    if not len(item):
        return np.zeros(0, np.int64)
    if len(item) > _ALIGNED:
        cuts = range(0, len(item), _ALIGNED)
        return np.concatenate([_edits(index, chars, item[c : c + _ALIGNED], at[c : c + _ALIGNED], low[c : c + _ALIGNED], band) for c in cuts])
    size = int(index.window[item[0]])
    window = index.chars[(index.start[item] + at)[:, None] + np.arange(size)]
    reach = (at + low)[:, None] + np.arange(size + band)
    inside = (reach >= 0) & (reach < len(chars))
    text = np.where(inside, chars[np.clip(reach, 0, len(chars) - 1)], _END)
    slope = np.arange(band)
    cost = np.zeros((len(item), band), np.int64)
    for r in range(size):
        step = cost + (text[:, r : r + band] != window[:, r : r + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
    return cost.min(1)


def _ranges(index: Index, hit: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of diagonals (place among the characters of the texts less that among those of the items) that cover
    all hits, each with about ``HITS`` of them or one step of ``_DIAGONALS``."""
    lowest = -len(index.chars)
    steps = np.zeros((int(hit[-1]) - lowest) // _DIAGONALS + 1, np.int64)
    ends = np.cumsum(count)
    begin = 0
    while begin < len(hit):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + HITS, side="right")))
        many = count[begin:end]
        entry = np.repeat(first[begin:end] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        steps += np.bincount((np.repeat(hit[begin:end], many) - index.at[entry] - lowest) // _DIAGONALS, minlength=len(steps))
        begin = end
    sums = np.cumsum(steps)
    found, begin = [], 0
    while begin < len(steps):
        done = sums[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sums, done + HITS, side="right")))
        found.append((lowest + begin * _DIAGONALS, lowest + end * _DIAGONALS))
        begin = end
    # The first hit of a band may lie one band above the diagonal that the band starts on.
    return [(found[0][0] - WINDOW, found[0][1]), *found[1:]]


def _within(index: Index, hit: np.ndarray, first: np.ndarray, count: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, entry) of the hits on the diagonals from ``low`` on and below ``high``."""
    base = index.key[first] - index.at[first]
    size = len(index.chars)
    begin = np.searchsorted(index.key, base + np.clip(hit - high + 1, 0, size))
    end = np.searchsorted(index.key, base + np.clip(hit - low + 1, 0, size))
    many = end - begin
    entry = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return np.repeat(hit, many), entry


def _regions(index: Index, chars: np.ndarray, place: np.ndarray, entry: np.ndarray, low: int | None, high: int | None) -> list[np.ndarray]:
    """(item, first character, last character, edits) of the passages in the bands that start on the diagonals from
    ``low`` on and below ``high``, or in all; places among the characters of the texts."""
    none = [np.zeros(0, np.int64)] * 4
    item, own = index.item[entry], index.place[entry]
    width = index.edits[item] + 1
    band = (place - own) // width
    # Each diagonal lies in two bands of 2 * (k + 1) diagonals: the one that starts here and the one before.
    place, item, own, band = np.tile(place, 2), np.tile(item, 2), np.tile(own, 2), np.concatenate([band, band - 1])
    if low is not None:
        starts = band * np.tile(width, 2) - index.start[item]
        ours = (starts >= low) & (starts < high)
        place, item, own, band = place[ours], item[ours], own[ours], band[ours]
    if not len(place):
        return none
    order = np.lexsort((place, band, item))
    place, item, own, band = place[order], item[order], own[order], band[order]
    needed = index.needed[item]
    last = np.arange(len(place)) + needed - 1
    fits = last < len(place)
    last = np.minimum(last, len(place) - 1)
    fits &= (item[last] == item) & (band[last] == band)
    fits &= place[last] - place <= index.window[item] + index.edits[item] - Q
    good = np.flatnonzero(fits)
    if not len(good):
        return none
    # Stretches of hits that overlap become one region.
    new = np.ones(len(good), bool)
    new[1:] = good[1:] > last[good[:-1]]
    head = good[new]
    tail = np.maximum.reduceat(last[good], np.flatnonzero(new))
    r_item, r_low = item[head], band[head] * (index.edits[item[head]] + 1)
    bounds = np.stack([head, tail + 1], 1).ravel()
    least, most = (f.reduceat(np.append(own, 0), bounds)[::2] for f in (np.minimum, np.maximum))
    begin, end = place[head], place[tail] + Q - 1
    edits = np.full(len(head), 1 << 30)
    for size in np.unique(index.window[r_item]):
        chosen = np.flatnonzero(index.window[r_item] == size)
        k = int(index.edits[r_item[chosen[0]]])
        span = 2 * (k + 1) + 2 * k
        stop = index.length[r_item[chosen]] - size
        # The window at the first hit first; others only where it does not do.
        edits[chosen] = _edits(index, chars, r_item[chosen], np.clip(own[head[chosen]], 0, stop), r_low[chosen] - k, span)
        for i in chosen[edits[chosen] > k].tolist():
            windows = np.arange(max(0, least[i] - (size - Q) - k), min(int(index.length[r_item[i]] - size), most[i] + k) + 1)
            if len(windows):
                edits[i] = _edits(index, chars, np.full(len(windows), r_item[i]), windows, np.full(len(windows), r_low[i] - k), span).min()
    found = np.flatnonzero(edits <= index.edits[r_item])
    return [r_item[found], begin[found], end[found], edits[found]]


def _short(index: Index, chars: np.ndarray) -> list[list[np.ndarray]]:
    """The same of the items below ``LEAST_CHARS``, where they stand as whole words."""
    found = []
    for size, (hashes, items) in index.short.items():
        grams = _qgrams(chars, size)
        where = np.arange(len(grams))
        before = (where == 0) | np.isin(chars[where - 1], (32, _END))
        # Each text ends with a mark, so there is a character behind each that matches.
        after = np.isin(chars[np.minimum(where + size, len(chars) - 1)], (32, _END))
        where = where[before & after]
        first, last = (np.searchsorted(hashes, grams[where], side=side) for side in ("left", "right"))
        many = last - first
        entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        where, item = np.repeat(where, many), items[entry]
        same = np.ones(len(where), bool)
        for k in range(size):
            same &= chars[where + k] == index.chars[index.start[item] + k]
        found.append([item[same], where[same], where[same] + size - 1, np.zeros(int(same.sum()), np.int64)])
    return found


def leaks(texts: list[str], index: Index, bitmap: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the passages; start and end are code points of the text, edits
    those of the best window that was aligned."""
    chars, places, starts = normalized(texts)
    parts = _short(index, chars)
    grams = _qgrams(chars)
    hit = np.flatnonzero(bitmap[grams >> np.uint64(64 - _BITMAP_BITS)])
    first = np.searchsorted(index.hashes, grams[hit], side="left")
    count = np.searchsorted(index.hashes, grams[hit], side="right") - first
    hit, first, count = (x[count > 0] for x in (hit, first, count))
    total = int(count.sum())
    if total > HITS:
        reach = 2 * (EDITS + 1)  # diagonals of a band
        for low, high in _ranges(index, hit, first, count):
            parts.append(_regions(index, chars, *_within(index, hit, first, count, low, high + reach), low, high))
    elif total:
        entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
        parts.append(_regions(index, chars, np.repeat(hit, count), entry, None, None))
    if not parts:
        return []
    r_item, begin, end, edits = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.searchsorted(starts, places[begin], side="right") - 1
    rows = sorted(zip(text.tolist(), r_item.tolist(), (places[begin] - starts[text]).tolist(), (places[end] + 1 - starts[text]).tolist(), edits.tolist(), strict=True))
    merged: list[tuple[int, int, int, int, int]] = []
    for row in rows:
        if merged and merged[-1][:2] == row[:2] and row[2] <= merged[-1][3]:
            t, i, a, b, e = merged[-1]
            merged[-1] = (t, i, a, max(b, row[3]), min(e, row[4]))
        else:
            merged.append(row)
    return merged


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Blocks of the benchmark (item_id long, text), each at most ``BLOCK_CHARS`` or one item; null texts
    carry nothing.  The table is read one partition at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size >= BLOCK_CHARS:
            yield Index.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index.of(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of ``benchmark`` in ``docs`` (doc_id long, text): doc_id, item_id, start, end, edits.

    One row per document row, item and stretch.  Null and empty texts have none, a repeated document row
    has its passages again; a null item_id is reported as null.  An empty benchmark finds nothing.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    ddl = "doc_id long, item_id long, start long, end long, edits int"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            seen = block.bitmap()
            for batch, texts in text_batches(batches):
                names = batch.column(0).to_pylist()
                rows = [(names[t], block.ids[i], a, b, e) for t, i, a, b, e in leaks(texts, block, seen)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        part = ids.mapInArrow(searched, ddl)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], ddl) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) in which no passage is found; nulls and empty texts stay."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            seen = block.bitmap()
            for batch, texts in text_batches(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in leaks(texts, block, seen)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
