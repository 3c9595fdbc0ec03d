"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by its characters, as the sum of vectors of its runs of three and four characters, and by a
vector of its own if the sample holds it often enough.  A bidirectional GRU goes over the words of a
window; attention pools its states to one logit.  A text is scored by all its windows of ``WINDOW`` words,
which overlap; its score is that of the worst window.

Training is multiple-instance learning on a bounded sample: a toxic document is toxic somewhere, so after
a first part on random windows each document is represented by the window that now scores highest.  Long
texts come in with that second part, unless their class has no others.  The gradients are written out below; a test compares them with differences.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import first_by_hash, text_batches

WINDOW, STRIDE = 48, 36
#: Characters of a piece; a longer word is several pieces in a row, so all of it is read.
PIECE = 24
#: Sample for training: documents per class, as whole texts, since a part of a toxic text need not be toxic.
#: Texts of at most so many characters come first, then longer ones, within so many characters of a class.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 6_000
CLASS_CHARS = SAMPLE_DOCS * SAMPLE_CHARS
#: Words with a vector of their own: the most frequent ones in at least so many documents of the sample, and
#: in such a share of them; rarer words are read by their characters alone.
MOST_WORDS, LEAST_DOCS, LEAST_SHARE = 8_000, 4, 0.01
RUNS, CHAR_SIZE, WORD_SIZE, STATE = 16_384, 12, 8, 8
EPOCHS, BATCH, RATE = 9, 128, 0.01
#: A small sample is gone through more often, until there were so many steps.
LEAST_STEPS = 160
#: Steps after which the windows are scored anew.
RESCORED = 40
THRESHOLD = 0.3
#: Pieces whose inputs a worker remembers.
MOST_PIECES = 400_000
_HOLD = 40.0  # update gate that keeps the state at padding
_STRIP = ".,;:!?\"'()[]{}<>*#&$%|"

Model = dict[str, np.ndarray]


# ---- layers; states and gates are (time, features, batch) -------------------------------------------


def gru(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States for gate inputs ``x`` (z, r and candidate) under recurrent weights ``u``, from a zero state."""
    steps, three, batch = x.shape
    size = three // 3
    states = np.empty((steps, size, batch), x.dtype)
    state = np.zeros((size, batch), x.dtype)
    for t in range(steps):
        own = u @ state
        # The logistic function by tanh, both gates at once.
        gates = own[: 2 * size] + x[t, : 2 * size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:size], gates[size:]
        fresh = np.tanh(x[t, 2 * size :] + r * own[2 * size :])
        if keep is not None:
            keep.append((z, r, own[2 * size :], fresh, state))
        state = fresh + z * (state - fresh)
        states[t] = state
    return states


def gru_back(grad: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` for gradients of the states."""
    steps, size, batch = grad.shape
    dx, du = np.empty((steps, 3 * size, batch), grad.dtype), np.zeros_like(u)
    d = np.zeros((size, batch), grad.dtype)
    for t in range(steps - 1, -1, -1):
        z, r, own, fresh, state = kept[t]
        d = d + grad[t]
        dn = d * (1 - z) * (1 - fresh * fresh)
        dx[t, :size] = d * (state - fresh) * z * (1 - z)
        dx[t, size : 2 * size] = dn * own * r * (1 - r)
        dx[t, 2 * size :] = dn
        through = np.concatenate([dx[t, : 2 * size], dn * r])
        du += through @ state.T
        d = d * z + u.T @ through
    return dx, du


def pool(states: np.ndarray, weights: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention pooling over time; ``real`` (time, batch) is false at padding.  Returns sums and shares."""
    logits = np.where(real, np.tensordot(states, weights, (1, 0)), np.float32(-1e9))
    shares = np.exp(logits - logits.max(0))
    shares /= shares.sum(0)
    return np.einsum("thb,tb->hb", states, shares), shares


def pool_back(grad: np.ndarray, states: np.ndarray, weights: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d_share = np.einsum("thb,hb->tb", states, grad)
    d_logit = shares * (d_share - (shares * d_share).sum(0))
    return grad[None] * shares[:, None] + d_logit[:, None] * weights[None, :, None], np.einsum("thb,tb->h", states, d_logit)


def directed(gates: np.ndarray, u: np.ndarray, way: str, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States of one direction for gate inputs, which at padding are set to hold the state."""
    size = u.shape[1]
    gates[:, :size][np.broadcast_to(~real[:, None], (gates.shape[0], size, gates.shape[2]))] = _HOLD
    kept = [] if keep is not None else None
    turned = gru(gates if way == "f" else gates[::-1], u, kept)
    if keep is not None:
        keep[way] = kept
    return turned if way == "f" else turned[::-1]


def both_ways(x: np.ndarray, m: Model, real: np.ndarray, keep: dict) -> np.ndarray:
    """Pooled states of both directions for inputs ``x`` (time, size, batch); padding is at the end."""
    states = [directed(np.matmul(m[f"w{way}"], x) + m[f"b{way}"][:, None], m[f"u{way}"], way, real, keep) for way in "fb"]
    together = np.concatenate(states, axis=1)
    pooled, shares = pool(together, m["a"], real)
    keep["pool"] = (together, shares)
    return pooled


def both_ways_back(grad: np.ndarray, x: np.ndarray, m: Model, real: np.ndarray, keep: dict, g: Model) -> np.ndarray:
    """Adds the gradients to ``g`` and returns that of ``x``."""
    together, shares = keep["pool"]
    d_states, d_a = pool_back(grad, together, m["a"], shares)
    g["a"] += d_a
    size = together.shape[1] // 2
    dx = np.zeros_like(x)
    for way, part in (("f", d_states[:, :size]), ("b", d_states[::-1, size:])):
        d_gates, du = gru_back(np.ascontiguousarray(part), m[f"u{way}"], keep[way])
        d_gates = d_gates if way == "f" else d_gates[::-1]
        d_gates[:, :size][np.broadcast_to(~real[:, None], (len(real), size, real.shape[1]))] = 0
        g[f"u{way}"] += du
        g[f"b{way}"] += d_gates.sum((0, 2))
        g[f"w{way}"] += np.einsum("tgb,tib->gi", d_gates, x, optimize=True)
        dx += np.matmul(m[f"w{way}"].T, d_gates)
    return dx


# ---- words ------------------------------------------------------------------------------------------


def pieces_of(token: str) -> list[str]:
    """The pieces of a token: lower case, without the marks around it, cut every ``PIECE`` characters."""
    word = token.lower().strip(_STRIP) or token
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def char_runs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the character runs of all pieces one after the other, and how many each piece has.

    A run is three or four characters of the piece between two marks for its ends, hashed to ``RUNS``.
    """
    size = PIECE + 2
    marked = "".join(f"\x01{p}\x01".ljust(size, "\0") for p in pieces)
    chars = np.frombuffer(marked.encode("utf-32-le"), np.uint32).reshape(len(pieces), size).astype(np.uint64)
    pair = chars[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + chars[:, 1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = pair[:, :-1] + chars[:, 2:] * np.uint64(0x165667B19E3779F9)
    four = three[:, :-1] + chars[:, 3:] * np.uint64(0x27D4EB2F165667C5)
    runs = np.concatenate([three ^ (three >> np.uint64(31)), four ^ (four >> np.uint64(29))], axis=1)
    real = np.concatenate([chars[:, 2:] != 0, chars[:, 3:] != 0], axis=1)
    return (runs[real] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % RUNS, real.sum(1)


def initial(n_words: int, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    m = {"chars": some(RUNS, CHAR_SIZE, scale=0.1), "words": np.concatenate([np.zeros((1, WORD_SIZE), np.float32), some(n_words, WORD_SIZE, scale=0.1)])}
    inputs = CHAR_SIZE + WORD_SIZE
    for way in ("f", "b"):
        m[f"w{way}"] = some(3 * STATE, inputs, scale=inputs**-0.5)
        m[f"u{way}"] = some(3 * STATE, STATE, scale=STATE**-0.5)
        m[f"b{way}"] = np.zeros(3 * STATE, np.float32)
    m["a"] = some(2 * STATE, scale=0.1)
    m["o"], m["ob"] = some(2 * STATE, scale=0.3), np.zeros(1, np.float32)
    return m


def word_inputs(pieces: list[str], known: np.ndarray, m: Model, keep: list | None = None) -> np.ndarray:
    """(inputs, pieces): vectors of the words, zero for those without one, over the sums of their runs."""
    out = np.empty((WORD_SIZE + CHAR_SIZE, len(pieces)), np.float32)
    out[:WORD_SIZE] = m["words"][known].T
    for i in range(0, len(pieces), 20_000):
        runs, count = char_runs(pieces[i : i + 20_000])
        scale = (1 / np.sqrt(count)).astype(np.float32)
        out[WORD_SIZE:, i : i + len(count)] = np.add.reduceat(m["chars"][runs], np.cumsum(count) - count).T * scale
        if keep is not None:
            keep.append((runs, count, scale))
    return out


def windows_of(n: int) -> list[tuple[int, int]]:
    """The overlapping windows over ``n`` pieces; the last ends with the text, a short text is one window."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


# ---- training ---------------------------------------------------------------------------------------


class _Sample:
    """Documents as numbers of distinct pieces, and their windows; labels are 0 or 1."""

    def __init__(self, texts: list[str], toxic: list[int]):
        tokens = [list(chain.from_iterable(pieces_of(w) for w in t.split())) for t in texts]
        often = Counter(chain.from_iterable(set(t) for t in tokens))
        top = sorted((w for w, n in often.items() if n >= max(LEAST_DOCS, LEAST_SHARE * len(texts))), key=lambda w: (-often[w], w))[:MOST_WORDS]
        self.vocabulary = {w: i + 1 for i, w in enumerate(top)}
        self.pieces = sorted(often)
        place = {w: i for i, w in enumerate(self.pieces)}
        self.known = np.array([self.vocabulary.get(w, 0) for w in self.pieces], np.int64)
        found, docs = [], []
        for d, own in enumerate(tokens):
            numbers = np.array([place[w] for w in own], np.int64)
            for a, b in windows_of(len(own)):
                row = np.full(WINDOW, -1, np.int64)
                row[: b - a] = numbers[a:b]
                found.append(row)
                docs.append(d)
        self.windows = np.array(found, np.int64).reshape(-1, WINDOW)
        self.doc = np.array(docs, np.int64)
        self.label = np.array(toxic, np.float32)[self.doc] if docs else np.zeros(0, np.float32)
        long = np.array([len(t) > SAMPLE_CHARS for t in texts], bool)[self.doc] if docs else np.zeros(0, bool)
        # Windows for the first part: of a long toxic text a random window is rarely toxic.
        self.early = ~long
        for kind in (0, 1):
            if long[self.label == kind].all():
                self.early |= self.label == kind


def loss_and_gradients(m: Model, windows: np.ndarray, label: np.ndarray, pieces: list[str], known: np.ndarray) -> tuple[float, Model]:
    """Mean cross entropy of windows (rows of numbers into ``pieces``, -1 behind the end) and its gradients."""
    used, at = np.unique(np.where(windows < 0, windows.max(1, keepdims=True), windows), return_inverse=True)
    at = at.reshape(windows.shape)
    keep_chars: list = []
    inputs = word_inputs([pieces[i] for i in used.tolist()], known[used], m, keep_chars)
    real = np.ascontiguousarray((windows >= 0).T)
    x = np.ascontiguousarray(inputs[:, at].transpose(2, 0, 1))
    keep: dict = {}
    pooled = both_ways(x, m, real, keep)
    logit = m["o"] @ pooled + m["ob"][0]
    score = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(np.maximum(logit, 0) - logit * label + np.log1p(np.exp(-np.abs(logit)))))
    g = {k: np.zeros_like(v) for k, v in m.items()}
    d = ((score - label) / len(label)).astype(x.dtype)
    g["o"] += pooled @ d
    g["ob"] += d.sum()
    dx = both_ways_back(m["o"][:, None] * d, x, m, real, keep, g)
    d_inputs = np.zeros_like(inputs)
    flat = dx.transpose(1, 2, 0).reshape(len(inputs), -1)
    spots = at.reshape(-1)
    for row in range(len(inputs)):
        d_inputs[row] = np.bincount(spots, weights=flat[row], minlength=len(used))
    np.add.at(g["words"], known[used], d_inputs[:WORD_SIZE].T)
    g["words"][0] = 0
    for i, (runs, count, scale) in enumerate(keep_chars):
        own = d_inputs[WORD_SIZE:, 20_000 * i : 20_000 * i + len(count)] * scale
        np.add.at(g["chars"], runs, np.repeat(own.T, count, axis=0))
    return loss, g


def _scores(m: Model, sample: _Sample) -> np.ndarray:
    inputs = word_inputs(sample.pieces, sample.known, m)
    gates = _gates(inputs, m)
    return np.concatenate([_window_scores(gates, sample.windows[i : i + 2048], m) for i in range(0, len(sample.windows), 2048)])


def train(texts: list[str], toxic: list[int], seed: int = 5) -> tuple[Model, dict[str, int]]:
    """The network and the words with a vector, from texts and labels 0 or 1.

    Without both labels among the texts that have words, the network is constant: its score is the share
    of toxic texts, or 0.5 where there are none at all.
    """
    sample = _Sample(texts, toxic)
    m = initial(len(sample.vocabulary), seed)
    if not len(sample.label) or sample.label.min() == sample.label.max():
        share = float(sample.label.mean()) if len(sample.label) else 0.5
        m["o"][:] = 0
        m["ob"][0] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return m, sample.vocabulary
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    per_epoch = -(-len(set(sample.doc.tolist())) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    start, scored = max(1, epochs // 6), 0
    score = np.zeros(0)
    for epoch in range(epochs):
        order = rng.permutation(len(sample.label))
        if epoch >= start:
            if not len(score) or step >= scored + RESCORED:
                score, scored = _scores(m, sample), step
            worst = np.lexsort((score, sample.doc))
            last = np.flatnonzero(np.append(np.diff(sample.doc[worst]) > 0, True))
            chosen = [worst[last]]
            # Every window of a clean document is clean.
            clean = order[sample.label[order] == 0]
            chosen.append(clean[: 2 * int((sample.label[worst[last]] == 0).sum())])
            picked = np.concatenate(chosen)
        else:
            rank = np.empty(len(order), np.int64)
            by_doc = order[np.argsort(sample.doc[order], kind="stable")]
            head = np.flatnonzero(np.append(True, np.diff(sample.doc[by_doc]) > 0))
            rank[:] = np.arange(len(order)) - np.repeat(head, np.diff(head, append=len(order)))
            picked = by_doc[rank < 2]
            picked = picked[sample.early[picked]]
        # The rarer class is repeated until it is half as frequent as the other at least.
        bad, good = picked[sample.label[picked] == 1], picked[sample.label[picked] == 0]
        few, many = sorted((bad, good), key=len)
        picked = rng.permutation(np.concatenate([many, np.resize(few, max(len(few), len(many) // 2))]))
        rate = RATE * max(0.1, 1 - epoch / epochs)
        for i in range(0, len(picked), BATCH):
            rows = picked[i : i + BATCH]
            # Some words lose their vector for a while, so characters must do as well.
            hidden = np.where(rng.random(len(sample.known)) < 0.3, 0, sample.known)
            _, g = loss_and_gradients(m, sample.windows[rows], sample.label[rows], sample.pieces, hidden)
            norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
            scale = min(1.0, 2.0 / max(norm, 1e-9))
            step += 1
            for k, v in g.items():
                v *= scale
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                m[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return m, sample.vocabulary


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounded sample (doc_id, text, toxic): per class the ``SAMPLE_DOCS`` labelled documents of at most
    ``SAMPLE_CHARS`` characters that come first in the order of a hash of the id.  Where a class has fewer, longer
    ones follow, the shorter first, until the class has ``CLASS_CHARS`` characters; a class with labelled texts has
    one at least.  ``labels`` (doc_id, toxic) decides who may be learned from; rows without id, text or label 0 or
    1 are left out, of rows with one id one stays."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = F.char_length("text")
    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    sized = known.join(usable.groupBy("doc_id").agg(F.min(size).alias("size")), "doc_id")
    kinds = sized.withColumn("kind", F.col("toxic") + F.when(F.col("size") > SAMPLE_CHARS, 2).otherwise(0))
    # At most four kinds of SAMPLE_DOCS ids come to the driver.
    rows = first_by_hash(kinds, "kind", "doc_id", SAMPLE_DOCS).select("doc_id", "toxic", "size", "place").collect()
    chosen = []
    for toxic in (0, 1):
        own = [r for r in rows if r["toxic"] == toxic]
        short = sorted((r for r in own if r["size"] <= SAMPLE_CHARS), key=lambda r: r["place"])
        long = sorted((r for r in own if r["size"] > SAMPLE_CHARS), key=lambda r: (r["size"], r["place"]))
        sizes = np.cumsum([r["size"] for r in short + long])
        n = min(SAMPLE_DOCS, max(1, int(np.searchsorted(sizes, CLASS_CHARS, side="right"))))
        chosen += [(r["doc_id"], toxic) for r in (short + long)[:n]]
    ids = docs.sparkSession.createDataFrame(chosen, known.select("doc_id", "toxic").schema)
    # Of rows with one id the first short text stays, or the shortest.
    order = F.struct(F.when(size > SAMPLE_CHARS, size).otherwise(0).alias("size"), F.col("text"))
    once = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(order).alias("first"))
    return once.select("doc_id", "first.text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, int]]:
    """Train on the driver, on the bounded sample of ``sample_rows``."""
    rows = sorted(sample_rows(docs, labels).collect())
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


# ---- scoring ----------------------------------------------------------------------------------------


def _gates(inputs: np.ndarray, m: Model) -> np.ndarray:
    """(pieces, gates of both directions): the input side of the word level, once per distinct piece."""
    return np.concatenate([(m[f"w{way}"] @ inputs + m[f"b{way}"][:, None]).T for way in "fb"], axis=1)


def _window_scores(gates: np.ndarray, windows: np.ndarray, m: Model) -> np.ndarray:
    """Scores of windows, rows of numbers into ``gates`` with -1 behind the end."""
    real = np.ascontiguousarray((windows >= 0).T)
    both = gates[np.maximum(windows, 0).T]
    half = gates.shape[1] // 2
    states = [directed(np.ascontiguousarray(both[:, :, k * half : (k + 1) * half].transpose(0, 2, 1)), m[f"u{way}"], way, real) for k, way in enumerate("fb")]
    pooled, _ = pool(np.concatenate(states, axis=1), m["a"], real)
    return 1 / (1 + np.exp(-(m["o"] @ pooled + m["ob"][0])))


class Scorer:
    """Scores whole texts; the input side of each distinct piece is computed once and remembered."""

    def __init__(self, model: Model, vocabulary: dict[str, int]):
        self.model, self.vocabulary = model, vocabulary
        self._forget()

    def _forget(self) -> None:
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.place: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * STATE), np.float32)

    def _learn(self, tokens: set[str]) -> None:
        cut = {t: pieces_of(t) for t in tokens}
        new = list(dict.fromkeys(p for own in cut.values() for p in own if p not in self.place))
        if new:
            known = np.array([self.vocabulary.get(p, 0) for p in new], np.int64)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, _gates(word_inputs(new, known, self.model), self.model)])
        for t, own in cut.items():
            self.tokens[t] = tuple(self.place[p] for p in own)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text: that of its worst window; a text without words has the constant's score."""
        if len(self.place) > MOST_PIECES or len(self.tokens) > 2 * MOST_PIECES:
            self._forget()
        words = [t.split() for t in texts]
        unknown = {w for own in words for w in own if w not in self.tokens}
        if unknown:
            self._learn(unknown)
        rows, docs = [], []
        get = self.tokens.__getitem__
        for d, own in enumerate(words):
            numbers = np.fromiter(chain.from_iterable(map(get, own)), np.int64)
            n = len(numbers)
            if n > WINDOW:
                starts = np.array([a for a, _ in windows_of(n)])
                rows.append(numbers[starts[:, None] + np.arange(WINDOW)])
            elif n:
                row = np.full((1, WINDOW), -1, np.int64)
                row[0, :n] = numbers
                rows.append(row)
            if n:
                docs.append(np.full(len(rows[-1]), d))
        out = np.full(len(texts), float(1 / (1 + np.exp(-self.model["ob"][0]))))
        if rows:
            windows, doc = np.concatenate(rows), np.concatenate(docs)
            score = np.concatenate([_window_scores(self.gates, windows[i : i + 2048], self.model) for i in range(0, len(windows), 2048)])
            start = np.flatnonzero(np.append(True, np.diff(doc) > 0))
            out[doc[start]] = np.maximum.reduceat(score, start)
        # A text without words is not worse than a clean one.
        empty = np.array([not own for own in words], bool)
        out[empty] = np.minimum(out[empty], 0.0 if self.model["o"].any() else 1.0)
        return np.clip(out, 0.0, 1.0)


_scorers: dict[str, Scorer] = {}


def _scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model."""
    model, vocabulary, key = shared.value
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model, vocabulary)
    return _scorers[key]


def _shared(df: DataFrame, learned: tuple[Model, dict[str, int]]):
    return df.sparkSession.sparkContext.broadcast((*learned, os.urandom(8).hex()))


def score(docs: DataFrame, learned: tuple[Model, dict[str, int]]) -> DataFrame:
    """Per document (doc_id long, text): doc_id, score.  Null text is empty; a text without words scores 0
    (under a constant network, as every other text)."""
    shared = _shared(docs, learned)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(texts).astype(np.float64))], names=["doc_id", "score"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(scored, "doc_id long, score double")


def without_toxic(docs: DataFrame, learned: tuple[Model, dict[str, int]], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) that score below ``threshold``."""
    shared = _shared(docs, learned)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch, texts in text_batches(batches):
            yield batch.filter(pa.array(scorer.scores(texts) < threshold))

    return docs.mapInArrow(kept, docs.schema)
