"""Secret scans: fixed patterns, and the cost of guessing a value that stands where a credential would.

The guess cost is that of the cheapest way to cut a value into words, dates, repeats, keyboard walks and
brute-force stretches, in bits; it is found by dynamic programming over the end of the last piece.  A
value in a credential context that costs ``LEAST_BITS`` or more becomes a span of kind ``guess``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import text_batches

#: The kinds in order, and what they match.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run is taken whole, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6

#: Further places where a credential stands; group 1 is the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api_?key|access_?key|private_?key|auth|bearer)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"',;<>()]+)""",
    re.I | re.A,
)
#: Values that are cheaper than this many bits are words, dates or patterns that need no hiding.
LEAST_BITS = 40.0

#: Passwords that are tried first, most common first.
COMMON = (
    "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey "
    "letmein shadow master 696969 mustang 666666 qwertyuiop 123321 1234567890 superman 654321 1qaz2wsx 7777777 121212 "
    "qazwsx 123qwe killer trustno1 jordan zxcvbn asdfgh hunter buster soccer harley batman andrew tigger sunshine "
    "iloveyou charlie robert thomas hockey ranger daniel starwars 112233 george computer michelle jessica pepper "
    "freedom ginger princess joshua cheese amanda summer ashley nicole matthew access yankees dallas austin thunder "
    "taylor matrix admin welcome login root test guest changeme secret default"
).split()
#: Rows of keyboards.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm")
_LEET = str.maketrans("4@310$57", "aaeiosst")
#: Year first, day first and a year alone; at one place several of them may match.
_DATES = (
    re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"),
    re.compile(r"(?:19|20)\d\d"),
)
_LONGEST_WORD, _LONGEST_PERIOD = 24, 8

_ranks: dict[str, dict[str, int]] = {}


def word_ranks(vocabulary: str | None) -> dict[str, int]:
    """Ranks of the words one would try: common passwords, then the whole words of a tokenizer file, whose ids
    are in order of merging.  ``vocabulary`` may be None."""
    if (key := vocabulary or "") not in _ranks:
        ranks = {w: i + 1 for i, w in enumerate(COMMON)}
        if vocabulary:
            with open(vocabulary, encoding="utf-8") as file:
                model = json.load(file)["model"]
            suffix = model.get("end_of_word_suffix") or ""
            for token, number in model["vocab"].items():
                word = token[: len(token) - len(suffix)] if suffix else token
                if token.endswith(suffix) and len(word) >= 3 and word.isascii() and word.isalpha():
                    ranks.setdefault(word, number + 1)
        _ranks[key] = ranks
    return _ranks[key]


def _alphabet(value: str) -> int:
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 10 * any("0" <= c <= "9" for c in value) + 33 * any(not c.isalnum() and c.isascii() for c in value)
    size += 1000 * (not value.isascii())
    return 16 if size <= 36 and not re.search(r"[^0-9a-f]", value) else max(size, 10)


#: Neighbours on a row of a keyboard, in either direction.
_BESIDE = {x for row in KEYBOARD for a, b in zip(row, row[1:], strict=False) for x in (a + b, b + a)}
#: Characters that a piece looks back at, except those of walks and repeats, which keep their own starts.
_RING = 32


class _Starts:
    """Starts of a piece whose price is that of its start and log2 of its length; :meth:`least` gives the cheapest.

    Of two starts the earlier one gains on the later as the piece grows, so a start that has been overtaken, or
    will be before it leads, goes.  What stays is a stack whose top is the cheapest, and each start enters and
    leaves it once.
    """

    def __init__(self):
        self.stack: list[tuple[int, float]] = []

    @staticmethod
    def _overtakes(early: tuple[int, float], late: tuple[int, float]) -> float:
        """The end from which on the earlier start, which is the cheaper one, gives the cheaper piece."""
        ratio = 2.0 ** min(late[1] - early[1], 60.0)
        return math.inf if ratio == 1.0 else (ratio * late[0] - early[0]) / (ratio - 1)

    def add(self, start: int, price: float):
        stack = self.stack
        while stack and price <= stack[-1][1]:
            stack.pop()
        new = (start, price)
        while len(stack) > 1 and self._overtakes(stack[-2], stack[-1]) <= self._overtakes(stack[-1], new):
            stack.pop()
        stack.append(new)

    def least(self, end: int) -> float:
        stack = self.stack
        costs = [price + math.log2(end - start) for start, price in stack[-2:]]
        while len(costs) > 1 and costs[0] <= costs[1]:
            stack.pop()
            costs = [price + math.log2(end - start) for start, price in stack[-2:]]
        return costs[-1] if costs else math.inf


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits of the cheapest segmentation.  Every piece costs one bit more for its kind and place.

    Words cost their rank, a bit for capitals and one for look-alike digits; dates the days of two
    centuries; a repeat what its unit costs, as characters or as the pieces before it, and the number of
    repeats; a walk its start, length and turns; anything else its characters one by one.  Walks and repeats may
    start anywhere and have any length.  An empty value costs nothing.  The memory does not grow with the value.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain = low.translate(_LEET)
    per_char = math.log2(_alphabet(value)) if value else 0.0
    best = [math.inf] * _RING  # the cheapest price of what ends here, by place
    best[0] = 0.0
    brute = math.inf  # the same where a brute-force piece ends
    dates: dict[int, list[int]] = {}  # starts by end
    periods = range(1, _LONGEST_PERIOD + 1)
    same = [0] * (_LONGEST_PERIOD + 1)  # characters so far that equal the one so many before
    repeats = [[_Starts() for _ in range(p)] for p in range(_LONGEST_PERIOD + 1)]
    walks, walk, turns, last = _Starts(), 0, 0, 0.0
    for j in range(1, n + 1):
        k = j - 1  # the character that comes in
        if low[k].isdigit():
            for end in {m.end() for form in _DATES if (m := form.match(low, k))}:
                dates.setdefault(end, []).append(k)
        brute = min(best[k % _RING] + 1, brute) + per_char
        least = brute
        for i in range(max(0, j - _LONGEST_WORD), j - 2):
            rank, extra = ranks.get(low[i:j]), 0.0
            if rank is None and plain != low:
                rank, extra = ranks.get(plain[i:j]), 1.0
            if rank is not None:
                extra += value[i:j] != low[i:j]
                least = min(least, best[i % _RING] + 1 + math.log2(rank + 1) + extra)
        for i in dates.pop(j, ()):
            least = min(least, best[i % _RING] + 1 + math.log2(365 * 200))
        for p in periods:
            if k >= p and value[k] == value[k - p]:
                same[p] += 1
                shortest = max(2 * p, 3)
                if same[p] >= shortest - p:
                    i = j - shortest
                    starts = repeats[p][j % p]
                    starts.add(i, min(best[i % _RING] + p * per_char, best[(i + p) % _RING]))
                    least = min(least, starts.least(j) + 1 - math.log2(p))
            elif same[p]:
                same[p] = 0
                for starts in repeats[p]:
                    starts.stack.clear()
        if k and low[k - 1 : j] in _BESIDE:
            walk += 1
            before, turns = turns, turns + (walk >= 2 and low[k] == low[k - 2])
            if walk >= 2:
                # turns of a walk count from its third character on
                walks.add(j - 3, best[(j - 3) % _RING] - 2 * before)
                least = min(least, walks.least(j) + 1 + math.log2(47 * 2) + 2 * turns)
        elif walk:
            walk = turns = 0
            walks.stack.clear()
        best[j % _RING] = last = least
    return last


def scan(text: str, ranks: dict[str, int], least_bits: float = LEAST_BITS) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, bits) in order of start, kind and end; code points, end exclusive.

    The patterns match leftmost and without overlap per kind, and an assignment with fewer than
    ``LEAST_ASSIGN`` characters is dropped after it has taken its place.  Bits are those of the value of
    an assignment or guess, else zero.
    """
    found = []
    values: dict[tuple[int, int], float] = {}

    def bits(a: int, b: int) -> float:
        if (a, b) not in values:
            values[a, b] = guess_bits(text[a:b], ranks)
        return values[a, b]

    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_ASSIGN:
            found.append((0, m.start(), m.end(), bits(*m.span(2))))
    found += [(1, *m.span(), 0.0) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), 0.0) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        b = a + len(m[1].rstrip(".!?:"))
        if b - a >= LEAST_ASSIGN and bits(a, b) >= least_bits:
            found.append((3, a, b, bits(a, b)))
    found.sort(key=lambda x: (x[1], x[0], x[2]))
    return [(KINDS[k], a, b, cost) for k, a, b, cost in found]


def find_secrets(docs: DataFrame, vocabulary: str | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """Per document (doc_id, text): doc_id and secrets, an array of kind, start, end, bits.

    Null text is empty and has none; whole texts of any length are scanned.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])
    names = ("kind", "start", "end", "bits")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(vocabulary)
        for batch, texts in text_batches(batches):
            spans = [[dict(zip(names, x, strict=True)) for x in scan(t, ranks, least_bits)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["doc_id", "secrets"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(scanned, "doc_id long, secrets array<struct<kind:string,start:long,end:long,bits:double>>")


def redact(docs: DataFrame, vocabulary: str | None = None, mark: str = "[SECRET]", least_bits: float = LEAST_BITS) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one; column n_chars, if there is
    one, follows the new text.  Rows without spans, null texts included, stay as they are."""
    names = docs.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(vocabulary)
        for batch, texts in text_batches(batches):
            new = batch.column(at).to_pylist()
            sizes = batch.column(counted).to_pylist() if counted is not None else []
            for i, text in enumerate(texts):
                if spans := scan(text, ranks, least_bits):
                    parts, done = [], 0
                    for _, a, b, _ in spans:
                        if a >= done:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    new[i] = "".join(parts) + text[done:]
                    if counted is not None:
                        sizes[i] = len(new[i])
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cleaned, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of what find_secrets gives."""

    def of(kinds: tuple[str, ...]):
        return F.filter("secrets", lambda x: x.kind.isin(*kinds))

    def joined(kinds: tuple[str, ...]):
        return F.array_join(F.transform(of(kinds), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    counts = [F.size(of((k,))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))


def digest_of(spans: list[tuple[str, int, int, float]]) -> str:
    """base_sha256 of one text's spans, for those who have them outside Spark."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in KINDS[:3]).encode()).hexdigest()
