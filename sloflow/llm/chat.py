"""Chat formatting with offset-aligned loss masks.

A conversation becomes one string, ``<s>`` and then per turn ``[INST]role[/INST]text</s>``.  Control
strings inside roles and texts are escaped with a backslash behind their first character, backslashes are
doubled, so the string can be read back without loss.  The whole string is encoded once with offsets, the
control strings being tokens of their own, and the loss mask comes from the spans of the assistant's texts:
both the spans and the tokens are sorted, so binary search finds the tokens of each span.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The control strings of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile("|".join(re.escape(x) for x in (BEGIN, OPEN, CLOSE, END)))
_TO_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPED = re.compile(r"\\(\\?)")
LEARNED_ROLE = "assistant"
#: Characters that are rendered before they are encoded; a longer conversation is encoded in stretches
#: that end with a turn, which changes no token as turns end with a control token.
STRETCH = 2_000_000

_loaded: dict = {}


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def encoder(path: str):
    """The tokenizer of ``path`` with the control strings as added tokens and untrimmed offsets."""
    if path not in _loaded:
        from tokenizers import AddedToken, Tokenizer, processors

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_tokens([AddedToken(x, normalized=False, special=False) for x in (BEGIN, OPEN, CLOSE, END)])
        tokenizer.encode_special_tokens = True
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        _loaded[path] = tokenizer
    return _loaded[path]


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the sorted, disjoint ``spans`` (rows of start and end).

    Token starts and ends are sorted as well: a span meets the tokens from the first that ends behind its
    start to the last that starts before its end.
    """
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, spans[:, 1] > spans[:, 0])
    np.add.at(change, np.maximum(first, last), -(spans[:, 1] > spans[:, 0]).astype(np.int64))
    return np.cumsum(change[:-1]) > 0


def render(turns: list[tuple[str, str]], begin: bool = True) -> tuple[str, np.ndarray]:
    """The string of (role, text) turns, and the spans of the texts to learn from."""
    parts, spans, at = [BEGIN] if begin else [], [], len(BEGIN) if begin else 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        at += len(head)
        if role == LEARNED_ROLE:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def format_turns(turns: list[tuple[str, str]], path: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, token ids, token starts, token ends, loss mask) of a conversation."""
    stretches: list[list[tuple[str, str]]] = [[]]
    size = 0
    for turn in turns:
        if size > STRETCH:
            stretches.append([])
            size = 0
        stretches[-1].append(turn)
        size += len(turn[0]) + len(turn[1])
    strings, ids, offsets, masks, at = [], [], [], [], 0
    for k, stretch in enumerate(stretches):
        string, spans = render(stretch, begin=k == 0)
        encoded = encoder(path).encode(string, add_special_tokens=False)
        place = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        masks.append(mask_of(place[:, 0], place[:, 1], spans))
        ids.append(np.array(encoded.ids, np.int64))
        offsets.append(place + at)
        strings.append(string)
        at += len(string)
    place = np.concatenate(offsets)
    return "".join(strings), np.concatenate(ids), place[:, 0], place[:, 1], np.concatenate(masks)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted string: role, text, and the span of the escaped text."""
    turns, at = [], len(BEGIN)
    role = ""
    for m in _CONTROL.finditer(formatted, at):
        part = formatted[at : m.start()]
        if m[0] == CLOSE:
            role = unescape(part)
        elif m[0] == END:
            turns.append((role, unescape(part), at, m.start()))
        at = m.end()
    return turns


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the loss mask, unescaped.  Tokens that share a character count it once."""
    parts, done, piece = [], -1, []
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if a > done and piece:
            parts.append(unescape("".join(piece)))
            piece = []
        piece.append(formatted[max(a, done) : b])
        done = max(done, b)
    return "".join([*parts, unescape("".join(piece))])


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation of ``rows`` (conv_id long, turn, role, text): conv_id, formatted, input_ids, starts,
    ends (code points of the tokens in formatted) and loss_mask.

    Turns are in order of turn, then role and text; repeated rows are turns of their own.  Null role or
    text is empty; rows with null conv_id form one conversation, null turns come first.  Conversations are
    dealt by conv_id and read as sorted rows, so only one conversation at a time is in memory.
    """
    keys = ["conv_id", "turn", "role", "text"]
    fields = [
        ("conv_id", pa.int64()), ("formatted", pa.large_string()), ("input_ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())), ("loss_mask", pa.list_(pa.bool_())),
    ]
    schema = pa.schema([(n, pa.string() if t == pa.large_string() else t) for n, t in fields])
    sorted_rows = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        .withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
        .repartition("conv_id")
        .sortWithinPartitions(*keys)
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        turns, current, found, size = [], None, [], 0
        for batch in slices(batches):
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for name, role, text in zip(ids, roles, texts, strict=True):
                if turns and name != current:
                    found.append((current, *format_turns(turns, tokenizer)))
                    size += len(found[-1][1])
                    turns = []
                    if size > STRETCH:
                        yield out(found)
                        found, size = [], 0
                current = name
                turns.append((role, text))
        if turns:
            found.append((current, *format_turns(turns, tokenizer)))
        if found:
            yield out(found)

    return sorted_rows.mapInArrow(formatted, "conv_id long, formatted string, input_ids array<int>, starts array<long>, ends array<long>, loss_mask array<boolean>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of format_conversations: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "formatted"):
            rows = []
            for i in range(batch.num_rows):
                name, string = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                starts, ends, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                turns = parse(string)
                said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
                loss = masked_text(string, starts, ends, mask)
                rows.append((name, len(turns), _sha(said), len(loss), _sha(loss), len(string)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(read_back, ddl)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
