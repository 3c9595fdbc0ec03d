"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A BPE tokenizer cuts a text into words before it merges anything, so the ids of a text are the ids of
its words in order.  Documents repeat their words, hence the library is asked only for words that this
worker does not know, a few hundred of them joined to one text.  Where the join falls apart again is known
from the number of bytes that each token stands for; a group that does not add up is encoded word by word.
The result equals ``Tokenizer.encode_batch`` on the whole texts.

With a byte-level vocabulary Arrow cuts texts at spaces and finds the distinct words of a batch, and a new word
that is several runs of letters, digits or marks (``word.``, ``end.\\nNext``) is put together from the ids of its runs.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words a worker remembers, and their characters; beyond either it keeps those that came in most batches.
MOST_WORDS, MOST_CHARS = 400_000, 16_000_000
#: The same for the byte-level kind, whose words keep their marks and upper case and so are more.
MOST_SPACED = 800_000
_JOINED = 200
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
_ONLY_PYTHON_SPACE = re.compile("[\x1c-\x1f]")
# White space of Python, as Arrow's own is ASCII.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_SPACE = rf"{_WHITE}{_WHITE}|\A{_WHITE}|{_WHITE}\z"
#: Runs that a byte-level tokenizer cuts apart wherever they meet: letters that every version of Unicode has, ASCII
#: digits, ASCII marks but for the apostrophe (which takes letters with it), and a line break inside a word.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u0527", r"!-&(-/:-@\[-`{-~"
_RUN = re.compile(rf" ?(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)|\n")
_OF_RUNS = rf"\A[{LETTERS}0-9{MARKS}]+(?:\n[{LETTERS}0-9{MARKS}]+)*\z"
_ONE_RUN = rf"\A(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)\z"

_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of a tokenizer file; one per worker process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class WordIds:
    """Ids of texts from a tokenizer file of one of two kinds: byte-level BPE whose words carry the space
    before them, or BPE with word ends that drops white space.  Strings of special tokens in a text are text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = self.tokenizer.normalizer is None
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.vocab_size = max(vocabulary.values()) + 1
        self._bytes = np.zeros(self.vocab_size, np.int64)
        for token, number in vocabulary.items():
            self._bytes[number] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self._index: dict = {}
        self._ids = np.zeros(0, np.uint32)
        self._count = np.zeros(0, np.int64)
        self._uses = np.zeros(0, np.int64)
        self._start_over(np.zeros(0, np.int64))

    def _start_over(self, kept: np.ndarray) -> None:
        """Only the words of these numbers stay known, numbered anew in this order."""
        keys = list(self._index)
        self._index = {keys[i]: n for n, i in enumerate(kept.tolist())}
        self._chars = sum(map(_length, self._index))
        self._ids = _joined(self._ids, self._count, kept)[0]
        self._count, self._uses = self._count[kept], self._uses[kept]

    def _most(self) -> int:
        return MOST_SPACED if self.spaced else MOST_WORDS

    def _forget(self) -> None:
        """Half the bounds stay for words that came more than once, the more frequent ones first."""
        order = np.argsort(-self._uses, kind="stable")[: self._most() // 2]
        order = order[self._uses[order] > 1]
        keys = list(self._index)
        lengths = np.array([_length(keys[i]) for i in order.tolist()], np.int64)
        self._start_over(np.sort(order[np.cumsum(lengths) <= MOST_CHARS // 2]))
        self._uses //= 2

    def _words(self, text: str) -> list:
        """Keys of the words in order: a plain string is a word after one space (or, where white space is
        dropped, any word); a tuple holds a piece that is encoded as it stands."""
        if not self.spaced:
            return [(text,)] if _ONLY_PYTHON_SPACE.search(text) else text.split()
        return [x[1:] if x[0] == " " and len(x) > 1 and not x[1].isspace() else (x,) for x in _BEFORE_WORD.split(text) if x]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split_joined(self, words: list[str], text: str, ids: np.ndarray) -> np.ndarray | None:
        """How many of the ids each word has, or None where that is not certain."""
        if self.spaced:
            parts = [f" {w}" for w in words]
        else:
            parts = self.tokenizer.normalizer.normalize_str(text).split(" ")[1:]
        if len(parts) != len(words):
            return None
        ends = np.cumsum([len(x.encode()) for x in parts])
        token_ends = np.cumsum(self._bytes[ids])
        at = np.searchsorted(token_ends, ends)
        if len(ids) == 0 or token_ends[-1] != ends[-1] or not np.array_equal(token_ends[np.minimum(at, len(ids) - 1)], ends):
            return None
        return np.diff(at + 1, prepend=0)

    def _add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self._index.update(zip(keys, range(len(self._index), len(self._index) + len(keys)), strict=True))
        self._chars += sum(map(_length, keys))
        self._ids = np.concatenate([self._ids, ids])
        self._count = np.concatenate([self._count, counts])
        self._uses = np.concatenate([self._uses, np.zeros(len(keys), np.int64)])

    def _ask(self, keys: list) -> None:
        """Learn different new keys from the library."""
        words, alone = [k for k in keys if isinstance(k, str)], [k for k in keys if not isinstance(k, str)]
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        texts = [" " + " ".join(g) for g in groups]
        order, ids, counts = [], [], []
        for group, text, got in zip(groups, texts, self._plain(texts), strict=True):
            found = np.array(got, np.uint32)
            split = self._split_joined(group, text, found)
            if split is None:
                each = self._plain([f" {w}" if self.spaced else w for w in group])
                split = np.array([len(x) for x in each], np.int64)
                found = np.array(list(chain.from_iterable(each)), np.uint32)
            order += group
            ids.append(found)
            counts.append(split)
        for key, got in zip(alone, self._plain([k[0] for k in alone]) if alone else [], strict=True):
            order.append(key)
            ids.append(np.array(got, np.uint32))
            counts.append(np.array([len(got)], np.int64))
        self._add(order, np.concatenate(ids), np.concatenate(counts))

    def _learn(self, keys: list) -> None:
        """Learn different new keys; in the byte-level kind, words of several runs by their runs."""
        words = pa.array([k for k in keys if isinstance(k, str)] if self.spaced else [], pa.string())
        several = words.filter(pc.and_not(pc.match_substring_regex(words, _OF_RUNS), pc.match_substring_regex(words, _ONE_RUN)))
        if not len(several):
            self._ask(keys)
            return
        composed = several.to_numpy(zero_copy_only=False).tolist()
        known = set(composed)
        if asked := [k for k in keys if k not in known]:
            self._ask(asked)
        runs = _RUN.findall(" " + " ".join(composed))
        heads = np.fromiter((x[0] == " " for x in runs), bool, len(runs))
        numbers = self._numbers([x[1:] if x[0] == " " else (x,) for x in runs])
        ids, ends = _joined(self._ids, self._count, numbers)
        firsts = np.flatnonzero(heads)
        self._add(composed, ids, np.diff(np.append((ends - self._count[numbers])[firsts], len(ids))))

    def _numbers(self, keys: list) -> np.ndarray:
        """Where the keys stand in what is known; new ones are learned."""
        at = np.fromiter(map(self._index.get, keys, repeat(-1)), np.int64, len(keys))
        if unknown := np.flatnonzero(at < 0).tolist():
            self._learn(list({keys[i]: None for i in unknown}))
            at[unknown] = [self._index[keys[i]] for i in unknown]
        self._uses[at] += 1
        return at

    def _by_keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and how many each text has."""
        words = [self._words(t) for t in texts]
        return self._numbers(list(chain.from_iterable(words))), np.array([len(w) for w in words], np.int64)

    def _by_spaces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of the byte-level kind without odd white space."""
        lists = pc.split_pattern(texts, " ")
        words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.zeros(len(words), bool)
        first[np.cumsum(counts) - counts] = True
        numbers = np.empty(len(words), np.int64)
        coded = words.filter(pa.array(~first)).dictionary_encode()
        numbers[~first] = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        numbers[first] = self._numbers([(w,) for w in words.filter(pa.array(first)).to_pylist()])
        return numbers, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (uint32), and where each text ends in them."""
        if len(self._index) > self._most() or self._chars > MOST_CHARS:
            self._forget()
        if not self.spaced:
            numbers, counts = self._by_keys(texts)
        else:
            column = pa.array(texts, pa.large_string())
            odd = pc.match_substring_regex(column, _ODD_SPACE)
            numbers, counts = self._by_spaces(column.filter(pc.invert(odd)))
            if pc.any(odd).as_py():
                odd = odd.to_numpy(zero_copy_only=False)
                more, sizes = self._by_keys([t for t, o in zip(texts, odd.tolist(), strict=True) if o])
                # Back into the order of the texts.
                order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
                counts = np.concatenate([counts, sizes])
                starts = (np.cumsum(counts) - counts)[order]
                counts = counts[order]
                places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                numbers = np.concatenate([numbers, more])[places]
        ids, ends = _joined(self._ids, self._count, numbers)
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]

    def with_end(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Per text its ids and then the end id, as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode(texts)
        marked = np.insert(ids, ends, end_id).astype("<u4", copy=False)
        return np.split(marked, (ends + np.arange(1, len(ends) + 1))[:-1]) if len(texts) else []


def _length(key) -> int:
    return len(key) if isinstance(key, str) else len(key[0])


def _joined(ids: np.ndarray, count: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of these numbers one after the other, and where each word ends in them."""
    ends = 4 * np.concatenate([[0], np.cumsum(count)])
    known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
    offsets, data = known.take(pa.array(numbers)).buffers()[1:]
    ends = np.frombuffer(offsets, np.int64, len(numbers) + 1)[1:] // 4
    return np.frombuffer(data, np.uint32, int(ends[-1]) if len(ends) else 0) if data else np.zeros(0, np.uint32), ends
