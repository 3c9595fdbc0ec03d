"""Language identification by compression.

Per language a raw-content dictionary is cut from sample texts.  A text is compressed with each of them in
chunks, so that a long text cannot become its own dictionary, and the language whose dictionary gives the
fewest bytes wins.  Where the second is within ``margin`` of it, the answer is marked as rejected.

A larger dictionary would win by its size alone, so dictionaries are compared at one size, but no language
shrinks the others: those with enough text are compared with whole dictionaries first.  Then the languages
with less text stand, tier by tier, against the winner's dictionary cut to their size.  With much less text
such a language must beat every one of several cuts by ``margin``; where it does not, it changes nothing, the
mark and the score included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import first_by_hash, text_batches

UNKNOWN = "und"
#: Sample: per language at most so many documents and so many characters of each; and so large a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 240, 1_000, 96_000
CHUNK_BYTES = 4_000
LEVEL = 3
#: Samples of one size but for this share are compared on equal terms.
NEAR = 0.75
#: So many parts of a large dictionary stand against a small one.
PARTS = 32
#: The runner-up must need so much more, as a share of the best size.
MARGIN = 0.01
_LETTER = re.compile(r"[^\W\d_]")


def sample(docs: DataFrame) -> DataFrame:
    """Bounded sample (lang, text) of ``docs`` (doc_id, text, lang): per language the ``SAMPLE_DOCS`` documents with
    text that come first in the order of a hash of the id; nulls in either column are left out."""
    heads = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("head"))
    return first_by_hash(heads, "lang", "doc_id", SAMPLE_DOCS).select("lang", "head", "place")


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Languages in order of name, each with its dictionary; empty where ``docs`` has no labelled text."""
    kept: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample(docs).collect():
        kept.setdefault(row["lang"], []).append((row["place"], row["head"].encode()))
    return [(lang, b"\n".join(x for _, x in sorted(kept[lang]))[:DICTIONARY_BYTES]) for lang in sorted(kept)]


def tiers(sizes: dict[str, int]) -> list[tuple[int, list[str]]]:
    """Languages that are compared with dictionaries of one size, and that size, from the largest on.

    Those with ``DICTIONARY_BYTES`` come first, uncut.  Below that, a tier goes down to ``NEAR`` of its largest.
    """
    found: list[tuple[int, list[str]]] = []
    left = sorted(sizes, key=lambda x: (-sizes[x], x))
    while left:
        most = sizes[left[0]]
        own = [x for x in left if sizes[x] >= (most if most >= DICTIONARY_BYTES else NEAR * most)]
        found.append((sizes[own[-1]], sorted(own)))
        left = left[len(own) :]
    return found


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.content = dict(model)
        self.tiers = tiers({lang: len(content) for lang, content in model})
        self.compressors: dict[tuple[str, int, int], zstandard.ZstdCompressor] = {}

    def _compressor(self, lang: str, size: int, start: int) -> zstandard.ZstdCompressor:
        if (key := (lang, size, start)) not in self.compressors:
            known = zstandard.ZstdCompressionDict(self.content[lang][start : start + size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors[key] = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
        return self.compressors[key]

    def bytes_of(self, chunks: list[bytes], lang: str, size: int, start: int = 0) -> int:
        """Bytes of the compressed ``chunks`` with ``size`` bytes of the dictionary from ``start`` on."""
        compressor = self._compressor(lang, size, start)
        return sum(len(compressor.compress(c)) for c in chunks)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected).  Null and texts without a letter are ``und`` with score 0; equal
        sizes go to the first language by name.  The score is 0.5 at equal sizes and rises to 1."""
        if not text or not self.tiers or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = text.encode()
        chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
        best, margin = "", np.inf
        for size, own in self.tiers:
            ranked = sorted((self.bytes_of(chunks, lang, size), lang) for lang in own)
            least, lang = ranked[0]
            among = (ranked[1][0] - least) / max(1, least) if len(ranked) > 1 else np.inf
            if not best:
                best, margin = lang, among
                continue
            # The best so far is cut to the size of these; a much larger one in several ways, all of which must lose.
            room = len(self.content[best]) - size
            near = size >= NEAR * (room + size)
            parts = 1 if near else min(PARTS, (room + size) // size)
            needed, lead = 0 if near else MARGIN, np.inf
            for k in range(parts):
                lead = min(lead, (self.bytes_of(chunks, best, size, room * k // max(1, parts - 1)) - least) / max(1, least))
                if lead <= needed:
                    break
            if lead > needed:
                best, margin = lang, min(lead, among)
            elif near:
                margin = min(margin, -lead)
        return best, float(1 / (1 + np.exp(-margin / MARGIN))), bool(margin < MARGIN)


def classify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """Per document (doc_id, text): doc_id, lang_pred, score, rejected.  Only the text decides."""
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch, texts in text_batches(batches):
            columns = zip(*(classifier.classify(t) for t in texts), strict=True)
            arrays = [batch.column(0), *(pa.array(c, f[1]) for c, f in zip(columns, fields[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(classified, "doc_id long, lang_pred string, score double, rejected boolean")
