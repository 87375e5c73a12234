"""Encoding of texts by a public byte-level BPE vocabulary, inside Arrow batches.

A text is cut into words by the vocabulary's pattern; each short word is merged on a
contiguous rank array: the boundaries of its parts and, beside them, the ranks of
adjacent pairs. The smallest rank is found by a scan, its boundary deleted and the two
neighbouring ranks refreshed, until no pair is in the vocabulary. Words of more than
``SHORT`` bytes use a heap over the same pairs, so a text without any break stays near linear.
Words repeat, so every worker keeps a bounded table from word to ids.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.sources.tables import for_all_cores

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT = 256
CACHED_WORDS = 400_000
CACHED_LENGTH = 48
#: Ids after which a part of a batch is handed on.
SENT_IDS = 1 << 22

#: The vocabulary's pattern (fixed value), with white space and letters written out for ASCII texts and as Unicode classes for others.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
UNICODE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word`` by scans of the contiguous rank array."""
    n = len(word)
    bound = list(range(n + 1))
    pair = [ranks.get(word[i : i + 2], NEVER) for i in range(n - 1)]
    while pair:
        least = min(pair)
        if least == NEVER:
            break
        i = pair.index(least)
        del bound[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[bound[i] : bound[i + 2]], NEVER)
        if i:
            pair[i - 1] = ranks.get(word[bound[i - 1] : bound[i + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap of pairs: n log n for words of any length."""
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = ends[i]
        if not alive[i] or mid >= n or ends[mid] != end or not alive[mid]:
            continue
        ends[i], alive[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """Word to ids, filled as words occur and emptied when it holds ``CACHED_WORDS``."""

    def __init__(self, raw: bytes) -> None:
        import regex

        self.ranks = read_ranks(raw)
        self.ascii_words, self.words = re.compile(ASCII_WORDS).findall, regex.compile(UNICODE_WORDS).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = (rank,) if rank is not None else tuple((merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks))
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; none for a null or empty text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, (self.ascii_words if text.isascii() else self.words)(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, map(self.__getitem__, (self.ascii_words if text.isascii() else self.words)(text))))


_encoders: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def encoded(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``, without special tokens.

    ``ids`` is empty for null and for empty texts and never null; blank texts are encoded as they
    are. Whole texts are encoded, of any length; a null ``doc_id`` stays null, repeated rows stay
    repeated, an empty table gives no rows, other columns are ignored. The vocabulary file (under
    2 MB) is read by the driver and broadcast.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            flat: list[int] = []
            ends, first, n = [0], 0, len(batch)
            for i, text in enumerate(batch.column(1).to_pylist(), 1):
                flat += encode(text)
                ends.append(len(flat))
                if i == n or len(flat) >= SENT_IDS:  # the places of a list array are 32 bits wide
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), ids], ["doc_id", "ids"])
                    flat, ends, first = [], [0], i

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return for_all_cores(rows, "doc_id").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` of every row with ``tokens``, the number of ids of its text (0 if null or empty)."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(shared.value).count
        for batch in batches:
            n = batch.num_columns - 1
            sizes = pa.array([count(t) for t in batch.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], sizes], [*keep, "tokens"])

    rows = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return for_all_cores(rows, keep[0]).mapInArrow(run, f"{fields}, tokens bigint")
