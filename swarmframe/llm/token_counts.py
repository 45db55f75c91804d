"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are symbols of a linked list; a heap holds its adjacent
pairs by merge rank. The lowest rank (leftmost on ties) is popped, checked
against the list, and merged, until none is left. The count is the number of
symbols at first minus the merges made; no identifiers are emitted.

Pre-tokens recur, so each worker keeps a bounded table of counts by the text
between two spaces; it is emptied when full and never changes a result.

Defined results: a null or empty text has no tokens; special strings inside a
text count one token each, as in the library's default; repeated rows are each
counted; only the id and text columns are read. Texts are never cut short.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_schema, map_batches, slices, table

#: Entries of a worker's table before it is emptied.
TABLE_ENTRIES = 600_000
LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def check_vocabulary(spec: dict, path: str) -> None:
    """Refuses a file whose steps around the merges are not those built here, rather than count wrong."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = split.get("type") == "ByteLevel" and split.get("add_prefix_space") is False and split.get("use_regex", True) is True
    marks = not any(x.get(flag) for x in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    steps = not any(spec.get(x) for x in ("normalizer", "truncation", "padding"))
    if not (plain and byte_level and marks and steps) or len(model["vocab"]) >= 1 << 17:
        raise ValueError(f"{path}: only byte-level BPE with the plain split, no normalizer and plain added tokens is counted here")


class Merger:
    """Merges pre-tokens under one byte-level vocabulary file; keeps the counts it has found."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec, path)
        vocabulary = spec["model"]["vocab"]
        self.symbols = [vocabulary[s] for _, s in sorted(byte_symbols().items())]
        #: (left id << 17 | right id) to (rank << 17 | merged id): both fit, as ids are below 2**17.
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault(vocabulary[left] << 17 | vocabulary[right], rank << 17 | vocabulary[left + right])
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple(special)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.entries = entries
        self.parts: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token."""
        known = self.parts.get(piece)
        if known is not None:
            return known
        symbols = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbols[i] << 17 | symbols[i + 1])
            if found is not None:
                heap.append((found >> 17, i, found & 0x1FFFF, symbols[i], symbols[i + 1]))
        merges = 0
        if heap:
            heapq.heapify(heap)
            after = list(range(1, n + 1))
            before = list(range(-1, n - 1))
            while heap:
                _, i, merged, left, right = heapq.heappop(heap)
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue  # one of the two was merged meanwhile
                merges += 1
                symbols[i] = merged
                symbols[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    found = pairs.get(merged << 17 | symbols[k])
                    if found is not None:
                        heapq.heappush(heap, (found >> 17, i, found & 0x1FFFF, merged, symbols[k]))
                h = before[i]
                if h >= 0:
                    found = pairs.get(symbols[h] << 17 | merged)
                    if found is not None:
                        heapq.heappush(heap, (found >> 17, h, found & 0x1FFFF, symbols[h], merged))
        if len(piece) <= 64:
            if len(self.parts) >= self.entries:
                self.parts.clear()
            self.parts[piece] = n - merges
        return n - merges

    def count(self, text: str) -> int:
        return sum(map(self.merge, self.pieces.findall(text)))


class Table(dict):
    """Tokens of a text that follows a space, up to the next one; the space belongs to it."""

    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, word: str) -> int:
        n = self.merger.count(f" {word}")
        if len(word) <= 64:
            self[word] = n
        return n


class PairCounter:
    """Counts the tokens of whole texts. Nothing it holds refers back to it: a task's tables go when it ends."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        self.merger = Merger(path, entries)
        self.words = Table(self.merger)
        self.entries = entries
        self.loose = regex.compile(r" \s")

    def plain(self, text: str) -> int:
        """Tokens of text without special strings."""
        if not text:
            return 0
        if self.loose.search(text):  # a space before other white space: pre-tokens may then reach over it
            return self.merger.count(text)
        first, *rest = text.split(" ")
        return self.merger.count(first) + sum(map(self.words.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.words) >= self.entries:
            self.words.clear()
        if any(m in text for m in self.merger.marks):
            parts = self.merger.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text; ``vocabulary`` is a file that each executor has."""
    out = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PairCounter(vocabulary or default_vocabulary())
        for part in slices(batches, 1024):
            texts = part.column(1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], schema=out)

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_counts": op7_token_counts}
