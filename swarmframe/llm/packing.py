"""Packing by cutting-stock column generation.

Texts are tokenized whole and cut at the sequence length; what is left over of
each is an item. Items are counted in a histogram of lengths, rounded up to units
of ``UNIT`` tokens, or finer ones where pieces are short. A linear program over patterns (how many items of
each length fill a sequence) is solved on the histogram alone: a knapsack
dynamic program prices new patterns on the duals until none is worth more than
a sequence. Whole parts of the solution are used as they are, what is left is
packed first-fit decreasing, and patterns are then assigned to the pieces of
each length by their rank. The driver's work depends on the number of lengths,
never on the number of documents.

Ranks go by a hash, or by the order of the rows in the files that are read
(``in_order``): then all patterns are dealt over ``SPANS`` spans, each takes the
next pieces of every length, and sequences are numbered span after span.

Defined results: a null or empty text has only its end token; repeated rows are
each packed; rows with a null id are packed too; only id and text are read; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import warnings
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_batches, rank_within, Scratch, slices, table
from .token_counts import byte_symbols

#: Unsigned 32-bit numbers; the ids are asked for in little-endian order.
FOUR_BYTES = "I"
assert array(FOUR_BYTES).itemsize == 4 and sys.byteorder == "little"

LENGTH, UNIT, END_ID = 2048, 8, 1  # the length is a whole number of units
#: The coarsest step to which lengths are rounded up: fewer lengths make a smaller program.
STEP = 16
#: Spans of sequences in which the order of the rows is followed.
SPANS = 64
#: The linear program stops within this share of its optimum.
GAP = 1e-3
#: Pivots for each size after which the program gives up.
PIVOTS = 60
#: Entries of a worker's table of tokenized words before it is emptied.
WORD_ENTRIES = 400_000
#: Letters whose lower case is one letter and needs no composing, then marks that form one piece.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,./:;=?@|~)-]*)")
#: White space to Python that the tokenizer does not take for it.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces:
    """Tokenizes text without white space; keeps the pieces it has merged."""

    def __init__(self, path: str, entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.entries = entries
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.model = self.library.model
        self.symbols = {b: ch for b, ch in byte_symbols().items() if ord(ch) != b}

    def core(self, letters: str) -> bytes:
        """Ids of one piece of lower-case letters: merged by the library's model, without its text steps."""
        piece = letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.symbols)
        return array(FOUR_BYTES, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def learn(self, word: str) -> bytes:
        """Ids of text without white space.

        Most is letters and closing marks: two pieces, of which the first is
        looked up in lower case, so that it is merged once however it is
        written and closed. All else goes to the library as it is.
        """
        if word.isascii() and word.isalpha():
            letters, tail = word.lower(), ""
        elif m := SIMPLE.fullmatch(word):
            letters, tail = m[1].lower(), m[2]
        else:
            return self.whole(word)
        cores, tails = self.cores, self.tails
        ids = cores.get(letters)
        if ids is None:
            if len(cores) >= self.entries:
                cores.clear()
            ids = cores[letters] = self.core(letters)
        if not tail:
            return ids
        if tail not in tails:
            if len(tails) >= self.entries:
                tails.clear()
            tails[tail] = self.whole(tail)
        return ids + tails[tail]

    def whole(self, text: str) -> bytes:
        return array(FOUR_BYTES, self.library.encode(text, add_special_tokens=False).ids).tobytes()


class Table(dict):
    """Ids by the text between white space."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        ids = self.pieces.learn(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Tokens:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    This tokenizer's pieces never reach over white space, so the text between
    it is tokenized once and kept; all other texts go to the library whole.
    Nothing here refers back to its owner: a task's tables go when it ends.
    """

    def __init__(self, path: str, entries: int = WORD_ENTRIES):
        self.pieces = Pieces(path, entries)
        self.words = Table(self.pieces)
        self.entries = entries

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return self.pieces.whole(text)
        if len(self.words) >= self.entries:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


ORDERED = T.StructType([*PIECES, T.StructField("_order", T.LongType())])


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document (id, text, and _order if there is one): full sequences, then what is left."""
    schema = ORDERED if "_order" in docs.columns else PIECES
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary or default_vocabulary())
        end = np.asarray([end_id], "<u4").tobytes()
        for part in slices(batches):
            rows: list[list] = [[] for _ in schema]
            for doc, text, *order in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ids = tokens.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    for column, v in zip(rows, (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, *order), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=out)

    return map_batches(docs, run, schema)


def with_order(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, read from Parquet files, and ``_order``: the place of the row over all files, spread over 60 bits.

    A sorted frame is written to numbered files; a reader takes them in any order, but knows file and row.
    """
    read = docs.metadataColumn("_metadata")
    rows = docs.select("*", read["file_path"].alias("_file"), read["row_index"].alias("_at"))
    counts = {r["_file"]: r["count"] for r in rows.groupBy("_file").count().collect()}  # a row for each file
    number = lambda path: int(m[1]) if (m := re.search(r"/part-(\d+)[^/]*$", path)) else -1
    starts, total = [], 0
    for path in sorted(counts, key=lambda path: (number(path), path)):
        starts.append((path, total))
        total += counts[path]
    files = docs.sparkSession.createDataFrame(starts, "_file string, _before long")
    return rows.join(F.broadcast(files), "_file").withColumn("_order", (F.col("_before") + F.col("_at")) * F.lit((1 << 60) // max(1, total))).drop("_file", "_at", "_before")


def unit_for(histogram: dict[int, int], most: int = UNIT) -> int:
    """Tokens in which a table's pieces are counted: a 40th of their mean length or less, from 1 to ``most``."""
    mean = sum(n * k for n, k in histogram.items()) / max(1, sum(histogram.values()))
    return max(1, min(most, 1 << max(0, int(mean / 40).bit_length() - 1)))


def step_for(length: int, unit: int) -> int:
    """The step to which a length is rounded up: the unit, or for longer pieces a 32nd of themselves, up to ``STEP`` tokens."""
    return max(unit, min(STEP, 1 << max(0, (length - 1).bit_length() - 6)))


def by_units(lengths: dict[int, int], unit: int) -> dict[int, int]:
    """Pieces by their length in units, rounded up."""
    histogram: dict[int, int] = {}
    for n, k in lengths.items():
        step = step_for(n, unit)
        size = -(-n // step) * step // unit
        histogram[size] = histogram.get(size, 0) + k
    return histogram


def in_spans(histogram: dict[int, int], room: int, spans: int = SPANS) -> bool:
    """Whether a length has as many pieces, on average, as each span needs for a sequence of them; else their order would be lost in one pattern."""
    pieces = sum(histogram.values())
    items = room * pieces / max(1, sum(n * k for n, k in histogram.items()))
    return pieces >= spans * items * len(histogram)


def units_of(length: Column, unit: int, most: int) -> Column:
    """The length of a piece in units, rounded up."""
    step = F.lit(step_for(most, unit))
    for bits in range((most - 1).bit_length() - 1, 5, -1):
        step = F.when(length <= 1 << bits, step_for(1 << bits, unit)).otherwise(step)
    return (F.ceil(length / step) * step / unit).cast("long")


def best_pattern(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the most worth of items (any number of each) within ``room``."""
    own = np.full(room + 1, -np.inf)
    own[sizes] = worth
    own, number = own[1:], {int(s): k for k, s in enumerate(sizes)}
    took = [0] * (room + 1)
    back = np.zeros(room + 1)  # back[room - c] is the most worth within c
    best = 0.0
    for c in range(1, room + 1):
        value = own[:c] + back[room - c + 1 :]
        k = int(value.argmax())
        if value[k] > best + 1e-12:
            best, took[c] = float(value[k]), k + 1
        back[room - c] = best
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c]:
            pattern[number[took[c]]] += 1
        c -= took[c] or 1
    return best, pattern


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; elementwise, as threaded libraries thrash beside a JVM on so small a matrix."""
    m = len(basis)
    work = np.concatenate((basis, np.eye(m)), 1)
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k][None, :]
    return work[:, m:]


def solve_patterns(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used: the basis of the linear program's optimum.

    Revised simplex with column generation: least sequences for exactly
    ``counts``. Any duals give a lower bound (and so does the room that all items
    take); the program ends within ``GAP`` of the best one, or after ``PIVOTS``
    pivots for each size, which a warning tells: its basis is then a packing as
    well, only not the best.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis)) if m else basis
    use, worth, pivots = (inverse * counts).sum(1), inverse.sum(0), 0
    bound = float(sizes @ counts) / room
    while m and use.sum() > bound * (1 + GAP):
        if pivots >= PIVOTS * m:
            warnings.warn(f"the packing program stopped {use.sum() / bound - 1:.4f} above its bound", stacklevel=2)
            break
        most, pattern = best_pattern(worth, sizes, room)
        bound = max(bound, float(worth @ counts) / max(1.0, most))
        direction = (inverse * pattern).sum(1)
        rising = direction > 1e-9
        if most <= 1 + 1e-7 or not rising.any():
            break
        ratio = np.where(rising, use / np.where(rising, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        pivots += 1
        if pivots % 256 == 0:
            inverse = inverse_of(basis)
            use, worth = np.maximum((inverse * counts).sum(1), 0), inverse.sum(0)
            continue
        row, times = inverse[out] / direction[out], float(ratio[out])
        inverse -= direction[:, None] * row[None, :]
        inverse[out] = row
        worth = worth - (most - 1) * row
        use = np.maximum(use - times * direction, 0)
        use[out] = times
    return basis, use


def draw_plan(histogram: dict[int, int], room: int, spans: int = 1) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (units, first rank, items, sequences, first sequence, first place in a sequence).

    Items of the row's length with ranks from ``first rank`` go one to each of
    its sequences in turn; the next round goes to the next place. Every pattern
    is dealt evenly over the ``spans``.
    """
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, use = solve_patterns(sizes, counts.astype(float), room)
    whole = np.floor(use + 1e-6).astype(np.int64)
    left = counts - (patterns.astype(np.int64) * whole).sum(1)
    for p in range(len(sizes)):  # rounding may never use more than there is
        while (left < 0).any() and whole[p] > 0 and (patterns[:, p][left < 0] > 0).any():
            whole[p] -= 1
            left = left + patterns[:, p].astype(np.int64)
    columns = [(patterns[:, p].astype(np.int64), int(whole[p])) for p in range(len(sizes)) if whole[p]]
    open_rooms: list[list] = []  # what is left: first-fit decreasing
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fit = next((r for r in open_rooms if r[0] >= sizes[k]), None)
            if fit is None:
                open_rooms.append(fit := [room, np.zeros(len(sizes), np.int64)])
            fit[0] -= int(sizes[k])
            fit[1][k] += 1
    columns += [(r[1], 1) for r in open_rooms]
    if spans > 1:
        upto = lambda s, k: (s * columns[k][1] * len(columns) + k * spans) // (spans * len(columns))
        columns = [(columns[k][0], n) for s in range(spans) for k in range(len(columns)) if (n := upto(s + 1, k) - upto(s, k))]
    rank = np.zeros(len(sizes), np.int64)
    plan, sequence = [], 0
    for pattern, times in columns:
        place = 0
        for k in np.flatnonzero(pattern).tolist()[::-1]:
            items = int(pattern[k]) * times
            plan.append((int(sizes[k]), int(rank[k]), items, times, sequence, place))
            rank[k] += items
            place += int(pattern[k])
        sequence += times
    return sorted(plan)


def pack_sequences(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """Every piece with its sequence and offset; ``in_order``: sequences follow the order of the rows in their files."""
    scratch = Scratch(docs.sparkSession, "packing")
    slim = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    slim = with_order(docs).select(*slim, "_order") if in_order else docs.select(*slim)
    pieces = scratch.save(cut_pieces(slim, vocabulary, length), "pieces")
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length
    unit = unit_for(lengths, unit)
    histogram = by_units(lengths, unit)
    while in_order and unit < UNIT and not in_spans(histogram, length // unit):
        unit *= 2
        histogram = by_units(lengths, unit)
    rows = np.array(draw_plan(histogram, length // unit, SPANS if in_order else 1), np.int64).reshape(-1, 6)
    pieces = pieces.withColumn("units", units_of(F.col("length"), unit, length))
    order = F.col("_order") if in_order else F.shiftrightunsigned(F.xxhash64("doc_id", "start"), 4)
    ranked = rank_within(pieces.withColumn("_order", order), "units", "_order", ["doc_id", "start", "ids_crc32"], histogram).drop("_order", "group_rows")
    schema = T.StructType([f for f in ranked.schema.fields if f.name not in ("rank", "units")] + [T.StructField("sequence_id", T.LongType()), T.StructField("_place", T.LongType())])
    names = ranked.columns
    out = arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = rows[:, 0] << 44 | rows[:, 1]
        for part in batches:
            units, rank = (part.column(names.index(c)).to_numpy() for c in ("units", "rank"))
            at = rows[np.searchsorted(starts, units << 44 | rank, "right") - 1] if len(rows) else np.zeros((0, 6), np.int64)
            local = rank - at[:, 1]
            made = [at[:, 4] + local % np.maximum(1, at[:, 3]), at[:, 5] + local // np.maximum(1, at[:, 3])]
            yield pa.RecordBatch.from_arrays([*(part.column(names.index(f.name)) for f in schema.fields[:-2]), *map(pa.array, made)], schema=out)

    placed = map_batches(ranked, assign, schema)
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_place")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
