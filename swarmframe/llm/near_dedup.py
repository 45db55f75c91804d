"""Near-duplicates by an LSH forest over MinHash signatures.

A text is its set of distinct word shingles. Copies (equal sets) fall into one
class first. A class has a signature of ``VALUES`` minimum hashes; tree t of the
forest sorts the classes by the signature turned by ``BASE_DEPTH`` x t values.
Classes of one tree that share ``BASE_DEPTH`` leading values are a region. In a
region, the next classes in sorted order, which share the longest prefixes, are
candidates. Every candidate is confirmed on the full sets.

Rounds take more trees and wider neighbourhoods, each only between classes not
yet in one component, so a group of thousands of near copies is joined by chains
rather than by all its pairs. What neighbourhoods of a dense region do not reach
is settled last: components whose members' signatures there look alike are
tested in full, every member of one against every member of the other, in
blocks. Components are found by alternating star steps on tables; nothing of all
documents reaches the driver.

A region of more than ``REGION_ROWS`` classes is parted for the rounds, up to
twice as deep and then by hash, which may part a pair. So all classes that are in
such a region of any tree are joined exactly in the end: two sets at the
threshold share one of their rarest shingles (prefix filter), wherever the
rounds have not already brought them together.

A pair at similarity 0.8 shares no region in any of 32 trees of base depth 4
with a probability of (1 - 0.8**4)**32, below 1e-7.

Defined results: a text without words (or null) has an empty set, is linked with
nothing and is its own component; one with fewer words than a shingle has its
whole sequence as its one shingle; repeated rows are copies; rows that share an
id but not a set are each in the component of their own set, and where that id
is the least of several sets, links of any of them count; rows with a null id
are never linked; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_schema, map_batches, Scratch, slices, table

TREES, BASE_DEPTH, VALUES = 32, 4, 128
#: (trees, neighbours) of each round.
ROUNDS = ((2, 1), (8, 2), (TREES, 6))
#: Classes of a region that one task sorts; beyond, the region is split for the rounds and its classes are joined exactly.
REGION_ROWS = 20_000
#: Members of a component in one block of the last tests.
BLOCK_ROWS = 512
#: Signatures look alike if so many of their values agree: five deviations below 0.8.
LOOKS_ALIKE = VALUES * 8 // 10 - round(5 * (VALUES * 0.16) ** 0.5)
#: A pair is linked if ALIKE[1] * intersection >= ALIKE[0] * union.
ALIKE = (80, 100)
WORDS_KEPT = 300_000
#: Bits of the map that marks texts whose sets are needed: 2**24 of them are 2 MB.
BITMAP_BITS = 24
#: Bits of the table of counts that orders shingles by rarity: 2**20 counts are 8 MB. Any order gives the same links.
RARITY_BITS = 20

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Words(dict):
    """Stable 64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingler:
    def __init__(self, width: int):
        self.width = width
        self.words = Words()
        rng = np.random.Generator(np.random.PCG64(20))
        self.odd = rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.turn = rng.integers(0, 1 << 63, VALUES, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted set of the text's shingles, as 64-bit hashes."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        keys = np.full(n, width, np.uint64)
        for j in range(width):
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[j : j + n]
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(keys ^ (keys >> np.uint64(31)))

    def signature(self, keys: np.ndarray) -> list[int]:
        """16 bits of each minimum hash, ``BASE_DEPTH`` values to a long."""
        least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(keys), 4096):
            part = keys[start : start + 4096]
            least = np.minimum(least, (self.odd[:, None] * part[None, :] + self.turn[:, None]).min(1))
        least = (least ^ (least >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return np.frombuffer((least >> np.uint64(48)).astype(">u2").tobytes(), ">i8").tolist()


def marks(width: int):
    """Makes the function that gives size, two halves of a fingerprint and signature of each text."""

    def make():
        own = Shingler(width)

        def run(texts: list[str | None]) -> list[list]:
            sizes, ones, twos, signs = [], [], [], []
            for text in texts:
                keys = own.shingles(text)
                sizes.append(len(keys))
                mixed = (keys ^ (keys >> np.uint64(30))) * np.uint64(0x9E3779B97F4A7C15)
                ones.append(int(keys.sum(dtype=np.uint64).astype(np.int64)))
                twos.append(int((mixed ^ (mixed >> np.uint64(27))).sum(dtype=np.uint64).astype(np.int64)))
                signs.append(own.signature(keys) if len(keys) else None)
            return [sizes, ones, twos, signs]

        return run

    return make


MARKS = [T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("sign", T.ArrayType(T.LongType()))]
SETS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """cls and the full set of each of these documents (id, text)."""
    out = arrow_schema(SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width)
        for part in slices(batches):
            keys = [own.shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=out)

    return map_batches(docs, run, SETS)


def star_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node in an edge (a, b), root the least of its component.

    Alternates large and small star steps until the edges no longer change; a
    step sends each neighbour to the least one, so distances shrink by halves.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    held = scratch.save(tidy(edges), f"{name}-0")
    before = None
    step = 0
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        step += 1
        now = scratch.save(tidy(small), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1_000_003)).first()
        held = now
        if state == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def forest_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: region (its leading values) and rest (the values after)."""
    keyed = classes.select("cls", "n", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sign")
    return keyed.select("cls", "n", "tree", F.element_at("sign", F.col("tree") + 1).alias("region"), F.element_at("sign", (F.col("tree") + 1) % TREES + 1).alias("rest"))


def split_regions(rows: DataFrame, most: int, region_rows: int) -> DataFrame:
    """Goes deeper where a region holds too many, then deals the classes out by hash; adds ``hot`` for all rows of such regions.

    This only serves the rounds. A pair that it parts is found by ``rarest_pairs`` among the hot classes.
    """
    rows = rows.withColumn("hot", F.col("in_region") > region_rows)
    for deeper in (F.shiftright("rest", 32), F.col("rest")):
        if most <= region_rows:
            return rows
        large = F.col("in_region") > region_rows
        rows = rows.withColumn("region", F.when(large, F.xxhash64("region", deeper)).otherwise(F.col("region"))).drop("in_region")
        sizes = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("in_region"))
        most = sizes.agg(F.max("in_region")).first()[0] or 0
        rows = rows.join(sizes, ["tree", "region"])
    share = F.ceil(F.col("in_region") / region_rows)
    salted = F.xxhash64("region", F.pmod(F.xxhash64("cls", "tree"), share))
    return rows.withColumn("region", F.when(F.col("in_region") > region_rows, salted).otherwise(F.col("region")))


def mark_likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (with an ``_id``) and ``_likely``: whether the id may be a wanted one (``wanted`` has a column ``_id``).

    A bitmap of fixed size (``BITMAP_BITS``), broadcast, tells most ids that are
    not wanted without moving their rows. A full bitmap only marks more of them.
    """
    bit = F.shiftrightunsigned(F.xxhash64("_id", F.lit(9)), 64 - BITMAP_BITS)
    held = wanted.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word"))
    bitmap = held.agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 AS INT))")).alias("_bits"))  # at most 2**(BITMAP_BITS - 6) rows
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(bitmap), "_word", "left")
    likely = F.coalesce(F.expr("shiftright(_bits, cast(_bit & 63 AS INT)) & 1L = 1"), F.lit(False))
    return marked.withColumn("_likely", likely).drop("_bit", "_word", "_bits")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The different texts (_id, text) of each wanted id; one, unless rows share an id."""
    likely = mark_likely(texts.select(F.col("id").alias("_id"), "text"), wanted).where("_likely").select("_id", "text")
    return likely.join(wanted, "_id", "left_semi").dropDuplicates(["_id", "text"])


def with_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (with ``cls``) and ``label``; a class that was never linked is its own label."""
    if labels is None:
        return rows.withColumn("label", F.col("cls"))
    return rows.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def relabel(labels: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels after edges (a, b) between them: (cls, label) of every class that was ever linked."""
    roots = star_components(edges, scratch, f"{name}-roots")
    if labels is None:
        return scratch.save(roots.select(F.col("node").alias("cls"), F.col("root").alias("label")), name)
    moved = labels.join(roots, labels["label"] == roots["node"], "left").select("cls", F.coalesce("root", "label").alias("label"))
    fresh = roots.join(labels.select(F.col("cls").alias("node")), "node", "left_anti").select(F.col("node").alias("cls"), F.col("root").alias("label"))
    return scratch.save(moved.unionByName(fresh), name)


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def alike_components(rows: DataFrame, classes: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """(a, b): labels of which some members share a dense region and have signatures that look alike.

    Smaller regions need no second look: there, every class met every other. So
    two classes are only looked at in the first tree in which they share a
    region: if that region is small they are settled, and if it was split (its
    rows are not here) both are hot and joined exactly.
    """
    reach = ROUNDS[-1][1]
    dense = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where((F.col("m") > reach + 1) & (F.col("x") != F.col("y")))
    met = rows.join(dense.select("tree", "region"), ["tree", "region"], "left_semi")
    met = met.join(classes.select("cls", "sign"), "cls").select("tree", "region", "label", "n", "sign")
    out = arrow_schema(PAIRS)

    def compare(table_: pa.Table) -> pa.Table:
        labels, sizes = table_["label"].to_numpy(), table_["n"].to_numpy()
        signs = table_["sign"].combine_chunks()
        signs = signs if isinstance(signs, pa.Array) else pa.concat_arrays(signs.chunks)
        values = signs.flatten().to_numpy().astype(">i8").view(">u2").astype(np.uint16).reshape(len(labels), VALUES)
        heads, tree = signs.flatten().to_numpy().reshape(len(labels), TREES), table_["tree"][0].as_py()
        names, at, counts = np.unique(labels, return_inverse=True, return_counts=True)
        minor = np.flatnonzero(at != counts.argmax())  # pairs within the largest component are settled
        found: set[tuple[int, int]] = set()
        for row in minor.tolist():
            fit = (alike[1] * np.minimum(sizes, sizes[row]) >= alike[0] * np.maximum(sizes, sizes[row])) & (at != at[row])
            some = np.flatnonzero(fit)
            near = some[(values[some] == values[row]).sum(1) >= LOOKS_ALIKE]
            near = near[(heads[near] == heads[row]).argmax(1) == tree]
            found |= {(min(int(names[at[row]]), x), max(int(names[at[row]]), x)) for x in np.unique(labels[near]).tolist()}
        pairs = sorted(found)
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=out)

    return met.groupBy("tree", "region").applyInArrow(compare, PAIRS).distinct()


def test_components(pairs: DataFrame, members: DataFrame, alike: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Those pairs of labels (a, b) of which any members (cls, keys, label) are linked.

    Members of the smaller component ask blocks of the larger one; both are dealt
    in blocks, so no task holds a whole component.
    """
    ends = pairs.select(F.col("a").alias("label")).unionByName(pairs.select(F.col("b").alias("label"))).distinct()
    members = members.join(ends, "label", "left_semi")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    sized = pairs.join(sizes.select(F.col("label").alias("a"), F.col("m").alias("ma")), "a").join(sizes.select(F.col("label").alias("b"), F.col("m").alias("mb")), "b")
    swap = F.col("ma") > F.col("mb")
    asked = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("big"), F.greatest("ma", "mb").alias("m"), F.least("ma", "mb").alias("asks"))
    asked = scratch.save(asked, "asked")
    load = asked.groupBy("big").agg(F.first("m").alias("m"), F.sum("asks").alias("asks"))
    load = load.select("big", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("asks") / BLOCK_ROWS).cast("int").alias("chunks"))
    load = scratch.save(load, "load")
    deal = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.select("small", "big").join(load, "big").join(members.select(F.col("label").alias("small"), "cls", "keys"), "small")
    left = left.select("big", "small", "keys", deal("chunks").alias("chunk"), each("blocks").alias("block"))
    right = load.join(members.select(F.col("label").alias("big"), "cls", "keys"), "big").select(F.col("big").alias("of"), F.col("keys").alias("held"), deal("blocks").alias("in_block"), each("chunks").alias("in_chunk"))
    out = arrow_schema(PAIRS)

    def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [x.values.to_numpy() for x in column]

    def ask(queries: pa.Table, held: pa.Table) -> pa.Table:
        pairs: set[tuple[int, int]] = set()
        if queries.num_rows and held.num_rows:
            sets = arrays(held["held"])
            lengths = np.array(list(map(len, sets)))
            keys, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            for small, big, query in zip(queries["small"].to_pylist(), queries["big"].to_pylist(), arrays(queries["keys"]), strict=True):
                if (small, big) in pairs:
                    continue
                low, high = np.searchsorted(keys, query, "left"), np.searchsorted(keys, query, "right")
                spans = high - low
                hits = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                common = np.bincount(owners[hits], minlength=len(sets))
                if (alike[1] * common >= alike[0] * (len(query) + lengths - common)).any():
                    pairs.add((small, big))
        found = sorted(pairs)
        return pa.table([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], schema=out)

    return left.groupBy("big", "block", "chunk").cogroup(right.groupBy("of", "in_block", "in_chunk")).applyInArrow(ask, PAIRS).distinct()


PREFIXES = T.StructType([T.StructField(c, T.LongType()) for c in ("cls", "n", "label", "key", "at")])
COUNTS = T.StructType([T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])


def rarest_pairs(members: DataFrame, alike: tuple[int, int], scratch: Scratch, block_rows: int = REGION_ROWS) -> DataFrame:
    """(a, b, la, lb): all pairs of members (cls, keys, label) of different labels that may be linked; none that is linked is left out.

    In one order of all shingles, two sets that overlap enough have their first
    common shingle among the first n - ceil(s n) + 1 of the larger one and the
    first n - ceil(2 s n / (1 + s)) + 1 of the smaller one, for the similarity
    s. Rare shingles come first, so what thousands of texts share is met only
    where they are near it. Within one label nothing is paired: of the label
    that has the most members at a shingle, only pairs with others are made.
    """
    spark, (over, under) = members.sparkSession, alike
    counted, out = arrow_schema(COUNTS), arrow_schema(PREFIXES)
    slot = lambda keys: (keys.view(np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << RARITY_BITS, np.int64)
        for part in batches:
            held += np.bincount(slot(part.column(0).flatten().to_numpy()), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], schema=counted)

    counts = map_batches(members.select("keys"), count, COUNTS).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2**RARITY_BITS rows
    table_ = np.zeros(1 << RARITY_BITS, np.int64)
    table_[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    handle = spark.sparkContext.broadcast(table_)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = handle.value
        for part in slices(batches):
            rows: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in PREFIXES]
            for cls, label, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                keys = keys.values.to_numpy()
                n = len(keys)
                most = n + over * n // -under + 1
                keys = keys[np.lexsort((keys, often[slot(keys)]))[:most]]
                for column, v in zip(rows, (np.full(most, cls), np.full(most, n), np.full(most, label), keys, np.arange(most)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], schema=out)

    prefixes = scratch.save(map_batches(members.select("cls", "label", "keys"), first, PREFIXES), "prefixes")
    of_label = prefixes.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    keys = of_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("m").alias("m"), F.max_by("label", F.struct("m", "label")).alias("main"))
    keys = scratch.save(keys.where("labels > 1").select("key", "main", F.ceil(F.col("m") / block_rows).cast("int").alias("parts")), "keys")
    met = scratch.save(prefixes.join(keys, "key").withColumn("minor", F.col("label") != F.col("main")), "met")
    # the smaller set, to its shorter prefix, is dealt to the parts of its shingle, the larger one goes to all of them
    small = met.where(F.expr(f"{over + under} * at <= {under - over} * n")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    large = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = lambda rows, end: rows.select("key", "part", *[F.col(c).alias(f"{c}_{end}") for c in ("cls", "n", "label", "at")])
    fits = F.expr(
        f"label_x <> label_y AND (n_x < n_y OR n_x = n_y AND cls_x < cls_y) AND {under} * n_x >= {over} * n_y"
        f" AND {over + under} * least(n_x - at_x, n_y - at_y) >= {over} * (n_x + n_y)"
    )
    pairs = [x(a, "x").join(x(b, "y"), ["key", "part"]).where(fits) for a, b in ((small.where("minor"), large), (small.where("NOT minor"), large.where("minor")))]
    return pairs[0].unionByName(pairs[1]).select(
        F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b"),
        F.least("label_x", "label_y").alias("la"), F.greatest("label_x", "label_y").alias("lb"),
    ).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b, la, lb) and ``linked``, from the full sets."""
    one, two = sets.select(F.col("cls").alias("a"), F.col("keys").alias("ka")), sets.select(F.col("cls").alias("b"), F.col("keys").alias("kb"))
    common = F.size(F.array_intersect("ka", "kb")).cast("long")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", common).withColumn("united", F.size("ka") + F.size("kb") - F.col("common"))
    return both.select("a", "b", "la", "lb", F.expr(f"{alike[1]} * common >= {alike[0]} * united").alias("linked"))


def near_components(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", alike: tuple[int, int] = ALIKE, region_rows: int = REGION_ROWS) -> tuple[DataFrame, Scratch]:
    """doc_id, n_shingles and component_id of every row, and the tables it reads."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    signed = scratch.save(append_columns(texts, MARKS, "text", marks(width)).drop("text"), "signs")
    classes = scratch.save(signed.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("cls"), F.first("sign").alias("sign")), "classes")

    rows = forest_rows(classes)
    sizes = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("in_region")).where("in_region > 1")
    rows = scratch.save(rows.join(sizes, ["tree", "region"]), "rows")
    most = rows.agg(F.max("in_region")).first()[0] or 0
    if most > region_rows:
        rows = scratch.save(split_regions(rows, most, region_rows), "split")
    involved = scratch.save(rows.select(F.col("cls").alias("_id")).distinct(), "involved")
    sets = scratch.save(shingle_sets(texts_of(texts, involved), width), "sets")

    labels, held = None, ""  # (cls, label) of the classes that were linked, and the table that holds them
    checked = None
    for k, (trees, near) in enumerate(ROUNDS):
        part = with_labels(rows.where(F.col("tree") < trees).select("tree", "region", "rest", "cls", "n"), labels)
        after = Window.partitionBy("tree", "region").orderBy("rest", "cls").rowsBetween(1, near)
        met = part.withColumn("next", F.collect_list(F.struct("cls", "label", "n")).over(after)).select("cls", "label", "n", F.explode("next").alias("x"))
        fits = (F.col("label") != F.col("x.label")) & (alike[1] * F.least("n", "x.n") >= alike[0] * F.greatest("n", "x.n"))
        pairs = met.where(fits).select(
            F.least("cls", "x.cls").alias("a"), F.greatest("cls", "x.cls").alias("b"),
            F.least("label", "x.label").alias("la"), F.greatest("label", "x.label").alias("lb"),
        ).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        tested = scratch.save(confirm(pairs, sets, alike), f"pairs-{k}")
        checked = tested.select("a", "b") if checked is None else checked.unionByName(tested.select("a", "b"))
        edges = tested.where("linked").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        if not edges.head(1):
            continue
        labels, held = relabel(labels, edges, scratch, f"labels-{k}"), f"labels-{k}"
    if most > region_rows:
        hot = rows.where("hot").select("cls").distinct()
        pairs = rarest_pairs(with_labels(sets.join(hot, "cls", "left_semi"), labels), alike, scratch)
        tested = scratch.save(confirm(pairs.join(checked, ["a", "b"], "left_anti"), sets, alike), "pairs-hot")
        edges = tested.where("linked").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        if edges.head(1):
            labels, held = relabel(labels, edges, scratch, "labels-hot"), "labels-hot"
        rows = rows.where("NOT hot")
    marked = with_labels(rows.select("tree", "region", "cls", "n"), labels)
    alike_labels = scratch.save(alike_components(marked, classes, alike), "alike")
    if alike_labels.head(1):
        edges = scratch.save(test_components(alike_labels, with_labels(sets, labels), alike, scratch), "last")
        if edges.head(1):
            labels, held = relabel(labels, edges, scratch, "labels"), "labels"
    scratch.drop_others("signs", "classes", held)
    own = classes.select("n", "f1", "f2", "cls")
    out = signed.select("id", "n", "f1", "f2").join(own, ["n", "f1", "f2"], "left")
    if labels is not None:
        out = out.join(labels, "cls", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("long"))
    linked_id = F.when(F.col("id").isNotNull(), F.coalesce("label", "cls"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(linked_id, "id").alias("component_id")), scratch


def keep_first(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one of least id; of its repeated rows, one. Rows with a null id stay."""
    found, scratch = near_components(docs, width, id_col, text_col)
    found = scratch.save(found, "found")
    scratch.drop_others("found")
    gone = scratch.save(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    marked = mark_likely(rows, gone)
    kept = marked.where("NOT _likely").unionByName(marked.where("_likely").join(gone, "_id", "left_anti"))
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1):
        kept = kept.where("_id IS NOT NULL").dropDuplicates(["_id"]).unionByName(kept.where("_id IS NULL"))
    return kept.select("_row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = near_components(table(spark, sf_dir, "documents"), 2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op3_near_dedup": op3_near_dedup}
