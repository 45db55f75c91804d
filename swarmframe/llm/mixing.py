"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of ``block_rows`` rows. Block i of a source with
weight w is released at slot floor(i / w) and due by slot ceil((i + 1) / w);
earliest deadline first among the released blocks fills one slot after another,
and every source stays within one block of its share at every slot.

Weights are taken exactly, as the rational numbers they are. The schedule is
drawn up block by block on the driver, so the number of blocks is bounded: a
block has ``BLOCK_ROWS`` rows, or as many more as make ``BLOCKS`` blocks of the
whole table (and one more for each source). Blocks that long are not dealt out
one after another: ``GROUP`` slots at a time go round by round, ``BLOCK_ROWS``
rows of each, so that short stretches keep the mixture as well. When a source
runs out, a new phase begins at the next slot, in which the sources left keep
their relative weights. All rows are kept.

Defined results: a null source is a source of its own; a source without a given
weight has weight 0, and such sources come last, in equal parts; weights that
are missing altogether are row counts to the power ``ALPHA``, in whole
thousandths; the last block of a source may be short; repeated rows are each
dealt; columns named as those that are added give way to them; an empty table
gives no rows. Text is not read for the order.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_key, md5_order, rank_within, table

#: Rows of a block, the power of the default weights, the seed of the shuffle.
BLOCK_ROWS, ALPHA, SEED = 16, 0.7, 5
#: Blocks beyond which blocks hold more rows, and slots that are dealt together then.
BLOCKS, GROUP = 1 << 18, 64
#: Slots up to which the schedule is broadcast (some 60 bytes each); beyond (more sources than that), Spark shuffles it.
BROADCAST_ROWS = 1 << 19


def default_weight(rows: int, alpha: float = ALPHA) -> int:
    return max(1, math.floor(1000 * rows**alpha + 0.5))


def exact_schedule(blocks: dict[str, int], weights: dict[str, float]) -> tuple[list[str], array, array]:
    """The sources by name, and of each slot the number of its source and its phase.

    At every slot of a phase, every source is less than one block from its exact part of the phase.
    """
    names = sorted(s for s in blocks if blocks[s])
    left = [blocks[s] for s in names]
    weight = [Fraction(max(0, weights.get(s, 0))) for s in names]
    sources, phases, phase = array("q"), array("q"), 0
    while any(left):
        alive = [k for k in range(len(names)) if left[k]]
        own = {k: weight[k] for k in alive if weight[k]} or dict.fromkeys(alive, Fraction(1))
        scale = math.lcm(*(w.denominator for w in own.values()))
        part = {k: int(w * scale) for k, w in own.items()}
        g = math.gcd(*part.values())
        part = {k: q // g for k, q in part.items()}
        n = sum(part.values())
        waiting = [(0, -(-n // q), k, 0) for k, q in part.items()]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        slot = 0
        while True:
            while waiting and waiting[0][0] <= slot:
                _, due, k, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due, k, i))
            due, k, i = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a block missed its deadline")
            sources.append(k)
            phases.append(phase)
            slot, i = slot + 1, i + 1
            left[k] -= 1
            if not left[k]:
                break
            heapq.heappush(waiting, (i * n // part[k], -(-(i + 1) * n // part[k]), k, i))
        phase += 1
    return names, sources, phases


def exact_slots(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """``_source``, ``_block``, ``_slot`` and ``_phase`` of every block; the driver holds 32 bytes for each."""
    names, sources, phases = exact_schedule(blocks, weights)
    done, of = [0] * len(names), array("q")
    for k in sources:
        of.append(done[k])
        done[k] += 1
    columns = {"_k": sources, "_block": of, "_slot": array("q", range(len(sources))), "_phase": phases}
    slots = spark.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()}))
    named = spark.createDataFrame(list(enumerate(names)), "_k long, _source string")
    return slots.join(F.broadcast(named), "_k").select("_source", "_block", "_slot", F.col("_phase").cast("int").alias("_phase"))


def placed_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, blocks_most: int = BLOCKS, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``_row`` (a row of ``docs``), ``_block``, ``_slot``, ``_phase``, ``_inside`` (place in the block) and ``_round``."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), group_key(docs[source_col]).alias("_source"), md5_order(seed, F.coalesce(docs[id_col].cast("string"), F.lit("null"))).alias("_order"))
    counts = {r["_source"]: r["count"] for r in rows.groupBy("_source").count().collect()}  # a row for each source
    given = {("null" if s is None else f"={s}"): w for s, w in (weights or {}).items()}
    target = {s: given.get(s, 0.0) if weights is not None else default_weight(n, alpha) for s, n in counts.items()}
    size = max(block_rows, -(-sum(counts.values()) // blocks_most))
    blocks = {s: -(-n // size) for s, n in counts.items()}
    slots = exact_slots(spark, blocks, target)
    slots = F.broadcast(slots) if sum(blocks.values()) <= BROADCAST_ROWS else slots
    ranked = rank_within(rows, "_source", "_order", ["_id"], counts)
    placed = ranked.withColumn("_block", F.expr(f"rank div {size}")).withColumn("_inside", F.col("rank") % size)
    return placed.join(slots, ["_source", "_block"]).select("_row", "_block", "_slot", "_phase", F.col("_inside").cast("int").alias("_inside"), F.expr(f"_inside div {block_rows}").alias("_round"))


def mix_slots(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """All columns of ``docs``, then ``_block``, ``_slot``, ``_phase`` and ``_inside`` (place in the block)."""
    made = ("_block", "_slot", "_phase", "_inside")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in made]
    return placed_rows(docs, weights, **options).select(*kept, *made)


def mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all of them, sorted into the mixed order; columns as they were."""
    return placed_rows(docs, weights, **options).orderBy(F.expr(f"_slot div {GROUP}"), "_round", "_slot", "_inside").select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_slots(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("_block").alias("block"), F.col("_phase").alias("phase"), F.col("_slot").alias("slot"), F.col("_inside").alias("place"))


#: The schedule simulated slot by slot, one row for each; in DuckDB's dialect.
OP4_SQL = f"""
WITH RECURSIVE size AS (
  SELECT greatest({BLOCK_ROWS}, (count(*) + {BLOCKS - 1}) // {BLOCKS}) AS rows FROM documents
), shares AS (
  SELECT k, (n + rows - 1) // rows AS blocks, CAST(greatest(1, floor(1000 * pow(n, {ALPHA}) + 0.5)) AS BIGINT) AS q
  FROM (SELECT coalesce('=' || source, 'null') AS k, count(*) AS n FROM documents GROUP BY 1), size
), run(slot, phase, t, k, block, state) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(-1 AS BIGINT),
    (SELECT list({{'k': k, 'q': q, 'blocks': blocks, 'rest': blocks, 'since': CAST(0 AS BIGINT)}} ORDER BY k) FROM shares)
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN phase + 1 ELSE phase END, CASE WHEN ends THEN 0 ELSE t + 1 END, pick.k, pick.blocks - pick.rest,
    list_transform(state, lambda x: {{'k': x.k, 'q': x.q, 'blocks': x.blocks, 'rest': x.rest - CASE WHEN x.k = pick.k THEN 1 ELSE 0 END,
      'since': CASE WHEN ends THEN 0 WHEN x.k = pick.k THEN x.since + 1 ELSE x.since END}})
  FROM (
    SELECT *, pick.rest = 1 AS ends FROM (
      SELECT *, list_sort(list_transform(
        list_filter(state, lambda x: x.rest > 0 AND x.since * n // x.q <= t),
        lambda x: {{'due': ((x.since + 1) * n + x.q - 1) // x.q, 'k': x.k, 'blocks': x.blocks, 'rest': x.rest}}))[1] AS pick
      FROM (SELECT *, CAST(list_sum(list_transform(list_filter(state, lambda x: x.rest > 0), lambda x: x.q)) AS BIGINT) AS n FROM run) WHERE n > 0
    )
  )
), ranked AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k, rows,
    row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT, doc_id) - 1 AS r
  FROM documents, size
)
SELECT doc_id, source, r // rows AS block, CAST(phase - CASE WHEN last THEN 1 ELSE 0 END AS INTEGER) AS phase, slot, CAST(r % rows AS INTEGER) AS place
FROM ranked JOIN (SELECT k, block, slot, phase, t = 0 AND slot >= 0 AS last FROM run) USING (k) WHERE r // rows = block
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLE_SQL = {"op4_mixing": OP4_SQL}
