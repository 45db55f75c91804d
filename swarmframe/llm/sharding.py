"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are ranked in a seeded shuffle; a row's fractional rank is
(rank + 1/2) / rows of its source. All rows sorted by it are cut into runs of
equal length, so each shard holds the mixture of the whole. No task sorts a
whole source: rows go to buckets by hash, and fractions by even ranges.

Law: ``rows``, counts of shards differ by one at most. Equal texts are not kept
together: each row goes where its rank puts it.

Defined results: a null text has size 1 and checksum 0; a null source is a
source of its own; repeated rows are each dealt (their order among themselves
makes no difference); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_key, md5_order, rank_within, running_offsets, table

SHARDS, SEED = 16, 11
#: Rows of one range of fractional ranks; a range is sorted by one task.
RANGE_ROWS = 20_000


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), group_key(docs[source_col]).alias("_source"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        md5_order(seed, F.coalesce(docs[id_col].cast("string"), F.lit("null"))).alias("_order"),
    )
    counts = {r["_source"]: r["count"] for r in docs.groupBy(group_key(docs[source_col]).alias("_source")).count().collect()}  # a row for each source
    total = sum(counts.values())
    ranked = rank_within(rows, "_source", "_order", ["doc_id", "size", "text_crc32"], counts)
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("group_rows"))
    ranges = max(1, math.ceil(total / RANGE_ROWS))  # fractions are even, so ranges hold nearly equal numbers of rows
    spread = ranked.withColumn("_fraction", fraction).withColumn("_range", F.floor(F.col("_fraction") * ranges).cast("long"))
    sizes = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(sizes, [], "_range", (ranges - 1).bit_length())
    inside = Window.partitionBy("_range").orderBy("_fraction", "_source", "rank")
    at = spread.join(offsets, "_range").withColumn("_at", F.row_number().over(inside).cast("long") - 1 + F.col("_before"))
    shard = F.expr(f"_at * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # the first place whose shard this is
    return at.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_at") - first).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
    return byte


OP5_SQL = f"""
WITH bytes AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), sums AS (
  SELECT doc_id, source, CAST(n + 1 AS BIGINT) AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
      lambda c, b: xor(c >> 8, {[crc_entry(b) for b in range(256)]}[CAST(xor(c, b) & 255 AS INTEGER) + 1])
    ), 4294967295) AS text_crc32,
    ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS o
  FROM bytes
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS m, count(*) OVER () AS total FROM sums
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * m)::DOUBLE, coalesce('=' || source, 'null'), r) - 1 AS place FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY place * {SHARDS} // total ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

QUERIES = {"op5_sharding": op5_sharding}
ORACLE_SQL = {"op5_sharding": OP5_SQL}
