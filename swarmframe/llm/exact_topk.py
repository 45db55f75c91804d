"""Exact top-k inner products by Fagin's threshold algorithm.

A block of candidates holds one list of its rows for each dimension, sorted by
value; it is built once and walked by all queries that meet the block. A query
walks all lists at once from the end its sign prefers, scores every row it has
not met before in full, and bounds the rest by the sum over dimensions of query
value times the value reached. It stops when that bound cannot beat the kth
score, or when it has met every row. Steps are fine: each doubles the depth.

The kth score is carried into every block: the kth best over ``SEEDS`` rows
(a documented bound, taken by hash) is a floor that the kth of all can only
exceed, so no block needs rows below it. It changes the work, never the result.

Queries are stated rows against all rows, in blocks: blocks of queries meet
blocks of candidates, each pair one task, and the best of each are merged.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with a null id; vectors shorter than others count as
0 where they end; rows that share the query's id are its own, and query rows
that share an id share its places; repeated candidates each have a place; ties
go to the smaller id; an empty table gives no rows. Scores must fit a long: an
error says so where components are too large for that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, table

TOP, SCALE, EVERY = 20, 64, 20
#: Rows of a block of candidates and of a block of queries, at most. As large as a task holds with ease: the rows moved fall with them.
CANDIDATE_ROWS, QUERY_ROWS = 65_536, 65_536
#: Blocks hold fewer rows down to this many, so that small tables have as many pairs of blocks as there are cores.
LEAST_ROWS = 4_096
#: Rows that give the floor of the kth score.
SEEDS = 4_096


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, ended with zeros."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Lists:
    """One block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")  # then a lower row number is a smaller id
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.ends = np.sort(self.rows, axis=0).T

    def top(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers and scores of the k best with ``floor`` or more, own rows left out, and how many rows were scored."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        up = used[query[used] > 0]
        down = used[query[used] < 0]
        met = self.ids == own
        rest, scored = n - int(met.sum()), 0
        best, scores = np.empty(0, np.int64), np.empty(0, query.dtype)
        low, depth = 0, min(k, n)
        while rest:
            if len(used):
                mark = np.zeros(n, bool)
                mark[self.lists[up, n - depth : n - low].ravel()] = True
                mark[self.lists[down, low:depth].ravel()] = True
                mark &= ~met
                met |= mark
                fresh = np.flatnonzero(mark)
            else:  # every score is 0
                fresh = np.flatnonzero(~met)
            rest -= len(fresh)
            scored += len(fresh)
            found = self.rows[fresh] @ query
            good = found >= floor
            if len(fresh) > 4 * k:  # what is below the kth best of these cannot be among the best
                good &= found >= np.partition(found, len(found) - k)[len(found) - k]
            best, scores = np.concatenate((best, fresh[good])), np.concatenate((scores, found[good]))
            keep = np.lexsort((best, -scores))[:k]
            best, scores = best[keep], scores[keep]
            bound = query[up] @ self.ends[up, n - depth] + query[down] @ self.ends[down, depth - 1]
            if bound < floor or (len(best) == k and bound < scores[-1]):
                break
            low, depth = depth, min(2 * depth, n)
        return best, scores, scored


SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


FIGURES = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "block", "rows", "scored")])


def exact_number(rows: np.ndarray, queries: np.ndarray):
    """The narrowest type in which every score is exact."""
    reach = float(np.abs(rows).max(initial=0.0)) * float(np.abs(queries).max(initial=0.0)) * max(1, rows.shape[1])
    if reach >= 2.0**63:
        raise OverflowError("components are so large that scores may not fit a long")
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64


def block_numbers(rows: int, most: int, cores: int) -> int:
    """How many blocks ``rows`` make: of ``most`` rows, or of fewer so that every core has one, but not below ``LEAST_ROWS``."""
    return max(1, math.ceil(rows / most), min(cores, math.ceil(rows / LEAST_ROWS)))


def top_inner_products(queries: DataFrame, rows: DataFrame, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, seeds: int = SEEDS, figures: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query.

    With ``figures``: for each query and block of candidates, its rows and how many of them were scored.
    """
    spark = rows.sparkSession
    pick = lambda df: df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")))
    asked, held = pick(queries), pick(rows)
    asked_n = asked.count()
    held_n, width = held.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    ask, hold = max(1, math.ceil(asked_n / query_rows)), block_numbers(held_n, candidate_rows, cores)
    share = min(1.0, 1.1 * seeds / max(1, held_n))
    seed = held.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(8)), 1) / F.lit(2.0**63) <= share).limit(seeds).toArrow()  # seeds x width doubles
    handle = spark.sparkContext.broadcast((seed["id"].to_numpy(), np.floor(matrix(seed["v"], width) * scale) if len(seed) and width else None))
    schema = FIGURES if figures else SCHEMA
    out = arrow_schema(schema)

    def floors(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The kth best score of each query over the seeds, its own rows left out; below all scores where there are fewer."""
        own, values = handle.value
        least = np.full(len(ids), -np.inf)
        if values is None or len(own) <= k:
            return least
        values = values.astype(exact_number(values, asked))
        for start in range(0, len(ids), 256):
            part = slice(start, start + 256)
            found = (asked[part].astype(values.dtype) @ values.T).astype(np.float64)
            if values.dtype == np.int64:
                found = np.nextafter(found, -np.inf)  # a double may be above the whole number
            found[ids[part][:, None] == own[None, :]] = -np.inf
            least[part] = np.partition(found, len(own) - k, 1)[:, len(own) - k]
        return least

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_pylist([], out)
        if not left.num_rows or not right.num_rows or not width:
            return empty
        q, c = (np.floor(matrix(t["v"], width) * scale) for t in (left, right))
        kind = exact_number(c, q)
        asked_ids, number = left["id"].to_numpy(), right["b"][0].as_py()
        least = floors(asked_ids, q)
        block = Lists(right["id"].to_numpy(), c.astype(kind))
        names, ids, scores, walked = [], [], [], []
        for own, query, floor in zip(asked_ids, q.astype(kind), least, strict=True):
            best, found, scored = block.top(own, query, k, floor)
            names.append(np.full(len(best), own, np.int64))
            ids.append(block.ids[best])
            scores.append(found.astype(np.int64))
            walked.append(scored)
        if figures:
            n = len(asked_ids)
            return pa.table([asked_ids, np.full(n, number, np.int64), np.full(n, len(block.ids), np.int64), np.array(walked, np.int64)], schema=out)
        return pa.table([np.concatenate(names), np.concatenate(ids), np.concatenate(scores)], schema=out)

    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select("id", "v", block(ask).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(hold - 1))).alias("b"))
    right = held.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(ask - 1))).alias("a"), block(hold).alias("b"))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, schema)
    if figures:
        return found
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_inner_products(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


#: The same as a stated query set against all rows.
OP8_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= {TOP}
"""

QUERIES = {"op8_exact_topk": op8_exact_topk}
ORACLE_SQL = {"op8_exact_topk": OP8_SQL}
