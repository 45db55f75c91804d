"""Helpers shared by the operators: shared-folder tables, ranking, Arrow passes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one bucket of a ranking; a bucket is sorted by one task.
RANK_BUCKET_ROWS = 4_096
#: Leading bits of a bucket's number that make one more level where offsets are summed: 4,096 numbers to a task.
LEVEL_BITS = 12
#: Rows of one Arrow batch: texts are long, and Spark's default of 10,000 rows is held several times over.
BATCH_ROWS = 2_000
#: Rows of one slice of an Arrow pass, so that one batch of long texts stays small.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. A folder of our own only where none is named and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="swarmframe-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Written tables in the shared folder, which cut lineage and outlive executors.

    ``save`` writes a frame as Parquet and returns a frame that reads it;
    ``drop`` removes a table that nothing reads any more. As a context manager it
    drops all of them at the end of the block; else what is left goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_others(self, *kept: str) -> None:
        for name in [n for n in self.names if n not in kept]:
            self.drop(name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self, name: str = "") -> None:
        self.names = [n for n in self.names if name and n != name]
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone at exit; the folder is the cluster's to clean
            pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Returns what a pass has freed to the system: workers are used again, and would keep it while the next task runs in the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of ``BATCH_ROWS``, unless the session asks for another number than the default."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(whole, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def append_columns(df: DataFrame, fields: list[T.StructField], text_col: str, make: Callable[[], Callable]) -> DataFrame:
    """All columns of ``df`` and new ones computed from one text column, in one Arrow pass.

    ``make()`` runs once in each task and returns a function from a list of texts
    (None where null) to one list for each field. Columns of ``df`` named as a
    new one give way to it.
    """
    made = {f.name.lower() for f in fields} - {text_col.lower()}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made])
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text_col)
    types = [arrow_schema(T.StructType([f])).field(0).type for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for part in slices(batches):
            new = score(part.column(at).to_pylist())
            arrays = [*part.columns, *(pa.array(v, t) for v, t in zip(new, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *(f.name for f in fields)])

    return map_batches(df, run, schema)


def group_key(column: Column) -> Column:
    """A string that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def running_offsets(sizes: DataFrame, groups: list[str], at: str, bits: int, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Of every ``at`` (a long of ``bits`` bits) of a group: ``_before``, the sum of ``_n`` below it, and ``_all``, that of the group.

    Beyond ``level_bits`` the numbers are summed by their leading bits first, so
    no task sorts all numbers of a group.
    """
    before = lambda *keys: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    below = lambda *keys: F.coalesce(F.sum("_n").over(before(*keys)), F.lit(0))
    if bits <= level_bits:
        return sizes.select(*groups, at, below(*groups).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("_all"))
    parts = sizes.withColumn("_upper", F.shiftright(at, level_bits))
    uppers = parts.groupBy(*groups, "_upper").agg(F.sum("_n").alias("_n")).withColumnRenamed("_upper", at)
    tops = running_offsets(uppers, groups, at, bits - level_bits, level_bits).select(*groups, F.col(at).alias("_upper"), F.col("_before").alias("_above"), "_all")
    return parts.withColumn("_below", below(*groups, "_upper")).join(tops, [*groups, "_upper"]).select(*groups, at, (F.col("_below") + F.col("_above")).alias("_before"), "_all")


def rank_within(rows: DataFrame, group: str, order: str, ties: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """Rank (from 0) and group size of every row, without one task for one group.

    ``order`` is a long from 0 to 2**60 - 1, spread evenly (a hash). Rows of a
    group go to buckets by its leading bits, buckets are ranked each on its own,
    and the rows of the buckets before are added. A group with a third of all
    rows has as many more buckets. Adds ``rank`` and ``group_rows``.
    """
    most = max(counts.values(), default=0) if counts is not None else (rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0)
    bits = min(40, max(0, math.ceil(math.log2(max(1, most) / RANK_BUCKET_ROWS)))) if most else 0
    rows = rows.withColumn("_bucket", F.shiftright(F.col(order), 60 - bits))
    sizes = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(sizes, [group], "_bucket", bits).withColumnRenamed("_all", "group_rows")
    inside = Window.partitionBy(group, "_bucket").orderBy(order, *ties)
    return (
        rows.join(offsets, [group, "_bucket"])
        .withColumn("rank", F.row_number().over(inside).cast("long") - 1 + F.col("_before"))
        .drop("_bucket", "_before")
    )


def md5_order(seed: int, *columns: Column) -> Column:
    """60 even bits from an MD5 digest, the same in any engine that has md5()."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *columns)), 1, 15), 16, 10).cast("long")
