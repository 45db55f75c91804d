"""Rows of a population: variables set, split by condition, born, moved and removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IdCollision, ModelError
from ..types import Variable, as_column

ID = "_id"
#: Keys of one block whose rows are numbered by one task, and blocks whose rows are summed by one task.
BLOCK, BLOCKS = 65_536, 4_096


def set_variables(population: DataFrame, values: dict[str, object]) -> DataFrame:
    """Sets variables one after another: each sees those set before it. Types stay."""
    kinds = {f.name: f.dataType for f in population.schema.fields}
    for name, value in values.items():
        column = as_column(value)
        population = population.withColumn(name, column.cast(kinds[name]) if name in kinds else column)
    return population


def split(population: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Those that meet the condition, and the rest (where it is false or null)."""
    test = F.coalesce(as_column(condition).cast("boolean"), F.lit(False))
    return population.where(test), population.where(~test)


def bury(population: DataFrame, alive, allowed: bool = True) -> DataFrame:
    """Only those still alive."""
    if not allowed:
        raise ModelError("the function does not allow death")
    return split(population, alive)[0]


def move(source: DataFrame, target: DataFrame | None) -> DataFrame:
    """The target state with the source's agents appended."""
    return source if target is None else target.unionByName(source)


def number_rows(rows: DataFrame, key: str, first: Column | int, name: str = ID) -> DataFrame:
    """Gapless numbers from ``first`` in the order of a distinct long ``key``.

    Blocks of the key's range are numbered each on its own and shifted by the
    rows of the blocks before, which are summed in two levels, so no task sorts
    all rows or, where keys lie far apart, all blocks.
    """
    rows = rows.withColumn("_block", F.expr(f"`{key}` div {BLOCK}"))
    offsets = rows_before(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), F.expr(f"_block div {BLOCKS}"))
    inside = Window.partitionBy("_block").orderBy(key)
    start = first if isinstance(first, Column) else F.lit(first)
    return rows.join(offsets, "_block").withColumn(name, (start + F.col("_before") + F.row_number().over(inside) - 1).cast("long")).drop("_block", "_before")


def rows_before(sizes: DataFrame, upper: Column) -> DataFrame:
    """``_block`` and ``_before``, the rows (``_n``) of all lower blocks; ``upper`` rises with the block."""
    below = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_upper", upper)
    tops = sizes.groupBy("_upper").agg(F.sum("_n").alias("_n")).select("_upper", below(Window.orderBy("_upper")).alias("_above"))
    parts = sizes.withColumn("_below", below(Window.partitionBy("_upper").orderBy("_block")))
    return parts.join(tops, "_upper").select("_block", (F.col("_below") + F.col("_above")).alias("_before"))


def next_id(*populations: DataFrame) -> int:
    return 1 + max((p.agg(F.max(ID)).first()[0] or 0 for p in populations), default=0)


def assign_ids(population: DataFrame, order: str, least: int = 1) -> DataFrame:
    """Ids that are 0 or null are filled from the greatest id on (and from ``least``), in the order of a distinct long."""
    unset = F.coalesce(F.col(ID), F.lit(0)) == 0
    fresh = number_rows(population.where(unset).drop(ID), order, max(least, next_id(population)))
    return population.where(~unset).unionByName(fresh.select(*population.columns))


def id_collisions(population: DataFrame) -> DataFrame:
    return population.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_ids(population: DataFrame) -> DataFrame:
    if (bad := id_collisions(population).head(1)):
        raise IdCollision(f"agent id {bad[0][ID]} occurs {bad[0]['n']} times")
    return population


def births(parents: DataFrame, variables: Sequence[Variable], values: dict[str, object], when: object = True, first: int | None = None) -> DataFrame:
    """At most one child of each parent, ids in the parents' order; unset variables take their defaults."""
    born = split(parents, when)[0]
    made = [(as_column(values[v.name]).cast(v.spark_type) if v.name in values else v.literal()).alias(v.name) for v in variables]
    children = born.select(F.col(ID).alias("_parent"), *made)
    return number_rows(children, "_parent", next_id(parents) if first is None else first).select(ID, *[v.name for v in variables])


def host_births(spark, variables: Sequence[Variable], rows: Sequence[dict], first: int) -> DataFrame:
    """Agents given one by one, in order."""
    known = {v.name for v in variables}
    for row in rows:
        if unknown := row.keys() - known:
            raise ModelError(f"unknown variables {sorted(unknown)}")
    data = [(first + i, *[v.check(row.get(v.name, v.initial)) for v in variables]) for i, row in enumerate(rows)]
    from pyspark.sql import types as T

    return spark.createDataFrame(data, T.StructType([T.StructField(ID, T.LongType()), *[v.field() for v in variables]]))


def row_index(population: DataFrame) -> DataFrame:
    """Position from 0 in the order of ids."""
    return number_rows(population, ID, 0, "_index")
