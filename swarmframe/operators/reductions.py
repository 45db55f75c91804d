"""Reductions of a population to a few values, and its order.

All values asked for at once are one job: ``reduce_many`` fuses them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ModelError
from ..types import as_column
from .population import rows_before

#: Agents of a part of the order that one task sorts, and how often parts are cut again at most.
PART_ROWS, LEVELS = 65_536, 7


@dataclass(frozen=True)
class Reduce:
    """One value: count, count_value, sum, min, max, mean, standard_deviation, custom or transform."""

    how: str
    variable: str = ""
    value: object = None  # of count_value; SQL of the transform, over the variable
    aggregate: str = ""  # of custom and transform: SQL with {} for the value, as "bit_or({})"
    initial: object = None

    @property
    def name(self) -> str:
        return "_".join(x for x in (self.how, self.variable) if x)

    def column(self, schema: T.StructType) -> Column:
        if self.how != "count" and isinstance(schema[self.variable].dataType, T.ArrayType):
            raise ModelError(f"{self.variable} is an array; reductions take scalars")
        v = F.col(self.variable) if self.variable else None
        if self.how == "count":
            return F.count(F.lit(1))
        if self.how == "count_value":
            return F.count_if(v == F.lit(self.value))
        if self.how == "sum":
            return F.sum(v)
        if self.how in ("min", "max"):
            return getattr(F, self.how)(v)
        if self.how == "mean":  # 0 for an empty population
            return F.coalesce(F.avg(v), F.lit(0.0))
        if self.how == "standard_deviation":
            return F.coalesce(F.stddev_pop(v), F.lit(0.0))
        if self.how in ("custom", "transform"):
            inner = self.variable if self.how == "custom" else f"({self.value})"
            found = F.expr(self.aggregate.format(inner))
            return found if self.initial is None else F.coalesce(found, as_column(self.initial))
        raise ModelError(f"unknown reduction {self.how}")


def reduce_frame(population: DataFrame, *asked: Reduce, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each group) with a column for each reduction."""
    return population.groupBy(*by).agg(*[r.column(population.schema).alias(r.name) for r in asked])


def reduce_many(population: DataFrame, *asked: Reduce) -> dict[str, object]:
    return reduce_frame(population, *asked).first().asDict()


def fold_ordered(population: DataFrame, variable: str, initial, step: str, by: str = "_id") -> DataFrame:
    """A custom associative operator that no aggregate expresses: ``step`` is SQL over acc and x.

    Partitions fold on their own, then their results fold, so only one value of
    each partition meets in one place. The operator must be associative, and
    ``initial`` its neutral value.
    """
    kind = population.schema[variable].dataType.simpleString()
    fold = f"aggregate(transform(array_sort(collect_list(struct(k, x))), r -> r.x), cast({initial!r} AS {kind}), (acc, x) -> cast({step} AS {kind}))"
    parts = population.select(F.col(by).alias("k"), F.col(variable).alias("x"))
    parts = parts.withColumn("part", F.expr("k div 4096")).groupBy("part").agg(F.expr(fold).alias("x")).withColumnRenamed("part", "k")
    parts = parts.withColumn("part", F.expr("k div 4096")).groupBy("part").agg(F.expr(fold).alias("x")).withColumnRenamed("part", "k")
    return parts.agg(F.expr(fold).alias("value"))


def histogram_even(population: DataFrame, variable: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of ``bins`` equal parts of [low, high); values outside count nowhere."""
    if low >= high:
        raise ModelError("the lower bound must be below the upper bound")
    at = F.floor((F.col(variable) - F.lit(low)) * F.lit(bins) / F.lit(high - low)).cast("int")
    counted = population.where((F.col(variable) >= low) & (F.col(variable) < high)).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = population.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bits_of(variable: str, begin: int, end: int) -> Column:
    """Bits begin to end (exclusive) of an integer, as a sort key."""
    return F.shiftright(F.col(variable).cast("long"), begin).bitwiseAND(F.lit((1 << (end - begin)) - 1))


def sort_population(population: DataFrame, *keys: tuple[str, str], bits: tuple[int, int] | None = None) -> DataFrame:
    """Sorted by (variable, "asc" or "desc") pairs, ties by id. ``bits`` sorts by part of the first key."""
    order = [F.asc(bits_of(k, *bits)) if bits and i == 0 and way == "asc" else F.desc(bits_of(k, *bits)) if bits and i == 0 else getattr(F, way)(k) for i, (k, way) in enumerate(keys)]
    return population.orderBy(*order, "_id")


def place_in_order(population: DataFrame, *keys: tuple[str, str], parts: int = 256, part_rows: int = PART_ROWS) -> DataFrame:
    """``_place`` (from 1) of each agent in the sorted population, without sorting it in one task.

    While a part of the order has more than ``part_rows`` agents, quantiles (and
    the least value) of its first key that is not the same for all of them cut it
    again; the id is the last key. Each part is then numbered on its own and
    shifted by the agents of the parts before.
    """
    spark, order = population.sparkSession, [*keys, ("_id", "asc")]
    rows = population.withColumn("_block", F.lit(0).cast("long"))
    points = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    for _ in range(LEVELS):
        ends = [x for i, (k, _) in enumerate(order) for x in (F.min(k).alias(f"_l{i}"), F.max(k).alias(f"_h{i}"))]
        sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), *ends)
        first = F.coalesce(*[F.when(F.col(f"_l{i}") < F.col(f"_h{i}"), F.lit(i)) for i in range(len(order))])
        large = sizes.select("_block", first.alias("_key"), *[F.col(f"_l{i}") for i in range(len(order))]).where((F.col("_n") > part_rows) & F.col("_key").isNotNull())
        held = large.collect()  # a row for each part that is cut again, later with its cuts: they are laid down, or each level would run all before it anew
        if not held:
            break
        large = spark.createDataFrame(held, large.schema)
        pick = lambda cols: F.coalesce(*[F.when(F.col("_key") == i, c.cast("double")) for i, c in enumerate(cols)])
        chosen = large.select("_block", "_key", pick([F.col(f"_l{i}") for i in range(len(order))]).alias("_least"))
        valued = rows.join(F.broadcast(chosen), "_block", "left").withColumn("_value", pick([F.col(k) for k, _ in order]))
        cuts = valued.where("_key IS NOT NULL").groupBy("_block").agg(F.percentile_approx("_value", points, 10_000).alias("_q"), F.first("_least").alias("_least"))
        cuts = cuts.select("_block", F.array_distinct(F.concat(F.array("_least"), "_q")).alias("_cuts"))
        cuts = spark.createDataFrame(cuts.collect(), cuts.schema)
        falls = F.col("_key").isin([i for i, (_, way) in enumerate(order) if way == "desc"])
        below = F.expr("size(filter(_cuts, c -> c < _value))")
        part = F.when(F.col("_key").isNull(), F.lit(0)).otherwise(F.when(falls, parts - below).otherwise(below))
        cut = valued.join(F.broadcast(cuts), "_block", "left").withColumn("_block", (F.col("_block") * (parts + 1) + part).cast("long"))
        rows = cut.select(*population.columns, "_block")
    offsets = rows_before(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), F.expr(f"_block div {parts + 1}"))
    inside = Window.partitionBy("_block").orderBy(*[getattr(F, w)(k) for k, w in keys], "_id")
    return rows.join(offsets, "_block").withColumn("_place", (F.col("_before") + F.row_number().over(inside)).cast("long")).drop("_block", "_before")


def sort_by_place(population: DataFrame, space) -> DataFrame:
    """Agents of a cell beside each other; nothing but the layout changes."""
    cells = [space.cell(i) for i in range(len(space.cells))]
    return population.repartitionByRange(*cells).sortWithinPartitions(*cells)
