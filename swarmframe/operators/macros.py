"""Macro properties: sparse arrays of up to four axes that agents update together.

A property is rows (i, j, k, w, value); cells without a row hold 0. Agents send
(cell, amount) rows; an update groups them by cell, combined before the shuffle,
and merges the result with what is there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EnvironmentError_

AXES = ("i", "j", "k", "w")
#: Ids of a block within which results of one cell are summed by one task.
BLOCK = 65_536


def cells_of(rows: DataFrame, index: dict[str, str], value: str, extra: Sequence[str] = ()) -> DataFrame:
    """(i, j, k, w, value) of sent rows; axes that are not named are 0."""
    return rows.select(*[F.expr(index.get(a, "0")).cast("int").alias(a) for a in AXES], F.expr(value).alias("value"), *extra)


def checked(cells: DataFrame, size: Sequence[int]) -> DataFrame:
    """Cells outside the property's dimensions fail the job."""
    full = (*size, *(1,) * (4 - len(size)))
    inside = F.lit(True)
    for a, n in zip(AXES, full, strict=True):
        inside = inside & F.col(a).between(0, n - 1)
    return cells.withColumn("i", F.when(inside, F.col("i")).otherwise(F.raise_error(F.lit("cell outside the macro property")).cast("int")))


def read_cells(rows: DataFrame, held: DataFrame, index: dict[str, str], name: str) -> DataFrame:
    """Rows with the value of the cell each names, 0 where nothing is held."""
    asked = rows.withColumns({f"_m{a}": F.expr(index.get(a, "0")).cast("int") for a in AXES})
    found = held.select(*[F.col(a).alias(f"_m{a}") for a in AXES], F.col("value").alias(name))
    keys = [f"_m{a}" for a in AXES]
    return asked.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(0))).drop(*keys)


def update(held: DataFrame, sent: DataFrame, how: str) -> DataFrame:
    """``how`` is add, subtract, min or max; cells that hold nothing count as 0."""
    merge = {"add": "sum", "subtract": "sum", "min": "min", "max": "max"}.get(how)
    if merge is None:
        raise EnvironmentError_(f"unknown update {how}")
    new = sent.groupBy(*AXES).agg(getattr(F, merge)(-F.col("value") if how == "subtract" else F.col("value")).alias("_new"))
    both = held.join(new, list(AXES), "full")
    old = F.coalesce("value", F.lit(0))
    value = old + F.coalesce("_new", F.lit(0)) if merge == "sum" else F.when(F.col("_new").isNull(), old).otherwise((F.least if how == "min" else F.greatest)(old, F.col("_new")))
    return both.select(*AXES, value.alias("value"))


def add_with_results(held: DataFrame, sent: DataFrame, order: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Adds, and what each sender found before its own addition, in the order of ids."""
    sent = sent.withColumn("_block", F.expr(f"`{order}` div {BLOCK}"))  # a hot cell is summed in blocks of ids
    below = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sent.groupBy(*AXES, "_block").agg(F.sum("value").alias("_n"))
    sums = sums.select(*AXES, "_block", below(Window.partitionBy(*AXES).orderBy("_block"), "_n").alias("_above"))
    inside = sent.withColumn("_below", below(Window.partitionBy(*AXES, "_block").orderBy(order), "value"))
    found = inside.join(sums, [*AXES, "_block"]).join(held.withColumnRenamed("value", "_held"), list(AXES), "left")
    results = found.select(order, *AXES, (F.coalesce("_held", F.lit(0)) + F.col("_above") + F.col("_below")).alias("old"))
    sent = sent.drop("_block")
    return update(held, sent.drop(order), "add"), results


def exchange(held: DataFrame, sent: DataFrame, order: str = "_id") -> DataFrame:
    """The last sender by id leaves its value."""
    new = sent.groupBy(*AXES).agg(F.max_by("value", order).alias("_new"))
    return held.join(new, list(AXES), "full").select(*AXES, F.coalesce("_new", "value").alias("value"))


def exchange_results(held: DataFrame, sent: DataFrame, order: str = "_id") -> DataFrame:
    """What each sender took out: the value of the sender before it by id, of the cell for the first."""
    before = F.lag("value").over(Window.partitionBy(*AXES).orderBy(order))
    found = sent.withColumn("_before", before).join(held.withColumnRenamed("value", "_held"), list(AXES), "left")
    return found.select(order, F.coalesce("_before", "_held", F.lit(0)).alias("old"))


def swap_results(held: DataFrame, sent: DataFrame, expected: str = "expected", order: str = "_id") -> DataFrame:
    """What each sender of a compare-and-swap found. Those that expect something else come first, then the
    winner, then those that lost to it: they find its value."""
    rows = sent.join(held.withColumnRenamed("value", "_held"), list(AXES), "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    wins = rows.where(F.col(expected) == F.col("_held")).groupBy(*AXES).agg(F.min_by("value", order).alias("_new"), F.min(order).alias("_winner"))
    both = rows.join(wins, list(AXES), "left")
    lost = (F.col(expected) == F.col("_held")) & (F.col(order) != F.col("_winner"))
    return both.select(order, F.when(lost, F.col("_new")).otherwise(F.col("_held")).alias("old"))


def compare_and_swap(held: DataFrame, sent: DataFrame, expected: str = "expected", order: str = "_id") -> DataFrame:
    """One round of compare-and-swap: the first sender by id whose expectation holds wins the cell."""
    now = sent.join(held.withColumnRenamed("value", "_held"), list(AXES), "left").where(F.col(expected) == F.coalesce("_held", F.lit(0)))
    new = now.groupBy(*AXES).agg(F.min_by("value", order).alias("_new"))
    return held.join(new, list(AXES), "full").select(*AXES, F.coalesce("_new", "value").alias("value"))


def dense_macro(held: DataFrame, size: Sequence[int]) -> DataFrame:
    """A row for each cell."""
    full = (*size, *(1,) * (4 - len(size)))
    total = full[0] * full[1] * full[2] * full[3]
    step, at = total, []
    for a, n in zip(AXES, full, strict=True):
        step //= n
        at.append((F.expr(f"id div {step}") % n).cast("int").alias(a))
    every = held.sparkSession.range(total).select(*at)
    return every.join(held, list(AXES), "left").select(*AXES, F.coalesce("value", F.lit(0)).alias("value"))


def arithmetic(held: DataFrame, size: Sequence[int], sql: str) -> DataFrame:
    """Host arithmetic on every cell; ``sql`` is over ``value``."""
    return dense_macro(held, size).withColumn("value", F.expr(sql))


def zero(held: DataFrame) -> DataFrame:
    return held.where(F.lit(False))
