"""Run plans and ensembles: one row for each run, properties by formula.

Plans are a frame (run_id, steps, seed, group, one column for each property), so
a sweep over any number of runs is built without a loop on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EnsembleError
from ..functions.rng import AgentRandom
from ..model import Model
from ..types import FLOATS
from .world import StepLog, World


class RunPlans:
    """``n`` runs of a model. Every setter gives a new object."""

    def __init__(self, spark: SparkSession, model: Model, n: int, frame: DataFrame | None = None, seed: int = 0):
        if n < 0:
            raise EnsembleError("the number of runs may not be negative")
        self.spark, self.model, self.n, self.seed = spark, model, n, seed
        self.frame = frame if frame is not None else spark.range(n).select(F.col("id").alias("run_id"), F.lit(1).cast("long").alias("steps"), F.lit(0).cast("long").alias("seed"), F.lit("").alias("folder"))

    def _with(self, name: str, column) -> RunPlans:
        return RunPlans(self.spark, self.model, self.n, self.frame.withColumn(name, column), self.seed)

    def _property(self, name: str):
        p = self.model.environment.properties.get(name)
        if p is None:
            raise EnsembleError(f"unknown property {name}")
        if p.const:
            raise EnsembleError(f"property {name} is constant")
        return p

    def _typed(self, name: str, column) -> RunPlans:
        whole = self._property(name).kind not in FLOATS
        return self._with(name, F.round(column).cast("long") if whole else column.cast("double"))

    def steps(self, n: int) -> RunPlans:
        return self._with("steps", F.lit(n).cast("long"))

    def seeds(self, first: int, step: int = 1) -> RunPlans:
        return self._with("seed", (F.lit(first) + F.col("run_id") * step).cast("long"))

    def folder(self, name: str) -> RunPlans:
        return self._with("folder", F.lit(name))

    def value(self, name: str, value) -> RunPlans:
        return self._with(name, F.array(*map(F.lit, value)) if isinstance(value, list | tuple) else F.lit(self._property(name) and value))

    def lerp(self, name: str, low: float, high: float) -> RunPlans:
        """low * (1 - a) + high * a with a = i / (n - 1); integers are rounded."""
        if self.n < 2:
            raise EnsembleError("a range needs two runs or more")
        a = F.col("run_id") / F.lit(self.n - 1)
        return self._typed(name, F.lit(float(low)) * (F.lit(1.0) - a) + F.lit(float(high)) * a)

    def stepped(self, name: str, first: float, step: float) -> RunPlans:
        return self._typed(name, F.lit(first) + F.col("run_id") * F.lit(step))

    def _draw(self, name: str) -> AgentRandom:
        return AgentRandom(self.seed, 0, name, "run_id")

    def uniform(self, name: str, low: float, high: float) -> RunPlans:
        whole = self._property(name).kind not in FLOATS
        draw = self._draw(name)
        return self._with(name, draw.uniform_int(int(low), int(high)) if whole else draw.uniform_range(low, high))

    def normal(self, name: str, mean: float, deviation: float) -> RunPlans:
        return self._typed(name, F.lit(float(mean)) + F.lit(float(deviation)) * self._draw(name).normal())

    def log_normal(self, name: str, mean: float, deviation: float) -> RunPlans:
        return self._typed(name, self._draw(name).log_normal(mean, deviation))

    def drawn(self, name: str, column: Callable[[AgentRandom], object]) -> RunPlans:
        """Any distribution, as a column made from a source of draws."""
        return self._typed(name, column(self._draw(name)))

    def __add__(self, other: RunPlans) -> RunPlans:
        """Runs of both, numbered on."""
        if self.model is not other.model:
            raise EnsembleError("plans of two models cannot be joined")
        moved = other.frame.withColumn("run_id", F.col("run_id") + self.n)
        return RunPlans(self.spark, self.model, self.n + other.n, self.frame.unionByName(moved, allowMissingColumns=True), self.seed)

    def __mul__(self, times: int) -> RunPlans:
        """The runs repeated, numbered on."""
        again = self.spark.range(times).select(F.col("id").alias("_time"))
        rows = self.frame.crossJoin(F.broadcast(again)).withColumn("run_id", F.col("run_id") + F.col("_time") * self.n).drop("_time")
        return RunPlans(self.spark, self.model, self.n * times, rows, self.seed)


class Ensemble:
    """Runs a model under many plans, a few at a time.

    ``errors`` is "off" (failed runs are only counted), "slow" (all run, then an
    error if one failed) or "fast" (the first failure stops what has not begun).
    """

    def __init__(self, spark: SparkSession, model: Model, concurrent: int = 4, errors: str = "slow", step_log: StepLog | None = None, exit_log: StepLog | None = None):
        if errors not in ("off", "slow", "fast"):
            raise EnsembleError(f"unknown error level {errors}")
        self.spark, self.model, self.concurrent, self.errors = spark, model, concurrent, errors
        self.step_log, self.exit_log = step_log, exit_log
        self.logs: dict[int, dict] = {}
        self.failed: dict[int, str] = {}

    def simulate(self, plans: RunPlans) -> int:
        """The number of failed runs. A plan is a row of parameters, so plans are read to the driver in turn."""
        if plans.model is not self.model:
            raise EnsembleError("the plans are of another model")
        stop = False

        def one(row) -> None:
            nonlocal stop
            if stop:
                return
            try:
                world = World(self.spark, self.model, row["seed"], row["run_id"])
                for name in self.model.environment.properties:
                    if name in row.asDict() and row[name] is not None:
                        world.env[name] = row[name]
                world.simulate(row["steps"], self.step_log, self.exit_log)
                self.logs[row["run_id"]] = {"steps": world.log, "exit": world.exit_log, "seed": row["seed"], "properties": dict(world.env)}
            except Exception as error:
                self.failed[row["run_id"]] = f"{type(error).__name__}: {error}"
                stop = stop or self.errors == "fast"

        with ThreadPoolExecutor(self.concurrent) as pool:
            list(pool.map(one, plans.frame.orderBy("run_id").toLocalIterator()))
        if self.failed and self.errors != "off":
            raise EnsembleError(f"{len(self.failed)} runs failed: {dict(sorted(self.failed.items())[:3])}")
        return len(self.failed)

    def log_frame(self, which: str = "exit") -> DataFrame:
        """(run_id, step, name, value) of all exit or step logs."""
        rows = []
        for run, log in sorted(self.logs.items()):
            for row in ([log["exit"]] if which == "exit" else log["steps"]):
                rows += [(run, row["step"], k, float(v)) for k, v in (row or {}).items() if k != "step" and isinstance(v, int | float)]
        return self.spark.createDataFrame(rows, "run_id long, step long, name string, value double")

    def export(self, folder: str) -> None:
        """Logs as JSON, a folder for each run."""
        rows = [(r, json.dumps(x, default=str)) for r, x in sorted(self.logs.items())]
        self.spark.createDataFrame(rows, "run_id long, value string").write.mode("overwrite").partitionBy("run_id").text(folder)


def ensemble_frame(populations: DataFrame, plans: RunPlans) -> DataFrame:
    """All runs as one frame: each agent once for each run, with the run's properties beside it.

    For runs of a fixed number of steps this is the cheapest way: one plan, with
    ``run_id`` among the keys of every join and group.
    """
    return populations.crossJoin(F.broadcast(plans.frame) if plans.n <= 10_000 else plans.frame)
