"""Many runs of a model as one world: the run is a key of every population, message and join.

A step of all runs is one plan, so a sweep over thousands of runs costs as many
jobs as one run and is dealt out by rows, not by runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EnsembleError, EnvironmentError_
from ..model import Function, Model
from ..operators.reductions import Reduce, reduce_frame
from .runplans import RunPlans
from .world import StepLog, World

LOG = "run_id long, step long, name string, value double"


class Runs(World):
    """The runs of ``plans``, for models of agent functions alone; others go to an ``Ensemble``.

    Properties are columns of the plans and stay as planned, so what writes them
    or runs on the host (init, step, exit and host functions, exit conditions,
    submodels), what all agents share (macro properties, graphs) and births are
    refused. An agent is told by ``_run`` and ``_id``. Runs of fewer steps keep
    still from their last one on. Draws should hash ``_run`` as well.
    """

    by = ("_run",)

    def __init__(self, spark: SparkSession, model: Model, plans: RunPlans, checkpoint_every: int = 1):
        if plans.model is not model:
            raise EnsembleError("the plans are of another model")
        functions = model.functions()
        if (
            model.init or model.step or model.exit or model.exit_conditions or any(x.host or x.submodel for x in model.layers)
            or any(f.birth or f.macro or (f.read and (f.read.macro or f.read.graph)) for f in functions)
        ):
            raise EnsembleError("runs side by side take agent functions without births, macro properties and graphs")
        super().__init__(spark, model, checkpoint_every=checkpoint_every)
        value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
        planned = [(F.col(p.name) if p.name in plans.frame.columns else value(p.value)).alias(f"_env_{p.name}") for p in model.environment.properties.values()]
        frame = plans.frame.select(F.col("run_id").cast("long").alias("_run"), F.col("steps").cast("long").alias("_steps"), F.col("seed").alias("_env__seed"), *planned)
        path = f"{self._folder}/plans"
        frame.write.parquet(path)
        self.plans = spark.read.schema(frame.schema).parquet(path)  # a small file, so joins with it are broadcast by its size
        self.first_end, self.last_end = self.plans.agg(F.min("_steps"), F.max("_steps")).first()
        self.logs: dict[str, list[DataFrame]] = {"step": [], "exit": []}

    def set_population(self, agent: str, rows: DataFrame, state: str | None = None, order: str | None = None) -> None:
        """A population with ``_run``, or one that every run starts from."""
        if order:
            raise EnsembleError("agents of many runs need ids of their own")
        super().set_population(agent, rows if "_run" in rows.columns else rows.crossJoin(self.plans.select("_run")), state)

    def sql(self, expression, reader: str = ""):
        """SQL text with ``env.<name>`` as columns."""
        if not isinstance(expression, str):
            return expression

        def value(m: re.Match) -> str:
            if m[1] == "_step":
                return f"({self.step_count})"
            if m[1] == "_run":
                return f"{reader}_run"
            if m[1] != "_seed" and m[1] not in self.env:
                raise EnvironmentError_(f"unknown property {m[1]}")
            return f"{reader}_env_{m[1]}"

        return re.sub(r"\benv\.(\w+)", value, expression)

    def _surrounded(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.plans, "_run")

    def _condition(self, f: Function):
        if self.step_count < self.first_end:
            return super()._condition(f)
        going, own = F.expr(f"_steps > {self.step_count}"), super()._condition(f)
        return going if own is None else going & (F.expr(own) if isinstance(own, str) else own)

    def simulate(self, step_log: StepLog | None = None, exit_log: StepLog | None = None) -> Runs:  # noqa: the steps are those of the plans
        """All steps of all runs, with logs before the first and after each."""
        if self.first_end is not None and self.first_end < 1:
            raise EnsembleError("each run needs a number of steps")
        if step_log:
            self._note("step", step_log, self.plans)
        for step in range(1, (self.last_end or 0) + 1):
            self.step()
            if step_log and step % step_log.frequency == 0:
                self._note("step", step_log, self.plans.where(F.col("_steps") >= step))
        if exit_log:
            self._note("exit", exit_log, self.plans)
        return self

    def _note(self, which: str, what: StepLog, runs: DataFrame) -> None:
        step = F.col("_steps") if which == "exit" else F.lit(self.step_count).cast("long")
        row = lambda df, name, value: df.select(F.col("_run").alias("run_id"), step.alias("step"), F.lit(name).alias("name"), value.cast("double").alias("value"))
        parts = [row(runs, p, F.col(f"_env_{p}")) for p in what.properties if not self.model.environment.properties[p].length]
        for (agent, state), asked in what.reductions.items():
            every = [Reduce("count"), *[r for r in asked if r.how != "count"]]
            found = runs.select("_run", "_steps").join(reduce_frame(self.population(agent, state), *every, by=self.by), "_run", "left")
            for r in every:
                value = F.col(r.name)
                if r.how in ("count", "count_value", "mean", "standard_deviation"):  # 0 for a run without agents
                    value = F.coalesce(value, F.lit(0))
                parts.append(row(found, f"{agent}.{state}.{r.name}", value))
        if parts:
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            path = f"{self._folder}/log-{which}-{len(self.logs[which])}"
            out.where("value IS NOT NULL").write.parquet(path)
            self.logs[which].append(self.spark.read.schema(LOG).parquet(path))

    def log_frame(self, which: str = "exit") -> DataFrame:
        """(run_id, step, name, value) of all exit or step logs."""
        out = self.spark.createDataFrame([], LOG)
        for part in self.logs[which]:
            out = out.unionByName(part)
        return out
