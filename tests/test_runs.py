"""Many runs as one world against an ensemble of worlds; hot keys that a count finds; functions from a file."""

import pytest
from pyspark.sql import functions as F

from swarmframe import cli
from swarmframe.errors import EnsembleError, EnvironmentError_
from swarmframe.functions.translate import translate
from swarmframe.model import Birth, Emit, Function, Model, Read
from swarmframe.operators import reductions as R
from swarmframe.operators import shapes as S
from swarmframe.plans.runplans import Ensemble, RunPlans
from swarmframe.plans.runs import Runs
from swarmframe.plans.world import StepLog

LOG = StepLog({("a", "young"): [R.Reduce("sum", "v"), R.Reduce("mean", "v")], ("a", "old"): [R.Reduce("max", "v")]}, ["by"])


def agents(spark):
    return spark.range(40).selectExpr("id + 1 AS _id", "id % 4 AS k", "id AS v", "id % 8 AS x", "CAST(id DIV 8 AS DOUBLE) AS y", "double(id % 8) AS z")


def model_of(shape: str, read: Read, emit: dict, **kind) -> Model:
    model = Model("many")
    model.agent("a").variable("k", "int64").variable("v", "int64").variable("x", "int64").variable("y").variable("z").state("young").state("old")
    model.environment.property("by", 1, "int64").property("fixed", [2, 5], "int64")
    model.message("m", shape=shape, **kind).variable("v", "int64")
    model.layer(Function("say", "a", initial="young", emit=Emit("m", emit | {"v": "v % 1000 + env.by"}, "v % 7 <> env._run")))
    model.layer(Function("hear", "a", initial="young", read=read, set={"v": "(v + n * env.by + env.fixed[1] + env._step) % 100003"}, alive="v % 31 <> 30", allow_death=True))
    model.layer(Function("age", "a", initial="young", end="old", condition="v > 50000 + 100 * env.by"))
    return model


CASES = {
    "all": ("all", Read("m", {"n": "sum(m.v)"}, defaults={"n": 0}), {}, {}),
    "pairs": ("all", Read("m", {"n": "count(1)"}, where="m.v < a.v + env.by"), {}, {}),
    "bucket": ("bucket", Read("m", {"n": "sum(m.v * env.by)"}, key="k", defaults={"n": 0}), {"_key": "k"}, {"bounds": (0, 9)}),
    "range": ("bucket", Read("m", {"n": "count(1)"}, range=("k", "k + 2")), {"_key": "k"}, {"bounds": (0, 9)}),
    "space": ("space", Read("m", {"n": "sum(m.v)"}, within=1.0, defaults={"n": 0}), {"x": "z", "y": "y"}, {"space": S.Space((0.0, 0.0), (8.0, 8.0), 1.0)}),
    "grid": ("grid", Read("m", {"n": "sum(m.v)"}, at=("x", "CAST(y AS BIGINT)"), defaults={"n": 0}), {"_ix": "x", "_iy": "CAST(y AS BIGINT)"}, {"size": (8, 8)}),
    "index": ("grid", Read("m", {"n": "m.v"}, at=("(x + env.by) % 8", "CAST(y AS BIGINT)")), {"_ix": "x", "_iy": "CAST(y AS BIGINT)"}, {"size": (8, 8)}),
}


@pytest.mark.parametrize("case", CASES)
def test_runs_side_by_side(spark, case):
    """Logs of all runs are those of an ensemble that runs its worlds one by one, also where runs differ in steps."""
    shape, read, emit, kind = CASES[case]
    log = lambda df: sorted(map(tuple, df.collect()))
    plans = lambda m: RunPlans(spark, m, 2).steps(1).stepped("by", 1, 2) + RunPlans(spark, m, 1).steps(2).value("by", 4)
    model = model_of(shape, read, emit, **kind)
    with Runs(spark, model, plans(model)) as runs:
        runs.set_population("a", agents(spark), "young")
        runs.simulate(LOG, LOG)
        got = log(runs.log_frame("exit")), log(runs.log_frame("step"))
    model = model_of(shape, read, emit, **kind)
    model.init.append(lambda w: w.set_population("a", agents(w.spark), "young"))
    one = Ensemble(spark, model, 1, step_log=LOG, exit_log=LOG)
    one.simulate(plans(model))
    assert got == (log(one.log_frame("exit")), log(one.log_frame("step")))
    assert len({r[3] for r in got[0] if r[2] == "a.young.sum_v"}) == 3


def test_runs_refuse(spark):
    shape, read, emit, kind = CASES["all"]
    model = model_of(shape, read, emit, **kind)
    plans = RunPlans(spark, model, 2)
    runs = Runs(spark, model, plans)
    with pytest.raises(EnsembleError):
        runs.set_population("a", agents(spark), "young", order="k")
    with pytest.raises(EnvironmentError_):
        runs.sql("v + env.none")
    with pytest.raises(EnsembleError):
        Runs(spark, model, plans.steps(0)).simulate()
    empty = Runs(spark, model, RunPlans(spark, model, 0)).simulate(LOG, LOG)
    assert not empty.log_frame().head(1)
    runs.simulate(exit_log=LOG)  # no agents at all
    assert {(r.run_id, r.value) for r in runs.log_frame().where("name = 'a.young.count'").collect()} == {(0, 0.0), (1, 0.0)}
    with pytest.raises(EnsembleError):
        Runs(spark, model_of(shape, read, emit, **kind), plans)
    model.layer(Function("bear", "a", initial="young", birth=Birth("a", {})))
    with pytest.raises(EnsembleError):
        Runs(spark, model, RunPlans(spark, model, 1))


def test_hot_keys_found_by_a_count(spark, monkeypatch):
    sent = spark.range(400).selectExpr("id AS v", "CASE WHEN id < 300 THEN 1 WHEN id = 399 THEN NULL ELSE id % 9 END AS k")
    who = spark.range(12).selectExpr("id AS _id", "CASE WHEN id = 11 THEN NULL ELSE id END AS key")
    fold = {"n": "count(1)", "top": "max(m.v + a._id)", "mean": "avg(m.v)"}
    read = lambda parts: sorted(map(tuple, S.read_bucket(who, sent, "key", "k", fold, parts=parts).collect()), key=str)
    near = lambda parts: sorted(map(tuple, S.read_bucket_range(who, sent, "key", "key + 3", "k", fold, parts=parts).collect()), key=str)
    plain = read(1), near(1)
    assert (read(0), near(0)) == plain  # too few messages for any key to be hot
    monkeypatch.setattr(S, "HOT_ROWS", 40)
    assert (read(0), near(0)) == plain
    _, dealt, keys = S.dealt(who.withColumn("_k", F.col("key")), sent.withColumnRenamed("k", "_k"), ["_k"], 0)
    parts = {r["_k"]: r["n"] for r in dealt.groupBy("_k").agg(F.countDistinct("_part").alias("n")).collect()}
    assert keys == ["_k", "_part"] and parts[1] > 4 and all(n == 1 for k, n in parts.items() if k != 1)
    assert dealt.count() == 400


def test_function_from_a_file(spark, tmp_path):
    path = tmp_path / "double.py"
    path.write_text("def double(id):\n    return id * 2\n")
    assert [r[0] for r in spark.range(3).select(translate(path)).collect()] == [0, 2, 4]


def test_console_flag():
    assert cli.parser("m").parse_args(["--console"]).console
