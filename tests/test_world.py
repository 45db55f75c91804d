"""Worlds: births, deaths, states, messages, submodels, logs, ensembles, files, streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from swarmframe import cli
from swarmframe import errors as E
from swarmframe.model import Birth, Emit, Function, Model, Read
from swarmframe.operators import population as P
from swarmframe.operators import reductions as R
from swarmframe.operators import shapes as S
from swarmframe.operators.graphs import Graph
from swarmframe.plans.runplans import Ensemble, RunPlans
from swarmframe.plans.world import StepLog, World
from swarmframe.sources import state as IO
from swarmframe.types import Variable, wrapping_add


def counting(limit=0) -> Model:
    model = Model("count")
    model.environment.property("by", 1, "int64").property("fixed", 2.5, const=True).property("list", [1, 2, 3], "int64")
    model.environment.macro("grid", "double", (2, 3))
    model.agent("c").variable("v", "int64").variable("f", "double", default=1.5).variable("a", "int32", 2, [1, 2])
    model.layer(Function("add", "c", set={"v": "v + env.by"}))
    if limit:
        model.exit_conditions.append(lambda w: w.step_count >= limit)
    return model


def rows(world, agent="c", *names):
    return sorted(tuple(r[n] for n in names) for r in world.population(agent).collect())


def test_host_functions_and_environment(spark):
    model = counting(3)
    seen = []
    model.init.append(lambda w: w.new_agents("c", [{"v": 5}, {}]))
    model.step.append(lambda w: seen.append((w.step_count, w.reduce("c", R.Reduce("sum", "v"))["sum_v"])))
    model.layer(host=lambda w: w.set("by", w.get("by") + 1))
    w = World(spark, model).simulate()
    assert seen == [(1, 7), (2, 11), (3, 17)] and rows(w, "c", "_id", "v") == [(1, 11), (2, 6)]
    assert w.set("by", 9) == 4
    for name, value in (("fixed", 1.0), ("none", 1), ("list", [1])):
        with pytest.raises(E.SwarmError):
            w.set(name, value)
    assert w.histogram("c", "v", 2, 0.0, 20.0) == [1, 1] and w.count("c") == 2
    assert w.sql("env.list[1] + env._step") == "(2) + (3)"
    w.reset()
    assert w.count("c") == 0 and w.step_count == 0
    with pytest.raises(E.ModelError):
        w.new_agents("c", [{"nope": 1}])
    with pytest.raises(E.ModelError):
        World(spark, counting()).simulate()


def test_empty_population(spark):
    w = World(spark, counting())
    w.simulate(1)
    got = w.reduce("c", R.Reduce("count"), R.Reduce("min", "v"), R.Reduce("mean", "v"), R.Reduce("standard_deviation", "v"))
    assert got == {"count": 0, "min_v": None, "mean_v": 0.0, "standard_deviation_v": 0.0}
    with pytest.raises(E.ModelError):
        w.reduce("c", R.Reduce("sum", "a"))


def test_death_precedes_birth_and_ids_stay_unique(spark):
    model = Model("m")
    model.agent("a").variable("x", "int64")
    f = Function("f", "a", birth=Birth("a", {"x": "x * 10"}, when="x < 3"), alive="x <> 2", allow_death=True)
    model.layer(f)
    w = World(spark, model)
    w.new_agents("a", [{"x": i} for i in (1, 2, 3)])
    w.step()
    assert rows(w, "a", "_id", "x") == [(1, 1), (3, 3), (4, 10), (5, 20)]  # the parent that died still had its child
    P.checked_ids(w.population("a"))
    with pytest.raises(E.IdCollision):
        P.checked_ids(w.population("a").union(w.population("a")))


def test_state_moves_append(spark):
    model = Model("m")
    model.agent("a").variable("x", "int64").state("s").state("t")
    model.layer(Function("go", "a", initial="s", end="t", condition="x > 1"))
    w = World(spark, model)
    w.new_agents("a", [{"x": 1}, {"x": 2}], "s")
    w.new_agents("a", [{"x": 7}], "t")
    w.step()
    assert sorted((r["_id"], r["_state"]) for r in w.all_states("a").collect()) == [(1, "s"), (2, "t"), (3, "t")]


def test_messages_go_after_a_step(spark):
    model = Model("m")
    model.agent("a").variable("n", "int64")
    model.message("x").variable("v", "int64")
    model.layer(Function("read", "a", read=Read("x", {"got": "count(1)"}), set={"n": "got"}))
    model.layer(Function("write", "a", emit=Emit("x", {"v": "1"})))
    w = World(spark, model)
    w.new_agents("a", [{}, {}])
    w.simulate(2)
    assert rows(w, "a", "n") == [(0,), (0,)]


def test_bucket_bounds(spark):
    near = spark.createDataFrame([(1,), (9,)], "k long")
    assert S.check_keys(near, "k", 1, 9).count() == 2
    with pytest.raises(Exception, match="key outside bounds"):
        S.check_keys(near, "k", 1, 8).collect()
    with pytest.raises(E.MessageError):
        S.check_keys(near, "k", 3, 3)
    who = spark.createDataFrame([(1, 1, 10), (2, 5, 5), (3, 8, 10)], "_id long, b long, e long")
    got = S.read_bucket_range(who, near, "b", "e", "k", {"n": "count(m.k)"})
    assert sorted((r["_id"], r["n"]) for r in got.collect()) == [(1, 2), (2, 0), (3, 1)]  # the last key is read, an empty range is not


def test_wrapped_reads_are_checked(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.5, 9.5)], "_id long, x double, y double")
    space = S.Space((0.0, 0.0), (10.0, 10.0), 1.0)
    got = S.read_space(p, p, space, {"n": "count(m._id)"}, wrap=True, within=2.0, where="m._id <> a._id")
    assert [r["n"] for r in got.collect()] == [1, 1]
    with pytest.raises(E.MessageError):
        S.read_space(p, p, S.Space((0.0, 0.0), (10.0, 10.0), 3.0), {"n": "count(m._id)"}, wrap=True)
    with pytest.raises(E.MessageError):
        S.read_space(p, p, S.Space((0.0, 0.0), (10.0, 10.0), 5.0), {"n": "count(m._id)"}, wrap=True)
    out = spark.createDataFrame([(1, 11.0, 0.5)], "_id long, x double, y double")
    with pytest.raises(Exception, match="outside the bounds"):
        S.read_space(out, p, space, {"n": "count(m._id)"}, wrap=True).collect()
    assert S.read_space(out, p, space, {"n": "count(m._id)"}).first()["n"] == 0  # clamped into an edge cell
    for bad in (lambda: S.grid_offsets(2, 0), lambda: S.read_grid(p, p, [2, 9], ["x", "y"], {}, wrap=True), lambda: S.read_grid(p, p, [0], ["x"], {})):
        with pytest.raises(E.MessageError):
            bad()


def test_plans_have_no_needless_shuffle(spark):
    """A read by key shuffles each side once, and the fold not again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(100).selectExpr("id AS _id", "id % 7 AS k")
        got = S.read_bucket(a, a, "k", "k", {"n": "sum(m._id * a._id)"})
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wrapping_counter(spark):
    one = spark.range(1)
    assert one.select(wrapping_add("4294967295L", 1).alias("v")).first()["v"] == 0
    assert one.select(wrapping_add("0L", -1).alias("v")).first()["v"] == 2**32 - 1


def test_submodel_death_and_birth(spark):
    inner = Model("inner")
    inner.agent("x").variable("v", "int64")
    inner.layer(Function("f", "x", birth=Birth("x", {"v": "100"}, when="v = 1"), alive="v <> 2", allow_death=True))
    outer = Model("outer")
    outer.agent("y").variable("v", "int64").variable("keep", "int64", default=9)
    outer.environment.property("p", 1, "int64")
    inner.environment.property("q", 0, "int64")
    inner.exit.append(lambda w: w.set("q", w.get("q") + 5))
    outer.layer(submodel=outer.submodel("s", inner, agents={"x": "y"}, variables={"x": {"v": "v"}}, properties={"q": "p"}, max_steps=1))
    w = World(spark, outer)
    w.new_agents("y", [{"v": 1, "keep": 4}, {"v": 2}])
    w.step()
    assert rows(w, "y", "_id", "v", "keep") == [(1, 1, 4), (3, 100, 9)] and w.get("p") == 6


def test_logs(spark, tmp_path):
    w = World(spark, counting())
    w.new_agents("c", [{"v": 1}, {"v": 3}])
    log = StepLog({("c", "default"): [R.Reduce("mean", "v"), R.Reduce("max", "v")]}, ["by"], frequency=2, timing=True)
    w.simulate(4, log, log)
    assert [r["step"] for r in w.log] == [0, 2, 4] and w.log[1]["c.default.mean_v"] == 4.0 and w.exit_log["c.default.max_v"] == 7
    assert IO.log_frame(spark, w.log).where("name = 'c.default.count'").count() == 3
    for name in ("log.json", "log.xml"):
        IO.export_log(w, str(tmp_path / name))
        assert (tmp_path / name).read_text().count("mean_v") == 4
    assert json.loads((tmp_path / "log.json").read_text())["steps"][0]["by"] == 1
    with pytest.raises(E.StateIOError):
        IO.export_log(w, str(tmp_path / "log.txt"))


@pytest.mark.parametrize("name", ["state.json", "state.xml", "state"])
def test_states_round_trip(spark, tmp_path, name):
    w = World(spark, counting(), seed=12)
    w.new_agents("c", [{"v": -5, "f": 0.1, "a": [3, -4]}, {"f": math.nan}])
    w.simulate(2)
    w.set("list", [4, 5, 6])
    w.macros["grid"] = spark.createDataFrame([(1, 2, 0, 0, 7.5)], "i int, j int, k int, w int, value double")
    path = str(tmp_path / name)
    IO.export_state(w, path, pretty=True)
    back = IO.import_state(World(spark, counting()), path)
    key = lambda x: [(r["_id"], r["v"], repr(r["f"]), list(r["a"])) for r in x.population("c").orderBy("_id").collect()]
    assert key(back) == key(w) and back.env == w.env and (back.step_count, back.seed) == (2, 12)
    assert [tuple(r) for r in back.macros["grid"].collect()] == [(1, 2, 0, 0, 7.5)]
    part = IO.import_state(World(spark, counting()), path, ["environment"])
    assert part.env == w.env and part.count("c") == 0 and part.step_count == 0
    with pytest.raises(E.StateIOError):
        IO.import_state(back, path, ["nothing"])


@pytest.mark.parametrize("name", ["m.json", "m.xml", "m.bin"])
def test_macros_round_trip(spark, tmp_path, name):
    w = World(spark, counting())
    w.macros["grid"] = spark.createDataFrame([(1, 2, 0, 0, 7.5), (0, 1, 0, 0, -1.0)], "i int, j int, k int, w int, value double")
    IO.export_macro(w, "grid", str(tmp_path / name))
    w.macros["grid"] = w.macros["grid"].limit(0)
    IO.import_macro(w, "grid", str(tmp_path / name))
    assert sorted(tuple(r) for r in w.macros["grid"].collect()) == [(0, 1, 0, 0, -1.0), (1, 2, 0, 0, 7.5)]


def test_graphs(spark, tmp_path):
    v = spark.createDataFrame([(1, 0.5, [1, 2]), (4, 1.5, [3, 4])], "id long, w double, p array<int>")
    e = spark.createDataFrame([(1, 4, 7), (4, 4, 8)], "source long, dest long, c long")
    g = Graph(v, e).checked()
    IO.export_graph(g, str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "g.json").read_text())["links"][0] == {"source": "1", "target": "4", "c": 7}
    back = IO.import_graph(spark, str(tmp_path / "g.json"), {"w": Variable("w"), "p": Variable("p", "int32", 2)}, {"c": Variable("c", "int64")})
    assert sorted(map(tuple, back.vertices.collect())) == sorted(map(tuple, v.collect())) and sorted(map(tuple, back.edges.collect())) == [(1, 4, 7), (4, 4, 8)]
    assert g.vertex(4)["w"] == 1.5 and g.vertex(9) is None and g.edge(4, 4)["c"] == 8 and g.edge(4, 1) is None
    moved = g.rename_vertex(4, 6)
    assert moved.checked().edge(1, 6)["c"] == 7
    grown = g.upsert_edges(spark.createDataFrame([(1, 4, 0), (4, 1, 1)], "source long, dest long, c long"))
    assert sorted(map(tuple, grown.edges.collect())) == [(1, 4, 0), (4, 1, 1), (4, 4, 8)]
    for bad in (Graph(v.union(v), e), Graph(v.where("id = 1"), e), Graph(v, e.union(e)), Graph(v.withColumn("id", v["id"] - 1), e.limit(0))):
        with pytest.raises(E.GraphError):
            bad.checked()


def test_ensembles(spark, tmp_path):
    model = counting()
    model.init.append(lambda w: w.new_agents("c", [{}]))
    log = StepLog({("c", "default"): [R.Reduce("sum", "v")]})
    plans = RunPlans(spark, model, 3).steps(2).seeds(5, 10).stepped("by", 1, 2)
    run = Ensemble(spark, model, 2, exit_log=log, step_log=log)
    assert run.simulate(plans) == 0
    got = {r["run_id"]: r["value"] for r in run.log_frame().where("name = 'c.default.sum_v'").collect()}
    assert got == {0: 2.0, 1: 6.0, 2: 10.0} and run.logs[2]["seed"] == 25
    run.export(str(tmp_path / "logs"))
    both = plans + plans * 2
    assert both.n == 9 and [r["run_id"] for r in both.frame.orderBy("run_id").collect()] == list(range(9))
    model.exit.append(lambda w: 1 / 0 if w.run_id == 1 else None)
    with pytest.raises(E.EnsembleError):
        Ensemble(spark, model, 1).simulate(plans)
    assert Ensemble(spark, model, 1, "off").simulate(plans) == 1
    for bad in (lambda: RunPlans(spark, model, 1).lerp("by", 0, 1), lambda: plans.value("none", 1), lambda: plans.stepped("fixed", 0, 1), lambda: Ensemble(spark, model, errors="?"), lambda: plans + RunPlans(spark, counting(), 1)):
        with pytest.raises(E.EnsembleError):
            bad()
    drawn = plans.uniform("by", 3, 4).frame.collect()
    assert {r["by"] for r in drawn} <= {3, 4}


def test_command_line(spark, tmp_path, capsys):
    model = counting()
    model.init.append(lambda w: w.new_agents("c", [{}]))
    out = str(tmp_path / "log.json")
    w = cli.run(model, ["-s", "3", "-r", "4", "--out-log", out, "--out", str(tmp_path / "s.json"), "-t"], spark)
    assert (w.step_count, w.seed) == (3, 4) and "3 steps" in capsys.readouterr().out
    with pytest.raises(E.StateIOError):
        cli.run(model, ["-s", "1", "--out-log", out], spark)
    again = cli.run(counting(), ["-s", "1", "-q", "-i", str(tmp_path / "s.json")], spark)
    assert rows(again, "c", "v") == [(4,)]


def test_stream_of_births(spark, tmp_path):
    from swarmframe.streaming.feed import feed_births

    spark.range(4).selectExpr("id", "id * 10 AS v").write.parquet(str(tmp_path / "in"))
    w = World(spark, counting())
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    feed_births(stream, w, "c", "id").awaitTermination(60)
    assert w.step_count == 1 and rows(w, "c", "_id", "v") == [(1, 1), (2, 11), (3, 21), (4, 31)]


SOURCE = {
    "plain": ("def f(x, y):\n    return x * 2 + y ** 2 - 1", 12.0),
    "chain": ("def f(x, y):\n    return 1 if 0 < x < 3 and not y == 2 else 0", 1),
    "paths": ("def f(x, y):\n    z = x\n    if y > 2:\n        z += 1\n        if x > 5:\n            return 100\n    else:\n        z = 0\n    return z * 10", 30),
    "loop": ("def f(x, y):\n    s = 0\n    for i in range(4):\n        s += i * x\n    return s", 12),
    "maths": ("import math\ndef f(x, y):\n    return math.floor(math.sqrt(x * 8.0)) + int(max(x, y)) + abs(-y) + math.pow(x, y) * 0", 10.0),
    "bits": ("def f(x, y):\n    return ((x << 3) | 1) & 0xff ^ (y >> 1)", 16),
}


@pytest.mark.parametrize("case", SOURCE)
def test_translation(spark, case):
    from swarmframe.functions.translate import translate

    source, want = SOURCE[case]
    got = spark.createDataFrame([(2, 3)], "x long, y long").select(translate(source).alias("v")).first()["v"]
    assert got == want


@pytest.mark.parametrize("body", ["import os", "global x", "del x", "assert x", "yield x", "return x in [1]", "a = b = x\n    return a", "while x:\n        pass", "return open(x)", "return f'{x}'", "pass", "return [x]"])
def test_translation_limits(spark, body):
    from swarmframe.functions.translate import translate

    with pytest.raises(E.TranslationError):
        translate(f"def f(x):\n    {body}")


def test_vectors(spark):
    from swarmframe.operators.vectors import AgentVector

    w = World(spark, counting())
    variables = list(w.model.agents["c"].variables.values())
    v = AgentVector(variables, 2)
    v.push_back({"v": 7, "a": [5, 6]})
    v.insert(0, {"v": -1}, None)
    assert v.data("v") == [-1, 0, 0, 0, 7] and v[4].element("a", 1) == 6 and v[4].element("a", 0, 9) == 9
    v.erase(1, 3)
    v.pop_back()
    v.resize(3)
    assert v.data("v") == [-1, 0, 0]
    other = AgentVector(variables)
    other.swap(v)
    assert len(v) == 0 and len(other) == 3 and other[0] == other[0].copy() and other != v
    other[1]["v"] = 4
    w.set_vector("c", other)
    w.step()
    back = w.vector("c")
    assert [(r.id, r["v"]) for r in back] == [(1, 0), (2, 5), (3, 1)]
    back.push_back({"v": 50})
    w.set_vector("c", back)
    assert rows(w, "c", "_id", "v") == [(1, 0), (2, 5), (3, 1), (4, 50)]
    for bad in (lambda: v.pop_back(), lambda: v.push_back({"no": 1}), lambda: other[0].element("a", 2), lambda: other[0]["no"], lambda: v.push_back(AgentVector([], 1)[0])):
        with pytest.raises(E.ModelError):
            bad()


def test_layout_changes_nothing(spark):
    def run(period):
        model = Model("m")
        agent = model.agent("a").variable("x").variable("y").variable("n", "int64")
        agent.sort_period = period
        model.message("at", shape="space", space=S.Space((0.0, 0.0), (10.0, 10.0), 1.0)).variable("id", "int64")
        model.layer(Function("show", "a", emit=Emit("at", {"x": "x", "y": "y", "id": "_id"})))
        model.layer(Function("look", "a", read=Read("at", {"met": "count(m.id)"}, within=1.0), set={"n": "met"}))
        w = World(spark, model)
        w.set_population("a", spark.range(200).selectExpr("id + 1 AS _id", "(id * 37 % 100) / 10 AS x", "(id * 61 % 100) / 10 AS y"))
        return rows(w.simulate(2), "a", "_id", "n")

    assert run(0) == run(1)


def test_hot_keys_in_parts(spark):
    sent = spark.range(400).selectExpr("id AS v", "CASE WHEN id < 300 THEN 1 ELSE id % 9 END AS k")
    who = spark.range(12).selectExpr("id AS _id", "id AS key")
    fold = {"n": "count(1)", "m": "count(*)", "top": "max(m.v + a._id)", "mean": "avg(m.v)"}
    read = lambda parts: sorted(map(tuple, S.read_bucket(who, sent, "key", "k", fold, parts=parts).collect()), key=str)
    one = read(1)
    assert one == read(7) and {r[0]: r[2] for r in one}[11] == 0  # an agent without messages counts none
    p = spark.range(300).selectExpr("id AS _id", "CASE WHEN id < 200 THEN 5.5 ELSE id / 30 END AS x", "5.5D AS y").withColumn("x", F.col("x").cast("double"))
    space = S.Space((0.0, 0.0), (10.0, 10.0), 1.0)
    near = lambda parts: sorted(map(tuple, S.read_space(p, p, space, {"n": "count(m._id)"}, within=1.0, parts=parts).select("_id", "n").collect()))
    assert near(1) == near(4)
