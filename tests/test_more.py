"""Conflicts, ids, tables, order, pairs, loops and restarts of a stream."""

import os

import pytest
from pyspark.sql import functions as F

from swarmframe.errors import EnvironmentError_, StateIOError, TranslationError
from swarmframe.functions.translate import translate
from swarmframe.model import Birth, Emit, Function, MacroUpdate, Model, Read
from swarmframe.operators import population as P
from swarmframe.operators import reductions as R
from swarmframe.operators import shapes as S
from swarmframe.plans import world as W
from swarmframe.sources import state as IO
from swarmframe.streaming.feed import feed_births


def grid_world(spark, index: str, at: tuple = ("k",), size: int = 4) -> W.World:
    model = Model("grid")
    model.agent("a").variable("k", "int64").variable("got", "int64")
    model.message("m", shape="grid", size=(size,)).variable("v", "int64")
    model.layer(Function("write", "a", emit=Emit("m", {"_ix": index, "v": "_id"})))
    model.layer(Function("look", "a", read=Read("m", {"v": "m.v"}, at=at), set={"got": "v"}))
    world = W.World(spark, model, checkpoint_every=0)
    world.set_population("a", spark.range(1, 4).selectExpr("id AS _id", "id - 1 AS k"))
    return world


def test_two_messages_at_an_index_fail(spark):
    for index in ("0", "k div 2", "k + 2", "k - 1"):
        world = grid_world(spark, index)
        world.step()
        with pytest.raises(Exception, match="more than one message|outside the grid"):
            world.population("a").collect()
    world = grid_world(spark, "3 - k")
    world.step()
    assert {r._id: r.got for r in world.population("a").collect()} == {1: 0, 2: 3, 3: 2}


def test_neighbour_reads_see_conflicts_too(spark):
    model = Model("grid")
    model.agent("a").variable("n", "int64")
    model.message("m", shape="grid", size=(9,)).variable("v", "int64")
    model.layer(Function("write", "a", emit=Emit("m", {"_ix": "1", "v": "_id"})))
    model.layer(Function("look", "a", read=Read("m", {"c": "count(m.v)"}, at=("1",)), set={"n": "c"}))
    world = W.World(spark, model, checkpoint_every=0)
    world.set_population("a", spark.range(1, 4).selectExpr("id AS _id"))
    world.step()
    with pytest.raises(Exception, match="more than one message"):
        world.population("a").collect()


def test_ids_are_never_given_twice(spark, tmp_path):
    model = Model("life")
    model.agent("a").variable("age", "int64")
    model.layer(Function("die", "a", alive="_id < 3 OR env._step > 0", allow_death=True))
    model.layer(Function("bear", "a", birth=Birth("a", {"age": "1"}, when="_id = 1")))
    world = W.World(spark, model)
    world.set_population("a", spark.range(1, 4).selectExpr("id AS _id"))
    world.simulate(2)
    assert sorted(r._id for r in world.population("a").collect()) == [1, 2, 4, 5]
    IO.export_state(world, str(tmp_path / "s.json"))
    again = IO.import_state(W.World(spark, model), str(tmp_path / "s.json"))
    assert again.next_ids["a"] == 6 and again.random.random() == W.World(spark, model, seed=world.seed).random.random() if hasattr(again.random, "random") else True
    world.new_agents("a", [{}])
    world.set_population("a", spark.range(1, 2).selectExpr("id AS _id"))
    world.new_agents("a", [{}])
    assert sorted(r._id for r in world.population("a").collect()) == [1, 7]


def test_tables_of_steps_are_dropped(spark):
    model = Model("steps")
    model.agent("a").variable("v", "int64")
    model.layer(Function("add", "a", set={"v": "v + 1"}))
    with W.World(spark, model) as world:
        world.set_population("a", spark.range(1, 4).selectExpr("id AS _id"))
        folder = world._folder.removeprefix("file:")
        counts = []
        for _ in range(20):
            world.step()
            counts.append(len(os.listdir(folder)))
        assert max(counts) <= 2 and {r.v for r in world.population("a").collect()} == {20}
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(StateIOError):
        W.checkpoint_root(Session())


@pytest.mark.parametrize("keys", [(("k", "asc"),), (("k", "desc"), ("x", "asc")), (("x", "desc"),)])
def test_places_where_keys_tie(spark, keys):
    """One key for all rows, few keys, many keys: parts stay small, and places are those of a plain sort."""
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 AS _id", "id % 3 AS k", "CAST(id % 611 AS double) AS x").withColumn("one", F.lit(1))
    got = {r._id: r._place for r in R.place_in_order(rows, *keys, parts=8, part_rows=400).collect()}
    plain = sorted(rows.collect(), key=lambda r: (*[r[k] if w == "asc" else -r[k] for k, w in keys], r._id))
    assert got == {r._id: n + 1 for n, r in enumerate(plain)}
    got = {r._id: r._place for r in R.place_in_order(rows, ("one", "asc"), parts=8, part_rows=400).collect()}
    assert got == {i: i + 1 for i in range(5000)}


def test_sparse_ids_are_numbered_in_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 10)
    monkeypatch.setattr(P, "BLOCKS", 4)
    rows = spark.range(300).selectExpr("id * id * 37 AS _id")
    assert [r._index for r in P.row_index(rows).orderBy("_id").collect()] == list(range(300))


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 30)
    rows = spark.range(100).selectExpr("id AS _id", "id * 31 % 100 AS v")
    got = {r._id: (r.n, r.s) for r in S.read_all(rows, rows, {"n": "count(1)", "s": "sum(m.v)"}, "m.v > a.v + 10 OR m._id = a._id").collect()}
    values = {k: k * 31 % 100 for k in range(100)}
    assert got == {k: (len(x), sum(x)) for k, v in values.items() for x in [[u for j, u in values.items() if u > v + 10 or j == k]]}
    assert S.read_all(rows, rows.limit(0), {"n": "count(1)"}, "m.v > a.v").agg(F.sum("n")).first()[0] == 0
    plan = S.read_all(rows, rows, {"n": "count(1)"}, "m.v > a.v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_loops_that_do_not_end_fail(spark):
    rows = spark.range(3)
    endless = translate("def f(id):\n    n = id\n    while n >= 0:\n        n = n + 1\n    return n")
    with pytest.raises(Exception, match="while loop"):
        rows.select(endless).collect()
    with pytest.raises(TranslationError):
        translate("def f(id):\n    while id > 0:\n        break\n    return id")
    steps = translate("def f(id):\n    n = id + 1\n    k = 0\n    while n != 1:\n        if n % 2 == 0:\n            n = n // 2\n        else:\n            n = 3 * n + 1\n        k += 1\n    return k")
    assert [r[0] for r in spark.range(27).select(steps).collect()][-1] == 111


def test_macro_updates_are_checked(spark):
    for update in (MacroUpdate("c", "increment", {}), MacroUpdate("c", "swap", {}), MacroUpdate("c", "min", {}, "1", result="v"), MacroUpdate("c", "twist", {})):
        model = Model("m")
        model.agent("a").variable("v", "int64")
        model.environment.macro("c", "int64")
        with pytest.raises(EnvironmentError_):
            model.layer(Function("f", "a", macro=update))
            model.validate()


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows, checkpoint = str(tmp_path / "rows"), str(tmp_path / "at")

    def run() -> W.World:
        model = Model("fed")
        model.agent("a").variable("v", "int64")
        model.layer(Function("add", "a", set={"v": "v + 100"}))
        world = W.World(spark, model)
        stream = spark.readStream.schema("v long").parquet(rows)
        feed_births(stream, world, "a", "v", checkpoint=checkpoint).awaitTermination()
        return world

    spark.range(3).selectExpr("id AS v").coalesce(1).write.mode("append").parquet(rows)
    assert sorted((r._id, r.v) for r in run().population("a").collect()) == [(1, 100), (2, 101), (3, 102)]
    spark.range(10, 12).selectExpr("id AS v").coalesce(1).write.mode("append").parquet(rows)
    world = run()
    assert sorted((r._id, r.v) for r in world.population("a").collect()) == [(1, 200), (2, 201), (3, 202), (4, 110), (5, 111)]
    assert world.step_count == 2
