"""More queries: round trips of states, logs, macro properties and graphs, typed macro properties, ids, host functions, translated code."""

from __future__ import annotations

import json
import math
import os
import tempfile

from pyspark.sql import functions as F

from ..functions.translate import translate
from ..model import Birth, Emit, Function, MacroUpdate, Model, Read
from ..operators import reductions as R
from ..operators import shapes as S
from ..operators import vectors as V
from ..operators.graphs import Graph
from ..sources import state as IO
from ..types import Variable, wrapping_add
from .catalogue import CUSTOMERS_SQL, EDGES_SQL, ORDERS_SQL, POINTS_SQL, VERTICES_SQL, WIDTH, cents, customers, orders, points, query, read, trade
from .runplans import RunPlans
from .runs import Runs
from .world import checkpoint_root, StepLog, World

BIG = 2**53


# ---- round trips ------------------------------------------------------------------------


def state_model() -> Model:
    model = Model("stored")
    model.agent("customer").variable("idx", "int64").variable("bal").variable("pair", "int64", 2).state("poor").state("rich")
    model.environment.property("level", 2.5).property("shape", [3, 4], "int64").property("n", 7, "int64")
    model.environment.macro("held", "int64", (7, 3)).macro("share", "double", (4,))
    model.layer(Function("keep", "customer", initial="poor"))
    return model


def stored_world(spark, sf) -> World:
    world = World(spark, state_model(), seed=12, checkpoint_every=0)
    rows = customers(spark, sf).selectExpr("_id", "idx", "bal", "array(ix, iy) AS pair")
    world.set_population("customer", rows.where("bal < 0"), "poor")
    world.set_population("customer", rows.where("bal >= 0"), "rich")
    world.macros["held"] = spark.range(7).selectExpr("CAST(id AS INT) AS i", "1 AS j", "0 AS k", "0 AS w", f"{BIG} + id AS value")
    world.macros["share"] = spark.range(4).selectExpr("CAST(id AS INT) AS i", "0 AS j", "0 AS k", "0 AS w", "id / 8 AS value")
    world.env["level"] = 8.25
    return world


def document(ending: str) -> str:
    """A file of the driver: single documents are written and read there."""
    return os.path.join(tempfile.mkdtemp(prefix="swarmframe-"), f"document{ending}")


def round_trip(spark, sf, ending: str, parts=IO.PARTS) -> World:
    path = document(ending) if ending else f"{checkpoint_root(spark)}/state-{os.urandom(8).hex()}"
    IO.export_state(stored_world(spark, sf), path)
    return IO.import_state(World(spark, state_model(), checkpoint_every=0), path, parts)


STATE_SQL = f"SELECT _id, CASE WHEN bal < 0 THEN 'poor' ELSE 'rich' END AS state, idx, {cents('bal')} AS cents, ix AS first, iy AS second FROM ({CUSTOMERS_SQL})"


def stored_agents(world: World):
    return world.all_states("customer").selectExpr("_id", "_state AS state", "idx", f"{cents('bal')} AS cents", "pair[0] AS first", "pair[1] AS second")


@query("state_json", STATE_SQL)
def state_json(spark, sf):
    return stored_agents(round_trip(spark, sf, ".json"))


@query("state_xml", STATE_SQL)
def state_xml(spark, sf):
    return stored_agents(round_trip(spark, sf, ".xml"))


@query("state_parquet", STATE_SQL)
def state_parquet(spark, sf):
    return stored_agents(round_trip(spark, sf, ""))


@query("state_selective", "SELECT CAST(8250 AS BIGINT) AS level, CAST(7 AS BIGINT) AS n, CAST(0 AS BIGINT) AS agents, CAST(0 AS BIGINT) AS seed")
def state_selective(spark, sf):
    """Only the environment comes back."""
    world = round_trip(spark, sf, ".json", ("environment",))
    return world.all_states("customer").agg(F.count(F.lit(1)).alias("agents")).select(F.lit(round(world.get("level") * 1000)).cast("long").alias("level"), F.lit(world.get("n")).cast("long").alias("n"), "agents", F.lit(world.seed).cast("long").alias("seed"))


@query("state_config", "SELECT CAST(12 AS BIGINT) AS seed, CAST(3 AS BIGINT) AS shape0, CAST(4 AS BIGINT) AS shape1")
def state_config(spark, sf):
    world = round_trip(spark, sf, ".xml", ("config", "environment"))
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in (("seed", world.seed), ("shape0", world.get("shape")[0]), ("shape1", world.get("shape")[1]))])


def macro_trip(spark, sf, ending: str):
    one, two = stored_world(spark, sf), World(spark, state_model(), checkpoint_every=0)
    path = document(ending)
    IO.export_macro(one, "held", path)
    IO.import_macro(two, "held", path)
    return two.macros["held"].select("i", "j", "value")


MACRO_SQL = f"SELECT CAST(range AS INTEGER) AS i, 1 AS j, CAST({BIG} + range AS BIGINT) AS value FROM range(7)"


@query("macro_json", MACRO_SQL)
def macro_json(spark, sf):
    return macro_trip(spark, sf, ".json")


@query("macro_xml", MACRO_SQL)
def macro_xml(spark, sf):
    return macro_trip(spark, sf, ".xml")


@query("macro_bin", MACRO_SQL)
def macro_bin(spark, sf):
    return macro_trip(spark, sf, ".bin")


def graph_trip(spark, sf) -> Graph:
    path = f"{checkpoint_root(spark)}/graph-{os.urandom(8).hex()}.json"
    IO.export_graph(trade(spark, sf), path)
    return IO.import_graph(spark, path, {"tag": Variable("tag", "int64")}, {"weight": Variable("weight", "int64")})


@query("graph_json_nodes", VERTICES_SQL)
def graph_json_nodes(spark, sf):
    return graph_trip(spark, sf).vertices.select("id", "tag")


@query("graph_json_links", EDGES_SQL)
def graph_json_links(spark, sf):
    return graph_trip(spark, sf).edges.select("source", "dest", "weight")


def logged_world(spark, sf) -> World:
    model = Model("logged")
    model.agent("customer").variable("v", "int64")
    model.environment.property("level", 5, "int64")
    model.layer(Function("grow", "customer", set={"v": "v + env._step"}))
    world = World(spark, model, seed=9)
    world.set_population("customer", customers(spark, sf).selectExpr("_id", "idx AS v"))
    what = StepLog({("customer", "default"): [R.Reduce("sum", "v"), R.Reduce("min", "v"), R.Reduce("max", "v"), R.Reduce("mean", "v"), R.Reduce("standard_deviation", "v")]}, ["level"])
    return world.simulate(3, what, what)


LOG_SQL = f"SELECT CAST(range AS BIGINT) AS step, (SELECT count(*) FROM ({CUSTOMERS_SQL})) AS n, ((SELECT sum(idx) FROM ({CUSTOMERS_SQL})) + (range * (range - 1)) // 2 * (SELECT count(*) FROM ({CUSTOMERS_SQL})))::BIGINT AS total, CAST(5 AS BIGINT) AS level FROM range(4)"


@query("log_json", LOG_SQL)
def log_json(spark, sf):
    path = document(".json")
    IO.export_log(logged_world(spark, sf), path)
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["steps"]
    return spark.createDataFrame([(r["step"], r["customer.default.count"], r["customer.default.sum_v"], r["level"]) for r in rows], "step long, n long, total long, level long")


@query("log_xml", LOG_SQL)
def log_xml(spark, sf):
    import xml.etree.ElementTree as ET

    path = document(".xml")
    IO.export_log(logged_world(spark, sf), path)
    rows = [{v.get("name"): v.text for v in step} for step in ET.parse(path).getroot().findall("step")]
    return spark.createDataFrame([tuple(int(r[k]) for k in ("step", "customer.default.count", "customer.default.sum_v", "level")) for r in rows], "step long, n long, total long, level long")


@query("log_exit", f"SELECT name, CAST(round(value * 1000) AS BIGINT) AS thousandths FROM (SELECT 'customer.default.count' AS name, count(*)::DOUBLE AS value FROM ({CUSTOMERS_SQL}) UNION ALL SELECT 'customer.default.min_v', min(idx) + 3 FROM ({CUSTOMERS_SQL}) UNION ALL SELECT 'customer.default.max_v', max(idx) + 3 FROM ({CUSTOMERS_SQL}) UNION ALL SELECT 'customer.default.mean_v', avg(idx) + 3 FROM ({CUSTOMERS_SQL}) UNION ALL SELECT 'customer.default.standard_deviation_v', stddev_pop(idx) FROM ({CUSTOMERS_SQL}))")
def log_exit(spark, sf):
    """The exit row as (name, value)."""
    rows = IO.log_frame(spark, [logged_world(spark, sf).exit_log])
    return rows.where("name LIKE 'customer.%' AND name NOT LIKE '%.sum_v'").select("name", F.round(F.col("value") * 1000).cast("long").alias("thousandths"))


# ---- ids -----------------------------------------------------------------------------------


@query("id_after_death", f"SELECT m + row_number() OVER (ORDER BY _id) AS _id, _id AS parent FROM ({ORDERS_SQL}), (SELECT max(_id) AS m FROM ({ORDERS_SQL})) WHERE _id <= m // 2")
def id_after_death(spark, sf):
    """The upper half dies in one step, the lower half has children in the next: no id is given twice."""
    rows = orders(spark, sf).select("_id")
    most = rows.agg(F.max("_id")).first()[0]
    model = Model("lines")
    model.agent("order").variable("parent", "int64").variable("age", "int64")
    model.environment.property("half", most // 2, "int64")
    model.layer(Function("die", "order", alive="_id <= env.half OR age = 1", allow_death=True))
    model.layer(Function("age", "order", birth=Birth("order", {"parent": "_id", "age": "1"}, when="age = 0 AND env._step = 1")))
    world = World(spark, model, checkpoint_every=0)
    world.set_population("order", rows)
    world.step()
    world.step()
    return world.population("order").where("parent > 0").select("_id", "parent")


@query("vector_operations", "SELECT CAST(range AS BIGINT) AS position, CAST(CASE WHEN range < 2 THEN 10 * (range + 1) WHEN range = 2 THEN 7 ELSE 10 * range END AS BIGINT) AS v FROM range(6)")
def vector_operations(spark, sf):
    """A driver-side vector: push back, insert in the middle, pop."""
    own = V.AgentVector([Variable("v", "int64")])
    for k in range(6):
        own.push_back({"v": 10 * (k + 1)})
    own.pop_back()
    own.insert(2, {"v": 7})
    return spark.createDataFrame([(k, r["v"]) for k, r in enumerate(own)], "position long, v long")


# ---- grids, one and three axes ----------------------------------------------------------


@query("array1d_at", f"SELECT a._id, coalesce(m.nation, 0) AS nation FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON m.idx = a.idx + 5")
def array1d_at(spark, sf):
    model = Model("line")
    model.agent("customer").variable("idx", "int64").variable("nation", "int64").variable("seen", "int64")
    rows = customers(spark, sf).select("_id", "idx", "nation")
    model.message("cell", shape="grid", size=(rows.count(),)).variable("nation", "int64")
    model.layer(Function("show", "customer", emit=Emit("cell", {"_ix": "idx", "nation": "nation"})))
    model.layer(Function("look", "customer", read=Read("cell", {"got": "m.nation"}, at=("idx + 5",)), set={"seen": "got"}))
    world = World(spark, model, checkpoint_every=0)
    world.set_population("customer", rows)
    world.step()
    return world.population("customer").selectExpr("_id", "seen AS nation")


@query("array3d_at", f"SELECT a._id, coalesce(m.nation, 0) AS nation FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON m.idx % 5 = (a.idx + 1) % 5 AND (m.idx // 5) % 6 = (a.idx // 5) % 6 AND m.idx // {WIDTH} = a.idx // {WIDTH} + 1")
def array3d_at(spark, sf):
    rows = customers(spark, sf).selectExpr("_id", "idx", "nation", "idx % 5 AS jx", "(idx div 5) % 6 AS jy", f"idx div {WIDTH} AS jz")
    return S.read_at(rows.select("_id", "idx", "jx", "jy", "jz"), rows, ["jx", "jy", "jz"], ["(idx + 1) % 5", "jy", "jz + 1"], {"nation": "nation"}).select("_id", "nation")


# ---- typed macro properties through a world ---------------------------------------------


def macro_world(spark, sf, kind: str, update: MacroUpdate, start: int = 0) -> World:
    model = Model("shared")
    model.agent("order").variable("cust", "int64").variable("price").variable("old", "int64", default=-1)
    model.environment.macro("cells", kind, (7,))
    model.layer(Function("send", "order", macro=update))
    world = World(spark, model, checkpoint_every=0)
    world.set_population("order", orders(spark, sf))
    if start:
        world.macros["cells"] = spark.range(7).selectExpr("CAST(id AS INT) AS i", "0 AS j", "0 AS k", "0 AS w", f"CAST({start} AS BIGINT) AS value")
    world.step()
    return world


def cells_sql(value: str) -> str:
    return f"SELECT CAST(cust % 7 AS INTEGER) AS i, ({value})::BIGINT AS value FROM ({ORDERS_SQL}) GROUP BY 1"


@query("macro_int64", cells_sql(f"{BIG} + sum(_id)"))
def macro_int64(spark, sf):
    """Beyond what a double holds."""
    return macro_world(spark, sf, "int64", MacroUpdate("cells", "add", {"i": "cust % 7"}, "_id"), BIG).macros["cells"].select("i", "value")


@query("macro_increment", cells_sql(f"({2**32 - 3} + count(*)) % {2**32}"))
def macro_increment(spark, sf):
    return macro_world(spark, sf, "uint32", MacroUpdate("cells", "increment", {"i": "cust % 7"}), 2**32 - 3).macros["cells"].select("i", "value")


@query("macro_decrement", cells_sql(f"({2**32 + 2} - count(*)) % {2**32}"))
def macro_decrement(spark, sf):
    return macro_world(spark, sf, "uint32", MacroUpdate("cells", "decrement", {"i": "cust % 7"}), 2).macros["cells"].select("i", "value")


def found_sql(value: str) -> str:
    return f"SELECT _id, ({value})::BIGINT AS old FROM ({ORDERS_SQL})"


@query("macro_add_old", found_sql("coalesce(sum(cust) OVER (PARTITION BY cust % 7 ORDER BY _id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
def macro_add_old(spark, sf):
    return macro_world(spark, sf, "int64", MacroUpdate("cells", "add", {"i": "cust % 7"}, "cust", result="old")).population("order").select("_id", "old")


@query("macro_exchange_old", found_sql("coalesce(lag(cust) OVER (PARTITION BY cust % 7 ORDER BY _id), 0)"))
def macro_exchange_old(spark, sf):
    return macro_world(spark, sf, "int64", MacroUpdate("cells", "exchange", {"i": "cust % 7"}, "cust", result="old")).population("order").select("_id", "old")


SWAP_SQL = f"SELECT *, min(_id) FILTER (WHERE _id % 2 = 0) OVER (PARTITION BY cust % 7) AS won FROM ({ORDERS_SQL})"


@query("macro_swap_old", f"SELECT _id, CASE WHEN _id % 2 = 0 AND _id <> won THEN won + 100 ELSE 0 END::BIGINT AS old FROM ({SWAP_SQL})")
def macro_swap_old(spark, sf):
    """Agents of even id expect 0: one of each cell wins, the others find its value; the rest expect 1."""
    u = MacroUpdate("cells", "swap", {"i": "cust % 7"}, "_id + 100", expected="_id % 2", result="old")
    return macro_world(spark, sf, "int64", u).population("order").select("_id", "old")


@query("macro_swap", f"SELECT CAST(cust % 7 AS INTEGER) AS i, max(won + 100) AS value FROM ({SWAP_SQL}) GROUP BY 1")
def macro_swap(spark, sf):
    return macro_world(spark, sf, "int64", MacroUpdate("cells", "swap", {"i": "cust % 7"}, "_id + 100", expected="_id % 2")).macros["cells"].select("i", "value")


# ---- host functions, control flow, properties ---------------------------------------------


@query("host_functions", f"SELECT CAST(1000 + 3 * (SELECT count(*) FROM ({CUSTOMERS_SQL})) + 3 AS BIGINT) AS level, CAST(3 AS BIGINT) AS steps, CAST(77 AS BIGINT) AS left_at, CAST(2 AS BIGINT) AS old")
def host_functions(spark, sf):
    """Init, step, host-layer and exit functions; set gives the old value; a step counter."""
    model = Model("hosts")
    model.agent("customer").variable("v", "int64")
    model.environment.property("level", 0, "int64").property("left", 0, "int64").property("old", 0, "int64").property("mark", 2, "int64")
    model.init.append(lambda w: w.set("level", 1000))
    model.step.append(lambda w: w.set("level", w.get("level") + w.count("customer")))
    model.layer(Function("see", "customer", set={"v": "env._step"}))
    model.layer(host=lambda w: w.set("level", w.get("level") + 1))
    model.exit.append(lambda w: (w.set("left", 77), w.set("old", w.set("mark", 9))))
    world = World(spark, model)
    world.set_population("customer", customers(spark, sf).select("_id"))
    world.simulate(3)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in (("level", world.get("level")), ("steps", world.step_count), ("left_at", world.get("left")), ("old", world.get("old")))])


@query("step_counter", f"SELECT _id, CAST(3 AS BIGINT) AS v FROM ({CUSTOMERS_SQL})")
def step_counter(spark, sf):
    """0 + 1 + 2 over three steps."""
    model = Model("steps")
    model.agent("customer").variable("v", "int64")
    model.layer(Function("add", "customer", set={"v": "v + env._step"}))
    world = World(spark, model)
    world.set_population("customer", customers(spark, sf).select("_id"))
    return world.simulate(3).population("customer").select("_id", "v")


@query("sum_unsigned", f"SELECT sum(cust)::BIGINT AS total FROM ({ORDERS_SQL})")
def sum_unsigned(spark, sf):
    """An unsigned 64-bit variable."""
    rows = orders(spark, sf).select("_id", F.col("cust").cast(Variable("cust", "uint64").spark_type).alias("cust"))
    return R.reduce_frame(rows, R.Reduce("sum", "cust")).select(F.col("sum_cust").cast("long").alias("total"))


@query("wrapping_counter", f"SELECT _id, (cust + 4294967290) % 4294967296 AS v FROM ({ORDERS_SQL})")
def wrapping_counter(spark, sf):
    return orders(spark, sf).select("_id", wrapping_add("cust", F.lit(4294967290)).alias("v"))


@query("spatial_bounds", "SELECT CAST(10 AS BIGINT) AS cells_x, CAST(10 AS BIGINT) AS cells_y, CAST(1000 AS BIGINT) AS radius")
def spatial_bounds(spark, sf):
    space = S.Space((-5.0, -5.0), (5.0, 5.0), 1.0)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in (("cells_x", space.cells[0]), ("cells_y", space.cells[1]), ("radius", space.radius * 1000))])


@query("virtual_xyz", f"SELECT _id, CAST(round(1e6 * CASE WHEN abs(z - x) > 5 THEN z - sign(z - x) * 10 ELSE z END) AS BIGINT) AS image FROM ({POINTS_SQL})")
def virtual_xyz(spark, sf):
    space = S.Space((-5.0, -5.0, -5.0), (5.0, 5.0, 5.0), 2.0)
    return points(spark, sf).select("_id", F.round(S.virtual(space, 2, "x", "z") * 1e6).cast("long").alias("image"))


@query("brute_pairs", f"SELECT a._id, count(m._id) AS above FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON m.bal > a.bal + 9000 GROUP BY a._id")
def brute_pairs(spark, sf):
    """A condition without any equality: blocks of readers against blocks of messages."""
    rows = customers(spark, sf).select("_id", "bal")
    return S.read_all(rows, rows, {"above": "count(m._id)"}, "m.bal > a.bal + 9000").select("_id", "above")


@query("bucket_range_hot", f"SELECT a._id, count(m._id) AS n FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({ORDERS_SQL}) m ON m.cust % 5 >= a.idx % 5 AND m.cust % 5 < a.idx % 5 + 2 AND m.price > 100 * a.bal GROUP BY a._id")
def bucket_range_hot(spark, sf):
    """Few keys, each with a large share of the messages, dealt into parts."""
    return S.read_bucket_range(customers(spark, sf).select("_id", "idx", "bal"), orders(spark, sf).withColumn("key", F.expr("cust % 5")), "idx % 5", "idx % 5 + 2", "key", {"n": "count(m._id)"}, "m.price > 100 * a.bal", parts=4).select("_id", "n")


# ---- graphs --------------------------------------------------------------------------------


@query("graph_faults", "SELECT * FROM (VALUES ('vertex id unset', 0, NULL), ('vertex id repeated', 4, NULL), ('edge without source', 9, 2), ('edge without target', 2, 8), ('edge repeated', 2, 3)) t(fault, id, other)")
def graph_faults(spark, sf):
    vertices = read(spark, sf, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id").unionByName(spark.createDataFrame([(4,)], "id long"))
    edges = spark.createDataFrame([(9, 2), (2, 8), (2, 3), (2, 3), (3, 4)], "source long, dest long")
    return Graph(vertices, edges).faults().select("fault", F.col("id").cast("int").alias("id"), F.col("other").cast("int").alias("other"))


@query("graph_upsert_edges", f"SELECT source, dest, CASE WHEN source <= 3 THEN -5 ELSE weight END::BIGINT AS weight FROM ({EDGES_SQL}) UNION ALL SELECT CAST(1 AS BIGINT), CAST(7 AS BIGINT), CAST(9 AS BIGINT)")
def graph_upsert_edges(spark, sf):
    """Edges by their ends; of a repeated one the row that sorts last stays."""
    g = trade(spark, sf)
    new = g.edges.where("source <= 3").select("source", "dest", F.lit(-5).cast("long").alias("weight"))
    twice = spark.createDataFrame([(1, 7, 8), (1, 7, 9)], "source long, dest long, weight long")
    return g.upsert_edges(new.unionByName(twice)).edges.select("source", "dest", "weight")


@query("graph_resize", "SELECT CAST(4 AS BIGINT) AS vertices, CAST(2 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS tags")
def graph_resize(spark, sf):
    g = trade(spark, sf).resized(4, 2)
    v, e = g.counts()
    return g.vertices.agg(F.sum("tag").cast("long").alias("tags")).select(F.lit(v).cast("long").alias("vertices"), F.lit(e).cast("long").alias("edges"), "tags")


# ---- translated code -----------------------------------------------------------------------


@query("translate_while", f"SELECT _id, CAST(floor(log2(cust + 1)) + 1 AS BIGINT) AS bits, CAST(bit_count(cust + 1) AS BIGINT) AS ones FROM ({ORDERS_SQL})")
def translate_while(spark, sf):
    bits = "def bits(cust):\n    n = cust + 1\n    k = 0\n    while n > 0:\n        n = n >> 1\n        k += 1\n    return k"
    ones = "def ones(cust):\n    n = cust + 1\n    k = 0\n    while n > 0:\n        k = k + (n & 1)\n        n = n // 2\n    return k"
    return orders(spark, sf).select("_id", translate(bits).cast("long").alias("bits"), translate(ones).cast("long").alias("ones"))


@query("translate_math", f"SELECT _id, CAST(round(1e6 * (sin(cust) + cos(cust) + sqrt(price) + exp(-cust / 1000.0) + ln(price + 1) + atan2(cust, 3) + tanh(cust / 100.0) + pow(cust, 0.25) + abs(cust - 50) + floor(price / 7) + ceil(price / 3))) AS BIGINT) AS v FROM ({ORDERS_SQL})")
def translate_math(spark, sf):
    # one sum from left to right, as in the SQL: sums of doubles in another order may end in another digit
    source = """
    def f(cust, price):
        a = math.sin(cust) + math.cos(cust) + math.sqrt(price) + math.exp(-cust / 1000.0) + math.log(price + 1)
        b = a + math.atan2(cust, 3) + math.tanh(cust / 100.0) + math.pow(cust, 0.25)
        return 1e6 * (b + math.fabs(cust - 50) + math.floor(price / 7) + math.ceil(price / 3))
    """
    return orders(spark, sf).select("_id", F.round(translate(source)).cast("long").alias("v"))


@query("translate_bits", f"SELECT _id, ((cust & 12) | (xor(cust, 5) << 2)) + (cust >> 1) - (~cust) AS v FROM ({ORDERS_SQL})")
def translate_bits(spark, sf):
    return orders(spark, sf).select("_id", translate("def f(cust):\n    return ((cust & 12) | ((cust ^ 5) << 2)) + (cust >> 1) - (~cust)").alias("v"))


@query("translate_helper", f"SELECT _id, 2 * (cust + 1) * (cust + 1) AS v FROM ({ORDERS_SQL})")
def translate_helper(spark, sf):
    return orders(spark, sf).select("_id", translate("def f(cust):\n    return 2 * square(cust + 1)", {"square": "def square(x):\n    return x * x"}).alias("v"))


@query("floor_divide", f"SELECT _id, CAST(floor((cust - 700) / 7.0) AS BIGINT) AS q, CAST(pow(cust % 10, 3) AS BIGINT) AS p FROM ({ORDERS_SQL})")
def floor_divide(spark, sf):
    return orders(spark, sf).select("_id", translate("def f(cust):\n    return (cust - 700) // 7").cast("long").alias("q"), translate("def g(cust):\n    return (cust % 10) ** 3").cast("long").alias("p"))


# ---- models ---------------------------------------------------------------------------------

CIRCLE = "sqrt((m.x - a.x) * (m.x - a.x) + (m.y - a.y) * (m.y - a.y) + (m.z - a.z) * (m.z - a.z))"


def circle_force(axis: str) -> str:
    """The push along an axis: towards or away from each neighbour within the radius, as a sine of the distance."""
    return f"CASE WHEN {CIRCLE} > 0 AND {CIRCLE} < 2 THEN sin({CIRCLE} * {math.pi!r} * -2 / 2) * 0.05 * (m.{axis} - a.{axis}) / {CIRCLE} ELSE 0 END"


@query("circles_model", f"SELECT a._id, " + ", ".join(f"CAST(round(1e6 * (a.{c} + sum({circle_force(c)}) / greatest(1, count(*) FILTER (WHERE {CIRCLE} > 0 AND {CIRCLE} < 2)))) AS BIGINT) AS {c}" for c in "xyz") + f" FROM ({POINTS_SQL}) a, ({POINTS_SQL}) m GROUP BY a._id, a.x, a.y, a.z")
def circles_model(spark, sf):
    """Agents in space push and pull each other along the line between them, on all three axes."""
    model = Model("circles")
    model.agent("circle").variable("x").variable("y").variable("z")
    model.message("at", shape="space", space=S.Space((-5.0, -5.0, -5.0), (5.0, 5.0, 5.0), 2.0))
    model.layer(Function("show", "circle", emit=Emit("at", {c: c for c in "xyz"})))
    fold = {f"f{c}": f"sum({circle_force(c)})" for c in "xyz"} | {"near": f"count(CASE WHEN {CIRCLE} > 0 AND {CIRCLE} < 2 THEN 1 END)"}
    model.layer(Function("move", "circle", read=Read("at", fold, defaults={f"f{c}": 0.0 for c in "xyz"}), set={c: f"{c} + f{c} / greatest(1, near)" for c in "xyz"}))
    world = World(spark, model, checkpoint_every=0)
    world.set_population("circle", points(spark, sf).select("_id", "x", "y", "z"))
    world.step()
    return world.population("circle").select("_id", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in "xyz"])


# Flocks: how much a boid turns to the middle, the mean velocity and away from those too near; its steps.
FLOCK = {"steer": 0.05, "match": 0.02, "part": 10.0, "change": 0.15, "pace": 0.005, "near": 0.5}
FLOCK_SQL = "SELECT _id, x, y, z, y AS fx, z AS fy, x AS fz FROM ({})"


def flock_sql() -> str:
    c = FLOCK
    met = ", ".join(f"sum(m.{v}) AS c{v}, sum(m.f{v}) AS v{v}, sum(CASE WHEN {CIRCLE} < {c['near']} THEN (a.{v} - m.{v}) * pow(1 - {CIRCLE} / {c['near']}, 2) ELSE 0 END) AS p{v}" for v in "xyz")
    turned = ", ".join(f"b.f{v} + {c['change']} * coalesce({c['part']} * p{v} + (c{v} / n - b.{v}) * {c['steer']} + v{v} / n * {c['match']} - b.f{v}, 0) AS f{v}" for v in "xyz")
    paced = ", ".join(f"f{v} * CASE WHEN s > 1 THEN 1 / s WHEN s > 0 AND s < 0.5 THEN 0.5 / s ELSE 1 END AS f{v}" for v in "xyz")
    moved = ", ".join(f"CAST(round(1e6 * least(greatest({v} + {c['pace']} * f{v}, -5), 5)) AS BIGINT) AS {v}, CAST(round(1e6 * f{v}) AS BIGINT) AS f{v}" for v in "xyz")
    return (
        f"WITH b AS ({FLOCK_SQL.format(POINTS_SQL)}), met AS (SELECT a._id, count(*) AS n, {met} FROM b a JOIN b m ON m._id <> a._id AND {CIRCLE} < 2 GROUP BY a._id),"
        f" turned AS (SELECT b._id, b.x, b.y, b.z, {turned} FROM b LEFT JOIN met ON met._id = b._id), speed AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS s FROM turned),"
        f" paced AS (SELECT _id, x, y, z, {paced} FROM speed) SELECT _id, {moved} FROM paced"
    )


@query("boids_model", flock_sql())
def boids_model(spark, sf):
    """Boids in space: cohesion, alignment and separation from one read, bounded speeds, a step within the box."""
    model = Model("boids")
    agent, message = model.agent("boid"), model.message("seen", shape="space", space=S.Space((-5.0, -5.0, -5.0), (5.0, 5.0, 5.0), 2.0))
    for v in ("x", "y", "z", "fx", "fy", "fz"):
        agent.variable(v)
    agent.variable("speed")
    message.variable("id", "int64").variable("fx").variable("fy").variable("fz")
    for name, value in FLOCK.items():
        model.environment.property(name, value)
    fold = {"n": "count(m.id)"}
    for v in "xyz":
        fold |= {f"c{v}": f"sum(m.{v})", f"v{v}": f"sum(m.f{v})", f"p{v}": f"sum(CASE WHEN {CIRCLE} < env.near THEN (a.{v} - m.{v}) * pow(1 - {CIRCLE} / env.near, 2) ELSE 0 END)"}
    turn = {f"f{v}": f"f{v} + env.change * coalesce(env.part * p{v} + (c{v} / nullif(n, 0) - {v}) * env.steer + v{v} / nullif(n, 0) * env.match - f{v}, 0)" for v in "xyz"}
    pace = {f"f{v}": f"f{v} * CASE WHEN speed > 1 THEN 1 / speed WHEN speed > 0 AND speed < 0.5 THEN 0.5 / speed ELSE 1 END" for v in "xyz"}
    step = {v: f"least(greatest({v} + env.pace * f{v}, -5), 5)" for v in "xyz"}
    model.layer(Function("show", "boid", emit=Emit("seen", {v: v for v in ("x", "y", "z", "fx", "fy", "fz")} | {"id": "_id"})))
    model.layer(Function("turn", "boid", read=Read("seen", fold, where=f"m.id <> a._id AND {CIRCLE} < 2"), set=turn | {"speed": "sqrt(fx * fx + fy * fy + fz * fz)"}))
    model.layer(Function("move", "boid", set=pace | step))
    world = World(spark, model, checkpoint_every=0)
    world.set_population("boid", points(spark, sf).selectExpr("_id", "x", "y", "z", "y AS fx", "z AS fy", "x AS fz"))
    world.step()
    return world.population("boid").select("_id", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("x", "y", "z", "fx", "fy", "fz")])


# Cells of a sugar field: status 0 is free, 1 settled, 2 wants to move; an occupied cell has level -1.
SUGAR_ROUNDS = 9
FIELD = {
    "ix": "ix", "iy": "iy", "status": "CAST(alive AS BIGINT)", "who": "CASE WHEN alive = 1 THEN idx ELSE -1 END", "wealth": "CASE WHEN alive = 1 THEN 1 + idx % 4 ELSE 0 END",
    "rate": "CASE WHEN alive = 1 THEN 1 + idx % 3 ELSE 0 END", "level": "CASE WHEN alive = 1 THEN idx % 3 ELSE idx % 2 END", "top": "1 + nation % 4",
}
LIVE = {
    "wealth": "CASE WHEN status > 0 THEN greatest(0, wealth + greatest(level, 0) - rate) ELSE 0 END",
    "level": "CASE WHEN status > 0 AND wealth > 0 THEN -1 WHEN status > 0 THEN least(top, 1) ELSE least(top, level + 1) END",
    "who": "CASE WHEN wealth > 0 THEN who ELSE -1 END",
    "rate": "CASE WHEN wealth > 0 THEN rate ELSE 0 END",
    "status": "CASE WHEN wealth > 0 THEN 2 ELSE 0 END",
}


def sugar_sql() -> str:
    """One step: cells live in turn of ``LIVE``, then rounds of requests, written out."""
    tables = [f"f AS MATERIALIZED (SELECT _id, {', '.join(f'{e} AS {n}' for n, e in FIELD.items())} FROM ({CUSTOMERS_SQL}))"]
    tables.append(f"nb AS MATERIALIZED (SELECT a._id AS a, b._id AS b FROM f a, range(-1, 2) x(dx), range(-1, 2) y(dy), f b WHERE (dx <> 0 OR dy <> 0) AND b.ix = (a.ix + dx + {WIDTH}) % {WIDTH} AND b.iy = (a.iy + dy + (SELECT max(iy) + 1 FROM f)) % (SELECT max(iy) + 1 FROM f))")
    last = "f"
    for k, (name, e) in enumerate(LIVE.items()):
        tables.append(f"l{k} AS (SELECT * REPLACE ({e} AS {name}) FROM {last})")
        last = f"l{k}"
    for k in range(SUGAR_ROUNDS):
        tables.append(f"ask{k} AS MATERIALIZED (SELECT a._id AS src, arg_max(m._id, m.level * 1000000000 + m._id) AS target, any_value(a.who) AS who, any_value(a.wealth) AS wealth, any_value(a.rate) AS rate FROM nb JOIN {last} a ON a._id = nb.a JOIN {last} m ON m._id = nb.b WHERE a.status = 2 AND m.status = 0 GROUP BY 1)")
        tables.append(f"win{k} AS MATERIALIZED (SELECT target, max(who) AS who, arg_max(src, who) AS src, arg_max(wealth, who) AS wealth, arg_max(rate, who) AS rate FROM ask{k} GROUP BY 1)")
        new = lambda c, won, left: f"CASE WHEN w.target IS NOT NULL THEN {won} WHEN l.src IS NOT NULL THEN {left} ELSE s.{c} END AS {c}"
        tables.append(
            f"s{k} AS MATERIALIZED (SELECT s._id, s.ix, s.iy, s.top, CASE WHEN w.target IS NOT NULL THEN 1 WHEN l.src IS NOT NULL THEN 0 WHEN s.status = 2 AND q.src IS NULL THEN 1 ELSE s.status END AS status,"
            f" {new('who', 'w.who', '-1')}, {new('wealth', 'w.wealth + s.level', '0')}, {new('rate', 'w.rate', '0')}, {new('level', '-1', '0')}"
            f" FROM {last} s LEFT JOIN win{k} w ON w.target = s._id LEFT JOIN win{k} l ON l.src = s._id LEFT JOIN ask{k} q ON q.src = s._id)"
        )
        last = f"s{k}"
    return f"WITH {', '.join(tables)} SELECT _id, status::BIGINT AS status, who::BIGINT AS who, wealth::BIGINT AS wealth, level::BIGINT AS level FROM {last}"


def moving_model(size: tuple[int, int]) -> Model:
    """Rounds of movement: show cells, ask the best free neighbour, free cells take one, leave where taken."""
    model = Model("moving")
    cell = model.agent("cell")
    for v in [*FIELD, "target"]:
        cell.variable(v, "int64")
    for name, variables in (("shown", ("id", "status", "level")), ("asked", ("target", "who", "wealth", "rate")), ("taken", ("who",))):
        message = model.message(name, shape="grid", size=size)
        for v in variables:
            message.variable(v, "int64")
    at = {"_ix": "ix", "_iy": "iy"}
    near = {"at": ("ix", "iy"), "wrap": True}
    model.layer(Function("show", "cell", emit=Emit("shown", at | {"id": "_id", "status": "status", "level": "level"})))
    model.layer(Function(
        "ask", "cell", condition="status = 2", read=Read("shown", {"best": "max_by(m.id, struct(m.level, m.id))"}, where="m.status = 0", **near),
        set={"target": "coalesce(best, 0)", "status": "CASE WHEN best IS NULL THEN 1 ELSE 2 END"}, emit=Emit("asked", at | {v: v for v in ("target", "who", "wealth", "rate")}, when="status = 2"),
    ))
    model.layer(Function(
        "take", "cell", condition="status = 0", read=Read("asked", {"won": "max(struct(m.who AS who, m.wealth AS wealth, m.rate AS rate))"}, where="m.target = a._id", **near),
        set={"who": "coalesce(won.who, -1)", "wealth": "coalesce(won.wealth + level, 0)", "rate": "coalesce(won.rate, 0)", "status": "CASE WHEN won.who IS NULL THEN 0 ELSE 1 END", "level": "CASE WHEN won.who IS NULL THEN level ELSE -1 END"},
        emit=Emit("taken", at | {"who": "who"}, when="status = 1"),
    ))
    gone = {"who": -1, "wealth": 0, "rate": 0, "level": 0, "status": 0}
    model.layer(Function("leave", "cell", condition="status = 2", read=Read("taken", {"found": "count(m.who)"}, where="m.who = a.who", **near), set={v: f"CASE WHEN found > 0 THEN {x} ELSE {v} END" for v, x in gone.items()}))
    model.exit_conditions.append(lambda w: w.step_count >= SUGAR_ROUNDS or w.population("cell").where("status = 2").isEmpty())
    return model


@query("sugarscape_model", sugar_sql())
def sugarscape_model(spark, sf):
    """A step of a sugar field: agents eat, starve or live, sugar grows back; then a submodel moves them until all are settled."""
    rows = customers(spark, sf).selectExpr("_id", *[f"CAST({e} AS BIGINT) AS {n}" for n, e in FIELD.items()])
    high = rows.agg(F.max("iy")).first()[0] + 1
    model, inner = Model("sugar"), moving_model((WIDTH, high))
    cell = model.agent("cell")
    for v in FIELD:
        cell.variable(v, "int64")
    model.layer(Function("live", "cell", set=LIVE))
    model.layer(submodel=model.submodel("moves", inner, agents={"cell": "cell"}, variables={"cell": {v: v for v in FIELD}}))
    world = World(spark, model)
    world.set_population("cell", rows)
    world.step()
    return world.population("cell").select("_id", "status", "who", "wealth", "level")


# ---- many runs ------------------------------------------------------------------------------


@query("ensemble_worlds", f"SELECT p.range AS run_id, sum(idx + (1 + p.range % 2) * n * (3 + 4 * (p.range // 2)))::BIGINT AS total FROM (SELECT *, count(*) OVER (PARTITION BY idx % 10) AS n FROM ({CUSTOMERS_SQL})), range(6) p GROUP BY 1")
def ensemble_worlds(spark, sf):
    """Six runs of one or two steps as one world: every agent counts those of its key, and the exit log sums each run."""
    model = Model("sweep")
    model.agent("c").variable("idx", "int64").variable("v", "int64")
    model.environment.property("b", 1, "int64")
    model.message("here", shape="bucket", bounds=(0, 9)).variable("v", "int64")
    model.layer(Function("show", "c", emit=Emit("here", {"_key": "idx % 10", "v": "v"})))
    model.layer(Function("take", "c", read=Read("here", {"n": "count(1)"}, key="idx % 10", parts=0), set={"v": "v + n * env.b"}))
    plans = RunPlans(spark, model, 6)
    plans = RunPlans(spark, model, 6, plans.frame.selectExpr("run_id", "1 + run_id % 2 AS steps", "seed", "folder", "3 + 4 * (run_id DIV 2) AS b"))
    runs = Runs(spark, model, plans)
    runs.set_population("c", customers(spark, sf).selectExpr("_id", "idx", "idx AS v"))
    runs.simulate(exit_log=StepLog({("c", "default"): [R.Reduce("sum", "v")]}))
    return runs.log_frame().where("name = 'c.default.sum_v'").selectExpr("run_id", "CAST(value AS BIGINT) AS total")
