"""Queries over the test tables, one for each operator, and their SQL.

Populations are derived from keys that are unique and contiguous, so SQL can
restate them: ids are keys plus 1, as id 0 means unset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.translate import translate
from ..model import Birth, Emit, Function, MacroUpdate, Model, Read, SubModel
from ..operators import macros as M
from ..operators import population as P
from ..operators import reductions as R
from ..operators import shapes as S
from ..operators.graphs import Graph
from ..types import Variable, set_element
from .dag import DependencyGraph, Node
from .runplans import RunPlans
from .world import StepLog, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- populations, in both languages -------------------------------------------------

WIDTH = 30
ORDERS_SQL = "SELECT o_orderkey + 1 AS _id, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status, CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders"
CUSTOMERS_SQL = f"SELECT c_custkey + 1 AS _id, c_custkey AS idx, c_custkey % {WIDTH} AS ix, c_custkey // {WIDTH} AS iy, c_acctbal AS bal, CAST(c_nationkey AS BIGINT) AS nation, CASE WHEN CAST(floor(c_acctbal) AS BIGINT) % 2 <> 0 THEN 1 ELSE 0 END AS alive FROM customer"
POINTS_SQL = "SELECT vec_id + 1 AS _id, 10 * embedding[1]::DOUBLE AS x, 10 * embedding[2]::DOUBLE AS y, 10 * embedding[3]::DOUBLE AS z, CAST(label AS BIGINT) AS label FROM embeddings"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").selectExpr("o_orderkey + 1 AS _id", "o_custkey AS cust", "o_totalprice AS price", "o_orderstatus AS status", "CAST(year(o_orderdate) AS BIGINT) AS yr")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").selectExpr("c_custkey + 1 AS _id", "c_custkey AS idx", f"c_custkey % {WIDTH} AS ix", f"c_custkey div {WIDTH} AS iy", "c_acctbal AS bal", "CAST(c_nationkey AS BIGINT) AS nation", "CASE WHEN CAST(floor(c_acctbal) AS BIGINT) % 2 <> 0 THEN 1 ELSE 0 END AS alive")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").selectExpr("vec_id + 1 AS _id", "10 * CAST(embedding[0] AS DOUBLE) AS x", "10 * CAST(embedding[1] AS DOUBLE) AS y", "10 * CAST(embedding[2] AS DOUBLE) AS z", "CAST(label AS BIGINT) AS label")


def height(spark: SparkSession, sf: str) -> int:
    return read(spark, sf, "customer").count() // WIDTH


def cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


# ---- rows ---------------------------------------------------------------------------


@query("set_variable", f"SELECT _id, {cents('price')} * 2 AS doubled, {cents('price')} * 2 + 1 AS after FROM ({ORDERS_SQL})")
def set_variable(spark, sf):
    out = P.set_variables(orders(spark, sf), {"doubled": f"{cents('price')} * 2", "after": "doubled + 1"})
    return out.select("_id", "doubled", "after")


@query("set_array_element", f"SELECT _id, CAST(_id AS BIGINT) AS v0, CAST(7 AS BIGINT) AS v1, CAST(cust AS BIGINT) AS v2 FROM ({ORDERS_SQL})")
def set_array_element(spark, sf):
    rows = orders(spark, sf).selectExpr("_id", "array(_id, yr, cust) AS v")
    return rows.select("_id", set_element(F.col("v"), 1, F.lit(7).cast("long")).alias("v")).selectExpr("_id", "v[0] AS v0", "v[1] AS v1", "v[2] AS v2")


@query("thread_index", f"SELECT _id, row_number() OVER (ORDER BY _id) - 1 AS position FROM ({ORDERS_SQL})")
def thread_index(spark, sf):
    return P.row_index(orders(spark, sf)).selectExpr("_id", "_index AS position")


def population_world(spark, sf, *functions: Function, states=("default",), **env) -> World:
    """A world of order agents for one-step queries."""
    model = Model("orders")
    agent = model.agent("order").variable("cust", "int64").variable("price").variable("mark", "int64")
    for s in states:
        agent.state(s)
    child = model.agent("child").variable("parent", "int64").variable("mark", "int64", default=5)
    assert child.has_variable("parent")
    for k, v in env.items():
        model.environment.property(k, v, "int64" if isinstance(v, int) else "double")
    for f in functions:
        model.layer(f)
    return World(spark, model, checkpoint_every=0)


@query("env_property", f"SELECT _id, CASE WHEN price > 100000.5 THEN 3 ELSE 0 END::BIGINT AS mark FROM ({ORDERS_SQL})")
def env_property(spark, sf):
    f = Function("mark", "order", set={"mark": "CASE WHEN price > env.level THEN env.value ELSE 0 END"})
    w = population_world(spark, sf, f, level=100000.5, value=3)
    w.set_population("order", orders(spark, sf))
    w.step()
    return w.population("order").select("_id", "mark")


@query("condition_split", f"SELECT _id, CASE WHEN price > 150000 THEN 1 ELSE 0 END::BIGINT AS mark FROM ({ORDERS_SQL})")
def condition_split(spark, sf):
    w = population_world(spark, sf, Function("mark", "order", condition="price > 150000", set={"mark": "1"}))
    w.set_population("order", orders(spark, sf))
    w.step()
    return w.population("order").select("_id", "mark")


@query("agent_death", f"SELECT _id FROM ({ORDERS_SQL}) WHERE status <> 'F'")
def agent_death(spark, sf):
    w = population_world(spark, sf, Function("age", "order", alive="mark <> 1", allow_death=True))
    w.set_population("order", orders(spark, sf).withColumn("mark", F.expr("CASE WHEN status = 'F' THEN 1 ELSE 0 END")))
    w.step()
    return w.population("order").select("_id")


@query("state_transition", f"SELECT _id, CASE WHEN price > 200000 THEN 'large' ELSE 'small' END AS state FROM ({ORDERS_SQL})")
def state_transition(spark, sf):
    f = Function("grow", "order", initial="small", end="large", condition="price > 200000")
    w = population_world(spark, sf, f, states=("small", "large"))
    w.set_population("order", orders(spark, sf), "small")
    w.step()
    return w.all_states("order").selectExpr("_id", "_state AS state")


@query("device_birth", f"SELECT row_number() OVER (ORDER BY _id) AS _id, _id AS parent, CAST(5 AS BIGINT) AS mark FROM ({ORDERS_SQL}) WHERE price > 200000")
def device_birth(spark, sf):
    f = Function("split", "order", birth=Birth("child", {"parent": "_id"}, when="price > 200000"))
    w = population_world(spark, sf, f)
    w.set_population("order", orders(spark, sf))
    w.step()
    return w.population("child").select("_id", "parent", "mark")


@query("host_birth", "SELECT CAST(range + 1 AS BIGINT) AS _id, CAST(10 * range AS BIGINT) AS parent, CAST(5 AS BIGINT) AS mark FROM range(6)")
def host_birth(spark, sf):
    w = population_world(spark, sf)
    w.new_agents("child", [{"parent": 10 * i} for i in range(6)])
    return w.population("child").select("_id", "parent", "mark")


@query("id_assignment", f"SELECT cust, price, CASE WHEN _id % 3 = 0 THEN (SELECT max(_id) FROM ({ORDERS_SQL}) WHERE _id % 3 <> 0) + row_number() OVER (PARTITION BY _id % 3 = 0 ORDER BY _id) ELSE _id END AS _id FROM ({ORDERS_SQL})")
def id_assignment(spark, sf):
    rows = orders(spark, sf).select("_id", "cust", "price").withColumn("k", F.col("_id")).withColumn("_id", F.expr("CASE WHEN _id % 3 = 0 THEN 0 ELSE _id END"))
    return P.assign_ids(rows, "k").select("cust", "price", "_id")


@query("id_collisions", f"SELECT cust + 1 AS _id, count(*) AS n FROM ({ORDERS_SQL}) GROUP BY 1 HAVING count(*) > 1")
def id_collisions(spark, sf):
    return P.id_collisions(orders(spark, sf).select((F.col("cust") + 1).alias("_id")))


@query("vector_edit", f"SELECT _id, {cents('price')} AS cents FROM ({ORDERS_SQL}) WHERE _id % 7 <> 0 UNION ALL SELECT -_id, CAST(0 AS BIGINT) FROM ({ORDERS_SQL}) WHERE _id % 7 = 0")
def vector_edit(spark, sf):
    """Erase and insert on a whole population."""
    rows = orders(spark, sf).selectExpr("_id", f"{cents('price')} AS cents")
    kept, gone = P.split(rows, "_id % 7 <> 0")
    return P.move(gone.selectExpr("-_id AS _id", "CAST(0 AS BIGINT) AS cents"), kept)


# ---- message reads --------------------------------------------------------------------


@query("no_messages", f"SELECT _id, idx + 1 AS next FROM ({CUSTOMERS_SQL})")
def no_messages(spark, sf):
    return P.set_variables(customers(spark, sf), {"next": "idx + 1"}).select("_id", "next")


@query("brute_global", f"SELECT c._id, (SELECT count(*) FROM orders) AS n, (SELECT sum({cents('o_totalprice')}) FROM orders)::BIGINT AS total FROM ({CUSTOMERS_SQL}) c")
def brute_global(spark, sf):
    return S.read_all(customers(spark, sf).select("_id"), orders(spark, sf), {"n": "count(1)", "total": f"sum({cents('m.price')})"})


@query("brute_theta", f"SELECT a._id, count(m._id) AS richer FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON m.bal > a.bal AND m.nation = a.nation AND m._id <> a._id GROUP BY a._id")
def brute_theta(spark, sf):
    rows = customers(spark, sf).select("_id", "bal", "nation")
    return S.read_all(rows, rows, {"richer": "count(m._id)"}, "m.bal > a.bal AND m.nation = a.nation AND m._id <> a._id").select("_id", "richer")


@query("bucket_single", f"SELECT a._id, count(m._id) AS n, coalesce(sum({cents('m.price')}), 0)::BIGINT AS total FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({ORDERS_SQL}) m ON m.cust = a.idx GROUP BY a._id")
def bucket_single(spark, sf):
    model = Model("accounts")
    model.agent("customer").variable("idx", "int64").variable("n", "int64").variable("total", "int64")
    model.agent("order").variable("cust", "int64").variable("price")
    model.message("paid", shape="bucket", bounds=(0, 2**40)).variable("order_id", "int64").variable("price")
    model.layer(Function("pay", "order", emit=Emit("paid", {"_key": "cust", "order_id": "_id", "price": "price"})))
    model.layer(Function("collect", "customer", read=Read("paid", {"got": "count(m.order_id)", "sum": f"sum({cents('m.price')})"}, key="idx", defaults={"sum": 0}), set={"n": "got", "total": "sum"}))
    w = World(spark, model, checkpoint_every=0)
    w.set_population("customer", customers(spark, sf).select("_id", "idx"))
    w.set_population("order", orders(spark, sf))
    w.step()
    return w.population("customer").select("_id", "n", "total")


@query("bucket_theta", f"SELECT a._id, count(m._id) AS n FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({ORDERS_SQL}) m ON m.cust = a.idx AND m.price > 10 * a.bal GROUP BY a._id")
def bucket_theta(spark, sf):
    return S.read_bucket(customers(spark, sf).select("_id", "idx", "bal"), orders(spark, sf), "idx", "cust", {"n": "count(m._id)"}, "m.price > 10 * a.bal").select("_id", "n")


@query("bucket_range", f"SELECT a._id, count(m._id) AS n FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({ORDERS_SQL}) m ON m.cust >= a.idx AND m.cust < a.idx + 4 GROUP BY a._id")
def bucket_range(spark, sf):
    return S.read_bucket_range(customers(spark, sf).select("_id", "idx"), orders(spark, sf), "idx", "idx + 4", "cust", {"n": "count(m._id)"}).select("_id", "n")


@query("bucket_optional", f"SELECT a._id, count(m._id) AS n FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({ORDERS_SQL}) m ON m.cust = a.idx AND m.price > 100000 GROUP BY a._id")
def bucket_optional(spark, sf):
    sent = P.split(orders(spark, sf), "price > 100000")[0]
    return S.read_bucket(customers(spark, sf).select("_id", "idx"), sent, "idx", "cust", {"n": "count(m._id)"}).select("_id", "n")


def two_writers(spark, sf, persistent: bool, steps: int) -> DataFrame:
    model = Model("writers")
    model.agent("customer").variable("n", "int64")
    model.agent("order").variable("price")
    model.message("seen", persistent=persistent).variable("x", "int64")
    count = Function("count", "customer", read=Read("seen", {"got": "count(1)"}), set={"n": "got"})
    if persistent:  # read before the step's writers: what earlier steps left
        model.layer(count)
    model.layer(Function("one", "order", emit=Emit("seen", {"x": "1"})))
    model.layer(Function("two", "order", emit=Emit("seen", {"x": "2"}, when="price > 100000")))
    if not persistent:
        model.layer(count)
    w = World(spark, model, checkpoint_every=0)
    w.set_population("customer", customers(spark, sf).select("_id"))
    w.set_population("order", orders(spark, sf).select("_id", "price"))
    for _ in range(steps):
        w.step()
    return w.population("customer").select("_id", "n")


@query("msg_append", f"SELECT _id, (SELECT count(*) + count(*) FILTER (WHERE price > 100000) FROM ({ORDERS_SQL})) AS n FROM ({CUSTOMERS_SQL})")
def msg_append(spark, sf):
    return two_writers(spark, sf, False, 2)


@query("msg_persist", f"SELECT _id, (SELECT count(*) + count(*) FILTER (WHERE price > 100000) FROM ({ORDERS_SQL})) AS n FROM ({CUSTOMERS_SQL})")
def msg_persist(spark, sf):
    return two_writers(spark, sf, True, 2)


def grid_sql(condition: str, value: str = "m.alive") -> str:
    return f"SELECT a._id, count(m._id) AS n, coalesce(sum({value}), 0)::BIGINT AS total FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON {condition} GROUP BY a._id"


FOLD = {"n": "count(m._id)", "total": "coalesce(sum(m.alive), 0)"}
ZERO = {"total": 0}
N_SQL, H_SQL = "(SELECT count(*) FROM customer)", f"(SELECT count(*) // {WIDTH} FROM customer)"


def gap(a: str, b: str, size: str) -> str:
    """Distance around a ring."""
    return f"least(abs({a} - {b}), {size} - abs({a} - {b}))"


@query("array1d", grid_sql("abs(m.idx - a.idx) <= 2 AND m.idx <> a.idx"))
def array1d(spark, sf):
    rows = customers(spark, sf)
    return S.read_grid(rows.select("_id", "idx"), rows, [rows.count()], ["idx"], FOLD, reach=2, defaults=ZERO).select("_id", "n", "total")


@query("array1d_wrap", grid_sql(f"{gap('m.idx', 'a.idx', N_SQL)} <= 2 AND m.idx <> a.idx"))
def array1d_wrap(spark, sf):
    rows = customers(spark, sf)
    return S.read_grid(rows.select("_id", "idx"), rows, [rows.count()], ["idx"], FOLD, reach=2, wrap=True, defaults=ZERO).select("_id", "n", "total")


def grid2(spark, sf, **how) -> DataFrame:
    rows = customers(spark, sf)
    return S.read_grid(rows.select("_id", "ix", "iy"), rows, [WIDTH, height(spark, sf)], ["ix", "iy"], FOLD, defaults=ZERO, **how).select("_id", "n", "total")


DX, DY = gap("m.ix", "a.ix", str(WIDTH)), gap("m.iy", "a.iy", H_SQL)


@query("array2d_moore", grid_sql("abs(m.ix - a.ix) <= 1 AND abs(m.iy - a.iy) <= 1 AND m._id <> a._id"))
def array2d_moore(spark, sf):
    return grid2(spark, sf)


@query("array2d_moore_wrap", grid_sql(f"{DX} <= 1 AND {DY} <= 1 AND m._id <> a._id"))
def array2d_moore_wrap(spark, sf):
    return grid2(spark, sf, wrap=True)


@query("array2d_vn", grid_sql("abs(m.ix - a.ix) + abs(m.iy - a.iy) <= 2 AND m._id <> a._id"))
def array2d_vn(spark, sf):
    return grid2(spark, sf, reach=2, neumann=True)


@query("array2d_vn_wrap", grid_sql(f"{DX} + {DY} <= 2 AND m._id <> a._id"))
def array2d_vn_wrap(spark, sf):
    return grid2(spark, sf, reach=2, neumann=True, wrap=True)


CUBE_SQL = f"SELECT _id, alive, idx % 5 AS jx, (idx // 5) % 6 AS jy, idx // {WIDTH} AS jz FROM ({CUSTOMERS_SQL})"


def cube_sql(condition: str) -> str:
    return f"SELECT a._id, count(m._id) AS n, coalesce(sum(m.alive), 0)::BIGINT AS total FROM ({CUBE_SQL}) a LEFT JOIN ({CUBE_SQL}) m ON {condition} AND m._id <> a._id GROUP BY a._id"


def grid3(spark, sf, **how) -> DataFrame:
    rows = customers(spark, sf).selectExpr("_id", "alive", "idx % 5 AS jx", "(idx div 5) % 6 AS jy", f"idx div {WIDTH} AS jz")
    return S.read_grid(rows.select("_id", "jx", "jy", "jz"), rows, [5, 6, height(spark, sf)], ["jx", "jy", "jz"], FOLD, defaults=ZERO, **how).select("_id", "n", "total")


EX, EY, EZ = gap("m.jx", "a.jx", "5"), gap("m.jy", "a.jy", "6"), gap("m.jz", "a.jz", H_SQL)


@query("array3d_moore", cube_sql("abs(m.jx - a.jx) <= 1 AND abs(m.jy - a.jy) <= 1 AND abs(m.jz - a.jz) <= 1"))
def array3d_moore(spark, sf):
    return grid3(spark, sf)


@query("array3d_moore_wrap", cube_sql(f"{EX} <= 1 AND {EY} <= 1 AND {EZ} <= 1"))
def array3d_moore_wrap(spark, sf):
    return grid3(spark, sf, wrap=True)


@query("array3d_vn", cube_sql("abs(m.jx - a.jx) + abs(m.jy - a.jy) + abs(m.jz - a.jz) <= 1"))
def array3d_vn(spark, sf):
    return grid3(spark, sf, neumann=True)


@query("array3d_vn_wrap", cube_sql(f"{EX} + {EY} + {EZ} <= 1"))
def array3d_vn_wrap(spark, sf):
    return grid3(spark, sf, neumann=True, wrap=True)


@query("array_at", f"SELECT a._id, coalesce(m.nation, 0) AS nation FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON m.ix = a.iy AND m.iy = a.ix")
def array_at(spark, sf):
    rows = customers(spark, sf)
    return S.read_at(rows.select("_id", "ix", "iy"), rows, ["ix", "iy"], ["iy", "ix"], {"nation": "nation"}).select("_id", "nation")


@query("array_offsets", f"SELECT a._id, coalesce(sum((m.ix - a.ix) * m.alive), 0)::BIGINT AS pull_x, coalesce(sum((m.iy - a.iy) * m.alive), 0)::BIGINT AS pull_y FROM ({CUSTOMERS_SQL}) a LEFT JOIN ({CUSTOMERS_SQL}) m ON abs(m.ix - a.ix) <= 1 AND abs(m.iy - a.iy) <= 1 AND m._id <> a._id GROUP BY a._id")
def array_offsets(spark, sf):
    rows = customers(spark, sf)
    fold = {"pull_x": "sum(m._d0 * m.alive)", "pull_y": "sum(m._d1 * m.alive)"}
    return S.read_grid(rows.select("_id", "ix", "iy"), rows, [WIDTH, height(spark, sf)], ["ix", "iy"], fold, defaults={"pull_x": 0, "pull_y": 0}).select("_id", "pull_x", "pull_y")


@query("array_conflicts", f"SELECT nation, alive, count(*) AS written FROM ({CUSTOMERS_SQL}) GROUP BY 1, 2 HAVING count(*) > 1")
def array_conflicts(spark, sf):
    return S.conflicts(customers(spark, sf), ["nation", "alive"])


@query("array_dense", f"SELECT CAST(i % {WIDTH} AS INTEGER) AS ix, CAST(i // {WIDTH} AS INTEGER) AS iy, coalesce(c.nation, 0) AS nation FROM (SELECT range AS i FROM range({N_SQL[1:-1].replace('SELECT ', 'SELECT ')} )) LEFT JOIN ({CUSTOMERS_SQL}) c ON c.idx = i AND c.alive = 1".replace(f"range({N_SQL[1:-1]} )", f"range({N_SQL})"))
def array_dense(spark, sf):
    rows = customers(spark, sf).where("alive = 1")
    return S.dense(rows, ["ix", "iy"], [WIDTH, height(spark, sf)], ["nation"])


@query("linear_index", f"SELECT _id, idx AS at FROM ({CUSTOMERS_SQL})")
def linear_index(spark, sf):
    return customers(spark, sf).select("_id", S.linear_index(["ix", "iy"], [WIDTH, 1 << 20]).alias("at"))


FLAT = S.Space((-5.0, -5.0), (5.0, 5.0), 1.0)
DEEP = S.Space((-5.0, -5.0, -5.0), (5.0, 5.0, 5.0), 2.0)
CELL = "least(greatest(floor(({} + 5) / {}), 0), {})"


def cell_sql(axes: str, width: float, n: int, wrap: bool = False) -> str:
    parts = []
    for c in axes:
        a, m = CELL.format(f"a.{c}", width, n - 1), CELL.format(f"m.{c}", width, n - 1)
        parts.append(f"{gap(m, a, str(n))} <= 1" if wrap else f"abs({m} - {a}) <= 1")
    return " AND ".join(parts)


def near_sql(axes: str, condition: str) -> str:
    return f"SELECT a._id, count(m._id) AS n, coalesce(sum(m.label), 0)::BIGINT AS total FROM ({POINTS_SQL}) a LEFT JOIN ({POINTS_SQL}) m ON {condition} AND m._id <> a._id GROUP BY a._id"


def near(spark, sf, space: S.Space, **how) -> DataFrame:
    rows = points(spark, sf)
    fold = {"n": "count(m._id)", "total": "sum(m.label)"}
    return S.read_space(rows.select("_id", *space.names), rows, space, fold, where="m._id <> a._id", defaults={"total": 0}, **how).select("_id", "n", "total")


@query("spatial2d_cells", near_sql("xy", cell_sql("xy", 1.0, 10)))
def spatial2d_cells(spark, sf):
    return near(spark, sf, FLAT)


@query("spatial2d", near_sql("xy", "(m.x - a.x) * (m.x - a.x) + (m.y - a.y) * (m.y - a.y) <= 1"))
def spatial2d(spark, sf):
    return near(spark, sf, FLAT, within=1.0)


@query("spatial2d_wrap", near_sql("xy", cell_sql("xy", 1.0, 10, True)))
def spatial2d_wrap(spark, sf):
    return near(spark, sf, FLAT, wrap=True, edge=True)


@query("spatial3d", near_sql("xyz", "(m.x - a.x) * (m.x - a.x) + (m.y - a.y) * (m.y - a.y) + (m.z - a.z) * (m.z - a.z) <= 4"))
def spatial3d(spark, sf):
    return near(spark, sf, DEEP, within=2.0)


@query("spatial3d_wrap", near_sql("xyz", cell_sql("xyz", 2.0, 5, True)))
def spatial3d_wrap(spark, sf):
    return near(spark, sf, DEEP, wrap=True, edge=True)


@query("virtual_xy", f"SELECT _id, CAST(round(1e6 * CASE WHEN abs(y - x) > 5 THEN y - sign(y - x) * 10 ELSE y END) AS BIGINT) AS image FROM ({POINTS_SQL})")
def virtual_xy(spark, sf):
    return points(spark, sf).select("_id", F.round(S.virtual(FLAT, 0, "x", "y") * 1e6).cast("long").alias("image"))


@query("neighbour_argmax", f"SELECT _id, best FROM (SELECT a._id, m._id AS best, row_number() OVER (PARTITION BY a._id ORDER BY m.nation DESC, m._id DESC) AS r FROM ({CUSTOMERS_SQL}) a JOIN ({CUSTOMERS_SQL}) m ON abs(m.ix - a.ix) <= 1 AND abs(m.iy - a.iy) <= 1 AND m._id <> a._id) WHERE r = 1")
def neighbour_argmax(spark, sf):
    rows = customers(spark, sf)
    fold = {"best": "max_by(m._id, struct(m.nation, m._id))"}
    return S.read_grid(rows.select("_id", "ix", "iy"), rows, [WIDTH, height(spark, sf)], ["ix", "iy"], fold).select("_id", "best")


@query("any_neighbour", f"SELECT a._id FROM ({CUSTOMERS_SQL}) a WHERE EXISTS (SELECT 1 FROM ({ORDERS_SQL}) m WHERE m.cust = a.idx AND m.price > 200000)")
def any_neighbour(spark, sf):
    sent = orders(spark, sf).where("price > 200000")
    rows = customers(spark, sf)
    return rows.join(sent, rows["idx"] == sent["cust"], "left_semi").select("_id")


# ---- reductions and order ---------------------------------------------------------------

LINES_SQL = "SELECT l_quantity AS q, l_extendedprice AS p, l_returnflag AS flag, l_linenumber AS line FROM lineitem"


def lines(spark, sf):
    return read(spark, sf, "lineitem").selectExpr("l_quantity AS q", "l_extendedprice AS p", "l_returnflag AS flag", "l_linenumber AS line")


@query("reductions", f"SELECT count(*) AS count, sum(line)::BIGINT AS sum_line, min(p) AS min_p, max(p) AS max_p, CAST(round(avg(q) * 1e6) AS BIGINT) AS mean_q, CAST(round(stddev_pop(q) * 1e6) AS BIGINT) AS deviation_q, count(*) FILTER (WHERE line = 3) AS count_value_line FROM ({LINES_SQL})")
def reductions(spark, sf):
    asked = [R.Reduce("count"), R.Reduce("sum", "line"), R.Reduce("min", "p"), R.Reduce("max", "p"), R.Reduce("mean", "q"), R.Reduce("standard_deviation", "q"), R.Reduce("count_value", "line", 3)]
    out = R.reduce_frame(lines(spark, sf), *asked)
    return out.selectExpr("count", "sum_line", "min_p", "max_p", "CAST(round(mean_q * 1e6) AS BIGINT) AS mean_q", "CAST(round(standard_deviation_q * 1e6) AS BIGINT) AS deviation_q", "count_value_line")


@query("reductions_by_state", f"SELECT flag, count(*) AS count, sum(line)::BIGINT AS sum_line, max(p) AS max_p FROM ({LINES_SQL}) GROUP BY flag")
def reductions_by_state(spark, sf):
    return R.reduce_frame(lines(spark, sf), R.Reduce("count"), R.Reduce("sum", "line"), R.Reduce("max", "p"), by=("flag",))


@query("reduce_custom", f"SELECT bit_xor(line)::BIGINT AS value FROM ({LINES_SQL})")
def reduce_custom(spark, sf):
    return R.reduce_frame(lines(spark, sf), R.Reduce("custom", "line", aggregate="bit_xor({})", initial=0)).selectExpr("CAST(custom_line AS BIGINT) AS value")


@query("fold_ordered", f"SELECT max(cust)::BIGINT AS value FROM ({ORDERS_SQL})")
def fold_ordered(spark, sf):
    return R.fold_ordered(orders(spark, sf), "cust", 0, "greatest(acc, x)")


@query("transform_reduce", f"SELECT sum(CASE WHEN q > 25 THEN line ELSE 0 END)::BIGINT AS value FROM ({LINES_SQL})")
def transform_reduce(spark, sf):
    return R.reduce_frame(lines(spark, sf), R.Reduce("transform", "line", "CASE WHEN q > 25 THEN line ELSE 0 END", "sum({})")).selectExpr("transform_line AS value")


@query("histogram_even", f"SELECT CAST(b.range AS INTEGER) AS bin, count(l.q) AS n FROM range(8) b LEFT JOIN ({LINES_SQL}) l ON l.q >= 5 AND l.q < 45 AND CAST(floor((l.q - 5) * 8 / 40) AS BIGINT) = b.range GROUP BY 1")
def histogram_even(spark, sf):
    return R.histogram_even(lines(spark, sf), "q", 8, 5.0, 45.0)


@query("sort1", f"SELECT _id, row_number() OVER (ORDER BY price DESC, _id) AS place FROM ({ORDERS_SQL})")
def sort1(spark, sf):
    return R.place_in_order(orders(spark, sf).select("_id", "price"), ("price", "desc")).selectExpr("_id", "_place AS place")


@query("sort2", f"SELECT _id, row_number() OVER (ORDER BY yr, price DESC, _id) AS place FROM ({ORDERS_SQL})")
def sort2(spark, sf):
    return R.place_in_order(orders(spark, sf).select("_id", "yr", "price"), ("yr", "asc"), ("price", "desc")).selectExpr("_id", "_place AS place")


@query("sort_population", f"SELECT _id, {cents('price')} AS cents FROM ({ORDERS_SQL})")
def sort_population(spark, sf):
    """The population in order (a test looks at the order itself)."""
    return R.sort_population(orders(spark, sf), ("yr", "desc"), ("price", "asc")).selectExpr("_id", f"{cents('price')} AS cents")


@query("sort_bits", f"SELECT _id, (cust >> 2) & 15 AS key FROM ({ORDERS_SQL})")
def sort_bits(spark, sf):
    return R.sort_population(orders(spark, sf), ("cust", "asc"), bits=(2, 6)).select("_id", R.bits_of("cust", 2, 6).alias("key"))


@query("spatial_sort_bins", f"SELECT _id, CAST({CELL.format('x', 1.0, 9)} AS INTEGER) AS cx, CAST({CELL.format('y', 1.0, 9)} AS INTEGER) AS cy FROM ({POINTS_SQL})")
def spatial_sort_bins(spark, sf):
    return R.sort_by_place(points(spark, sf), FLAT).select("_id", FLAT.cell(0).alias("cx"), FLAT.cell(1).alias("cy"))


# ---- environment --------------------------------------------------------------------------

SENT_SQL = f"SELECT cust % 7 AS i, yr % 3 AS j, {cents('price')} AS v, _id FROM ({ORDERS_SQL})"


def sent_cells(spark, sf):
    return M.cells_of(orders(spark, sf), {"i": "cust % 7", "j": "yr % 3"}, cents("price"), ("_id",))


def held_cells(spark):
    return spark.range(7).selectExpr("CAST(id AS INT) AS i", "0 AS j", "0 AS k", "0 AS w", "100 * id AS value")


def macro_sql(aggregate: str, merge: str) -> str:
    return f"SELECT CAST(coalesce(h.i, s.i) AS INTEGER) AS i, CAST(coalesce(h.j, s.j) AS INTEGER) AS j, {merge} AS value FROM (SELECT range AS i, 0 AS j, 100 * range AS value FROM range(7)) h FULL JOIN (SELECT i, j, {aggregate} AS v FROM ({SENT_SQL}) GROUP BY 1, 2) s ON h.i = s.i AND h.j = s.j"


@query("macro_add", macro_sql("sum(v)::BIGINT", "coalesce(h.value, 0) + coalesce(s.v, 0)"))
def macro_add(spark, sf):
    return M.update(held_cells(spark), M.checked(sent_cells(spark, sf), (7, 3)).drop("_id"), "add").select("i", "j", "value")


@query("macro_subtract", macro_sql("sum(v)::BIGINT", "coalesce(h.value, 0) - coalesce(s.v, 0)"))
def macro_subtract(spark, sf):
    return M.update(held_cells(spark), sent_cells(spark, sf).drop("_id"), "subtract").select("i", "j", "value")


@query("macro_max", macro_sql("max(v)", "CASE WHEN s.v IS NULL THEN coalesce(h.value, 0) ELSE greatest(coalesce(h.value, 0), s.v) END"))
def macro_max(spark, sf):
    return M.update(held_cells(spark), sent_cells(spark, sf).drop("_id"), "max").select("i", "j", "value")


@query("macro_min", macro_sql("min(v)", "CASE WHEN s.v IS NULL THEN coalesce(h.value, 0) ELSE least(coalesce(h.value, 0), s.v) END"))
def macro_min(spark, sf):
    return M.update(held_cells(spark), sent_cells(spark, sf).drop("_id"), "min").select("i", "j", "value")


@query("macro_exchange", macro_sql("arg_max(v, _id)", "coalesce(s.v, h.value)"))
def macro_exchange(spark, sf):
    return M.exchange(held_cells(spark), sent_cells(spark, sf)).select("i", "j", "value")


@query("macro_cas", f"SELECT CAST(h.range AS INTEGER) AS i, coalesce(s.v, 100 * h.range) AS value FROM range(7) h LEFT JOIN (SELECT i, arg_min(v, _id) AS v FROM ({SENT_SQL}) WHERE j = 0 AND 100 * i = 100 * (_id % 7) GROUP BY 1) s ON s.i = h.range")
def macro_cas(spark, sf):
    sent = sent_cells(spark, sf).where("j = 0").withColumn("expected", F.expr("100 * (_id % 7)"))
    return M.compare_and_swap(held_cells(spark), sent).select("i", "value")


@query("macro_add_results", f"SELECT _id, (CASE WHEN j = 0 THEN 100 * i ELSE 0 END + coalesce(sum(v) OVER (PARTITION BY i, j ORDER BY _id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS old FROM ({SENT_SQL})")
def macro_add_results(spark, sf):
    return M.add_with_results(held_cells(spark), sent_cells(spark, sf))[1].select("_id", "old")


@query("macro_dense", "SELECT CAST(range // 3 AS INTEGER) AS i, CAST(range % 3 AS INTEGER) AS j, CASE WHEN range % 3 = 0 THEN 100 * (range // 3) * 2 + 1 ELSE 1 END AS value FROM range(21)")
def macro_dense(spark, sf):
    return M.arithmetic(held_cells(spark), (7, 3), "value * 2 + 1").select("i", "j", "value")


def trade(spark, sf) -> Graph:
    """Suppliers to parts: vertices are both, parts behind suppliers."""
    lines_ = read(spark, sf, "lineitem")
    edges = lines_.selectExpr("l_suppkey + 1 AS source", "l_partkey + 1000001 AS dest", "l_quantity AS q").groupBy("source", "dest").agg(F.sum("q").cast("long").alias("weight"))
    sellers = read(spark, sf, "supplier").selectExpr("s_suppkey + 1 AS id", "CAST(s_nationkey AS BIGINT) AS tag")
    goods = read(spark, sf, "part").selectExpr("p_partkey + 1000001 AS id", "CAST(p_size AS BIGINT) AS tag")
    return Graph(sellers.unionByName(goods), edges)


EDGES_SQL = "SELECT l_suppkey + 1 AS source, l_partkey + 1000001 AS dest, sum(l_quantity)::BIGINT AS weight FROM lineitem GROUP BY 1, 2"
VERTICES_SQL = "SELECT s_suppkey + 1 AS id, CAST(s_nationkey AS BIGINT) AS tag FROM supplier UNION ALL SELECT p_partkey + 1000001, CAST(p_size AS BIGINT) FROM part"


@query("graph_out_edges", f"SELECT v.id AS _id, count(e.dest) AS n, coalesce(sum(e.weight), 0)::BIGINT AS total FROM ({VERTICES_SQL}) v LEFT JOIN ({EDGES_SQL}) e ON e.source = v.id GROUP BY 1")
def graph_out_edges(spark, sf):
    g = trade(spark, sf)
    return S.read_edges(g.vertices.selectExpr("id AS _id"), g.edges, "_id", {"n": "count(m.dest)", "total": "sum(m.weight)"}, defaults={"total": 0})


@query("graph_in_edges", f"SELECT v.id AS _id, count(e.dest) AS n, coalesce(sum(e.weight), 0)::BIGINT AS total FROM ({VERTICES_SQL}) v LEFT JOIN ({EDGES_SQL}) e ON e.dest = v.id GROUP BY 1")
def graph_in_edges(spark, sf):
    g = trade(spark, sf)
    return S.read_edges(g.vertices.selectExpr("id AS _id"), g.edges, "_id", {"n": "count(m.source)", "total": "sum(m.weight)"}, incoming=True, defaults={"total": 0})


@query("graph_edge_lookup", f"SELECT e.source, e.dest, e.weight, v.tag FROM ({EDGES_SQL}) e LEFT JOIN ({VERTICES_SQL}) v ON v.id = e.dest")
def graph_edge_lookup(spark, sf):
    g = trade(spark, sf)
    return g.lookup(g.edges, {"tag": "tag"}).select("source", "dest", "weight", "tag")


@query("graph_degrees", f"SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM ({VERTICES_SQL}) v LEFT JOIN (SELECT source, count(*) AS n FROM ({EDGES_SQL}) GROUP BY 1) o ON o.source = v.id LEFT JOIN (SELECT dest, count(*) AS n FROM ({EDGES_SQL}) GROUP BY 1) i ON i.dest = v.id")
def graph_degrees(spark, sf):
    return trade(spark, sf).degrees()


@query("graph_validate", "SELECT 'edge without target' AS fault, r_regionkey + 1 AS id, r_regionkey + 7 AS other FROM region WHERE r_regionkey + 7 > 5")
def graph_validate(spark, sf):
    v = read(spark, sf, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS id")
    e = read(spark, sf, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS source", "CAST(r_regionkey + 7 AS BIGINT) AS dest")
    out = Graph(v, e).faults()
    return out.select("fault", F.col("id").cast("int").alias("id"), F.col("other").cast("int").alias("other"))


@query("graph_upsert", f"SELECT id, CASE WHEN id <= 1000000 THEN -1 ELSE tag END::BIGINT AS tag FROM ({VERTICES_SQL}) UNION ALL SELECT CAST(5000000 AS BIGINT), CAST(-1 AS BIGINT)")
def graph_upsert(spark, sf):
    g = trade(spark, sf)
    rows = read(spark, sf, "supplier").selectExpr("s_suppkey + 1 AS id", "CAST(-1 AS BIGINT) AS tag").unionByName(spark.range(1).selectExpr("CAST(5000000 AS BIGINT) AS id", "CAST(-1 AS BIGINT) AS tag"))
    return g.upsert_vertices(rows).vertices


# ---- models -------------------------------------------------------------------------------


def life_model(size: tuple[int, int]) -> Model:
    model = Model("life")
    model.agent("cell").variable("ix", "int64").variable("iy", "int64").variable("alive", "int64")
    model.message("seen", shape="grid", size=size).variable("alive", "int64")
    model.layer(Function("show", "cell", emit=Emit("seen", {"_ix": "ix", "_iy": "iy", "alive": "alive"})))
    model.layer(Function("live", "cell", read=Read("seen", {"n": "sum(m.alive)"}, at=("ix", "iy"), wrap=True), set={"alive": "CASE WHEN n = 3 OR (n = 2 AND alive = 1) THEN 1 ELSE 0 END"}))
    return model


def life(spark, sf, steps: int) -> DataFrame:
    w = World(spark, life_model((WIDTH, height(spark, sf))))
    w.set_population("cell", customers(spark, sf).select("_id", "ix", "iy", "alive"))
    w.simulate(steps)
    return w.population("cell").select("_id", "alive")


def life_sql(steps: int) -> str:
    tables = [f"g0 AS MATERIALIZED (SELECT _id, ix, iy, alive FROM ({CUSTOMERS_SQL}))", f"h AS MATERIALIZED (SELECT {H_SQL} AS h)", "d AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a, range(3) b WHERE a.range <> 1 OR b.range <> 1)"]
    for k in range(steps):
        tables.append(f"p{k} AS (SELECT (ix + dx + {WIDTH}) % {WIDTH} AS ix, (iy + dy + h) % h AS iy, sum(alive) AS n FROM g{k}, d, h GROUP BY 1, 2)")
        tables.append(f"g{k + 1} AS MATERIALIZED (SELECT g._id, g.ix, g.iy, CASE WHEN n = 3 OR (n = 2 AND alive = 1) THEN 1 ELSE 0 END AS alive FROM g{k} g JOIN p{k} USING (ix, iy))")
    return f"WITH {', '.join(tables)} SELECT _id, CAST(alive AS BIGINT) AS alive FROM g{steps}"


@query("life_1", life_sql(1))
def life_1(spark, sf):
    return life(spark, sf, 1)


@query("life_4", life_sql(4))
def life_4(spark, sf):
    return life(spark, sf, 4)


@query("diffusion_3")
def diffusion_3(spark, sf):
    """Heat on a torus, four-point stencil; no SQL, as sums of doubles depend on order: a test checks it in numpy."""
    size = (WIDTH, height(spark, sf))
    model = Model("diffusion")
    model.environment.property("rate", 0.1)
    model.agent("cell").variable("ix", "int64").variable("iy", "int64").variable("value")
    model.message("heat", shape="grid", size=size).variable("value")
    model.layer(Function("show", "cell", emit=Emit("heat", {"_ix": "ix", "_iy": "iy", "value": "value"})))
    model.layer(Function("flow", "cell", read=Read("heat", {"around": "sum(m.value)"}, at=("ix", "iy"), wrap=True, neumann=True), set={"value": "value + env.rate * (around - 4 * value)"}))
    w = World(spark, model)
    w.set_population("cell", customers(spark, sf).selectExpr("_id", "ix", "iy", "bal AS value"))
    w.simulate(3)
    return w.population("cell").select("_id", F.round("value", 6).alias("value"))


FORCE = "CASE WHEN m.x > a.x THEN -1 WHEN m.x < a.x THEN 1 ELSE 0 END"


@query("circles_1", f"SELECT a._id, coalesce(sum({FORCE}), 0)::BIGINT AS force, count(m._id) AS n FROM ({POINTS_SQL}) a LEFT JOIN ({POINTS_SQL}) m ON (m.x - a.x) * (m.x - a.x) + (m.y - a.y) * (m.y - a.y) + (m.z - a.z) * (m.z - a.z) <= 4 AND m._id <> a._id GROUP BY 1")
def circles_1(spark, sf):
    model = Model("circles")
    agent = model.agent("circle")
    for v in "xyz":
        agent.variable(v)
    agent.variable("force", "int64").variable("n", "int64")
    model.message("at", shape="space", space=DEEP).variable("id", "int64")
    model.layer(Function("show", "circle", emit=Emit("at", {"x": "x", "y": "y", "z": "z", "id": "_id"})))
    model.layer(Function("push", "circle", read=Read("at", {"f": f"sum({FORCE})", "met": "count(m.id)"}, within=2.0, where="m.id <> a._id", defaults={"f": 0}), set={"force": "f", "n": "met"}))
    w = World(spark, model)
    w.set_population("circle", points(spark, sf))
    w.step()
    return w.population("circle").select("_id", "force", "n")


@query("boids_1", f"SELECT a._id, count(m._id) AS flock, coalesce(CAST(round(avg(m.label) * 1e6) AS BIGINT), 0) AS heading FROM ({POINTS_SQL}) a LEFT JOIN ({POINTS_SQL}) m ON (m.x - a.x) * (m.x - a.x) + (m.y - a.y) * (m.y - a.y) + (m.z - a.z) * (m.z - a.z) <= 4 AND m._id <> a._id GROUP BY 1")
def boids_1(spark, sf):
    rows = points(spark, sf)
    fold = {"flock": "count(m._id)", "heading": "CAST(round(avg(m.label) * 1e6) AS BIGINT)"}
    return S.read_space(rows.select("_id", "x", "y", "z"), rows, DEEP, fold, within=2.0, where="m._id <> a._id", defaults={"heading": 0}).select("_id", "flock", "heading")


@query("sugarscape_step", f"SELECT c._id, coalesce(t.best, 0) AS moved_to FROM ({CUSTOMERS_SQL}) c LEFT JOIN (SELECT mover, best FROM (SELECT *, row_number() OVER (PARTITION BY best ORDER BY nation DESC, mover) AS w FROM (SELECT a._id AS mover, a.nation, m._id AS best, row_number() OVER (PARTITION BY a._id ORDER BY m.bal DESC, m._id DESC) AS r FROM ({CUSTOMERS_SQL}) a JOIN ({CUSTOMERS_SQL}) m ON abs(m.ix - a.ix) <= 1 AND abs(m.iy - a.iy) <= 1 AND m._id <> a._id AND m.alive = 0 WHERE a.alive = 1) WHERE r = 1) WHERE w = 1) t ON t.mover = c._id")
def sugarscape_step(spark, sf):
    """Movers ask the best free cell near them; each cell takes one request."""
    rows = customers(spark, sf)
    size = [WIDTH, height(spark, sf)]
    movers, free = P.split(rows, "alive = 1")
    asked = S.read_grid(movers.select("_id", "nation", "ix", "iy"), free, size, ["ix", "iy"], {"best": "max_by(m._id, struct(m.bal, m._id))"})
    taken = S.read_bucket(free.select("_id"), asked.where("best IS NOT NULL"), "_id", "best", {"winner": "max_by(m._id, struct(m.nation, -m._id))"})
    won = taken.where("winner IS NOT NULL").selectExpr("winner AS _id", "_id AS best")
    return rows.select("_id").join(won, "_id", "left").select("_id", F.coalesce("best", F.lit(0)).cast("long").alias("moved_to"))


@query("submodel", f"SELECT _id, idx AS a, idx + 3 AS b FROM ({CUSTOMERS_SQL})")
def submodel(spark, sf):
    inner = Model("inner")
    inner.agent("x").variable("v", "int64").variable("n", "int64")
    inner.layer(Function("add", "x", set={"v": "v + 1", "n": "n + 1"}))
    inner.exit_conditions.append(lambda w: w.step_count >= 3)
    outer = Model("outer")
    outer.agent("y").variable("a", "int64").variable("b", "int64")
    outer.layer(submodel=outer.submodel("sub", inner, agents={"x": "y"}, variables={"x": {"v": "b"}}))
    w = World(spark, outer, checkpoint_every=0)
    w.set_population("y", customers(spark, sf).selectExpr("_id", "idx AS a", "idx AS b"))
    w.step()
    return w.population("y").select("_id", "a", "b")


@query("dag_layers", "SELECT * FROM (VALUES (0, 'emit'), (0, 'other'), (1, 'read'), (2, 'host')) t(layer, name)")
def dag_layers(spark, sf):
    model = Model("dag")
    model.agent("a").variable("v", "int64")
    model.agent("b").variable("v", "int64")
    model.message("m").variable("v", "int64")
    emit = Node(Function("emit", "a", emit=Emit("m", {"v": "v"})))
    other = Node(Function("other", "b", set={"v": "v + 1"}))
    got = Node(Function("read", "a", read=Read("m", {"n": "count(1)"}), set={"v": "n"})).depends_on(emit)

    def host(world):
        return None

    end = Node(host).depends_on(got, other)
    layers = DependencyGraph(emit, other, got, end).layers(model)
    rows = [(i, n) for i, x in enumerate(layers) for n in ([f.name for f in x.functions] or ["host"])]
    return spark.createDataFrame(rows, "layer int, name string")


@query("macro_in_layer", f"SELECT CAST(cust % 7 AS INTEGER) AS i, count(*)::DOUBLE AS value FROM ({ORDERS_SQL}) GROUP BY 1")
def macro_in_layer(spark, sf):
    model = Model("macro")
    model.agent("order").variable("cust", "int64")
    model.environment.macro("visits", "double", (7,))
    model.layer(Function("visit", "order", macro=MacroUpdate("visits", "add", {"i": "cust % 7"}, "1")))
    w = World(spark, model, checkpoint_every=0)
    w.set_population("order", orders(spark, sf))
    w.step()
    return w.macros["visits"].select("i", "value")


@query("macro_read", f"SELECT _id, (SELECT count(*) FROM ({ORDERS_SQL}) m WHERE m.cust % 7 = a.cust % 7)::BIGINT AS mark FROM ({ORDERS_SQL}) a")
def macro_read(spark, sf):
    """Agents read in the second layer what all of them added in the first."""
    model = Model("macro")
    model.agent("order").variable("cust", "int64").variable("mark", "int64")
    model.environment.macro("visits", "double", (7,))
    model.layer(Function("visit", "order", macro=MacroUpdate("visits", "add", {"i": "cust % 7"}, "1")))
    model.layer(Function("look", "order", read=Read(macro="visits", index={"i": "cust % 7"}, fold={"seen": "value"}), set={"mark": "seen"}))
    w = World(spark, model, checkpoint_every=0)
    w.set_population("order", orders(spark, sf))
    w.step()
    return w.population("order").select("_id", "mark")


@query("graph_in_model", f"SELECT v.id AS _id, count(e.dest) AS n FROM ({VERTICES_SQL}) v LEFT JOIN ({EDGES_SQL}) e ON e.dest = v.id AND e.weight > 30 GROUP BY 1")
def graph_in_model(spark, sf):
    model = Model("trade")
    model.agent("place").variable("n", "int64")
    model.environment.graph("trade", edges=[Variable("weight", "int64")])
    model.layer(Function("count", "place", read=Read(graph="trade", key="_id", incoming=True, fold={"got": "count(m.dest)"}, where="m.weight > 30"), set={"n": "got"}))
    w = World(spark, model, checkpoint_every=0)
    w.graphs["trade"] = trade(spark, sf)
    w.set_population("place", w.graphs["trade"].vertices.selectExpr("id AS _id"))
    w.step()
    return w.population("place").select("_id", "n")


@query("step_log", f"SELECT CAST(range AS BIGINT) AS step, (SELECT count(*) FROM ({CUSTOMERS_SQL})) AS n, (SELECT sum(idx) FROM ({CUSTOMERS_SQL}))::BIGINT + range * (SELECT count(*) FROM ({CUSTOMERS_SQL})) AS total FROM range(4)")
def step_log(spark, sf):
    model = Model("counter")
    model.agent("c").variable("v", "int64")
    model.layer(Function("add", "c", set={"v": "v + 1"}))
    w = World(spark, model)
    w.set_population("c", customers(spark, sf).selectExpr("_id", "idx AS v"))
    w.simulate(3, StepLog({("c", "default"): [R.Reduce("sum", "v")]}))
    rows = [(r["step"], r["c.default.count"], r["c.default.sum_v"]) for r in w.log]
    return spark.createDataFrame(rows, "step long, n long, total long")


@query("exit_condition", f"SELECT _id, idx + 5 AS v FROM ({CUSTOMERS_SQL})")
def exit_condition(spark, sf):
    model = Model("until")
    model.agent("c").variable("v", "int64")
    model.layer(Function("add", "c", set={"v": "v + 1"}))
    model.exit_conditions.append(lambda w: w.reduce("c", R.Reduce("min", "v"))["min_v"] >= 5)
    w = World(spark, model)
    w.set_population("c", customers(spark, sf).selectExpr("_id", "idx AS v"))
    w.simulate()
    return w.population("c").select("_id", "v")


def sweep(spark) -> Model:
    model = Model("sweep")
    model.environment.property("a", 0.0).property("b", 0, "int64").property("out", 0, "int64")
    model.agent("c").variable("v", "int64")
    return model


@query("plan_lerp", "SELECT range AS run_id, CAST(round((1.0 - range / 9.0::DOUBLE) * 2 * 1e6 + range / 9.0::DOUBLE * 5 * 1e6) AS BIGINT) AS a, CAST(round(10 * (1 - range / 9.0::DOUBLE) + 20 * (range / 9.0::DOUBLE)) AS BIGINT) AS b FROM range(10)")
def plan_lerp(spark, sf):
    plans = RunPlans(spark, sweep(spark), 10).lerp("a", 2, 5).lerp("b", 10, 20)
    return plans.frame.selectExpr("run_id", "CAST(round(a * 1e6) AS BIGINT) AS a", "b")


@query("plan_step", "SELECT range AS run_id, CAST(3 + 4 * range AS BIGINT) AS b, CAST(100 + range AS BIGINT) AS seed FROM range(10) UNION ALL SELECT 10 + range, CAST(3 + 4 * range AS BIGINT), CAST(100 + range AS BIGINT) FROM range(10)")
def plan_step(spark, sf):
    plans = RunPlans(spark, sweep(spark), 10).stepped("b", 3, 4).seeds(100)
    return (plans * 2).frame.select("run_id", "b", "seed")


@query("ensemble_sum", f"SELECT p.range AS run_id, sum(idx + 2 * (3 + 4 * p.range))::BIGINT AS total FROM ({CUSTOMERS_SQL}), range(5) p GROUP BY 1")
def ensemble_sum(spark, sf):
    """Two steps of all runs as one frame, with run_id among the keys."""
    plans = RunPlans(spark, sweep(spark), 5).stepped("b", 3, 4)
    from .runplans import ensemble_frame

    rows = ensemble_frame(customers(spark, sf).selectExpr("_id", "idx AS v"), plans)
    for _ in range(2):
        rows = P.set_variables(rows, {"v": "v + b"})
    return R.reduce_frame(rows, R.Reduce("sum", "v"), by=("run_id",)).withColumnRenamed("sum_v", "total")


def drift(price, cust):
    """Source that is translated, not run."""
    step = 0
    for k in range(3):
        step += k * cust
    if price > 100000.0 and cust % 2 == 0:
        return step + 1
    elif price > 50000.0:
        step = step * 2
    return step


@query("translate_function", f"SELECT _id, CASE WHEN price > 100000 AND cust % 2 = 0 THEN 3 * cust + 1 WHEN price > 50000 THEN 6 * cust ELSE 3 * cust END AS v FROM ({ORDERS_SQL})")
def translate_function(spark, sf):
    return orders(spark, sf).select("_id", translate(drift).cast("long").alias("v"))


@query("agent_random")
def agent_random(spark, sf):
    """Draws by agent; their distribution is tested."""
    from ..functions.rng import AgentRandom

    r = AgentRandom(12, 3, "query")
    return customers(spark, sf).select("_id", r.uniform().alias("u"), r.uniform_int(1, 6, 1).alias("die"), r.normal().alias("normal"), r.log_normal(0, 1, 1).alias("log_normal"), r.poisson(4.0, 2).alias("poisson"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a keyed message read over a world of customers and orders."""
    return bucket_single(spark, sf)


__all__ = ["QUERIES", "SQL", "SubModel", "Variable", "entry"]


from . import catalogue_more  # noqa: E402, F401
