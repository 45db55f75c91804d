"""Queries on rows that the small tables do not hold: sums at the edge of a digit, readers outside the bounds, ordered reads, large documents."""

import json

import pytest

from swarmframe.errors import MessageError
from swarmframe.operators import ordered as O
from swarmframe.operators import shapes as S
from swarmframe.operators.graphs import Graph
from swarmframe.plans import catalogue
from swarmframe.sources import state as IO
from swarmframe.types import Variable


def sql_rows(name: str, folder: str, *tables: str) -> list[tuple]:
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(catalogue.SQL[name]).fetchall())


def test_translated_sums_go_in_the_order_of_the_sql(spark, tmp_path):
    """Rows whose last digit depends on the order in which the terms are added."""
    rows = [(780956, 341885.97), (550857, 425705.91), (849065, 235415.04), (283065, 230715.73), (443529, 403094.45), (94724, 331641.63)]
    made = spark.createDataFrame([(k, c, p) for k, (c, p) in enumerate(rows)], "o_orderkey long, o_custkey long, o_totalprice double")
    made.selectExpr("*", "'F' AS o_orderstatus", "TIMESTAMP '1995-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["translate_math"](spark, str(tmp_path)).select("_id", "v")
    assert sorted(map(tuple, got.collect())) == sql_rows("translate_math", str(tmp_path), "orders")


@pytest.mark.parametrize("name", ["spatial2d_wrap", "spatial3d_wrap"])
def test_wrapped_reads_from_outside_the_bounds(spark, tmp_path, name):
    """Places outside are those of the edge cells, for readers as for messages; NaN sorts last."""
    nan = float("nan")
    places = [(-0.53, 0.2, 0.1), (0.53, 0.2, 0.1), (0.49, 0.2, 0.1), (-0.49, 0.2, -0.9), (0.0, 0.9, 0.0), (nan, 0.2, 0.1), (0.1, -0.2, 0.3), (0.48, 0.21, 0.5)]
    made = spark.createDataFrame([(k, list(p), k % 3 if k else None) for k, p in enumerate(places)], "vec_id long, embedding array<float>, label int")
    made.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select("_id", "n", "total")
    assert sorted(map(tuple, got.collect())) == sql_rows(name, str(tmp_path), "embeddings")


def test_no_distance_from_outside_a_torus(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5)], "_id long, x double, y double")
    with pytest.raises(MessageError):
        S.read_space(p, p, S.Space((0.0, 0.0), (10.0, 10.0), 1.0), {"n": "count(1)"}, wrap=True, within=1.0, edge=True)


FOLD = {"n": "count(1)", "k": "count(m.v)", "s": "sum(m.v)"}
ENDS = FOLD | {"low": "min(m.v)", "top": "max(m.x)"}
CONDITIONS = [
    ("m.x > a.x", ENDS), ("m.x >= a.x + 1", ENDS), ("a.x > m.x", ENDS), ("m.x <= a.x", ENDS), ("m.v < a.x", ENDS), ("(m.g = a.g) AND (m.x > a.x)", ENDS),
    ("m.g = a.g AND m.x >= a.x AND m._id <> a._id", FOLD), ("m.v <> a.v", FOLD), ("m.x != a.x and m.v > 2 and a.v > 1", FOLD), ("m.x < a.x AND a.v > 3 AND m.v < 5", ENDS),
]


def odd_rows(spark, n: int = 240):
    """Ties, both zeros, NaN, infinities and nulls."""
    odd = {0: 0.0, 1: -0.0, 2: float("nan"), 3: None, 4: float("inf"), 5: -float("inf")}
    rows = [(k, odd.get(k % 12, float(k * 37 % 19)), None if k % 11 == 0 else k * 7 % 9, k % 4 if k % 13 else None) for k in range(n)]
    return spark.createDataFrame(rows, "_id long, x double, v long, g int")


@pytest.mark.parametrize("cut", [False, True])
def test_ordered_reads_equal_pairs(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(O, "PART_ROWS", 10)
        monkeypatch.setattr(O, "PARTS", 5)
    rows = odd_rows(spark).persist()
    key = lambda r: repr([x + 0.0 if isinstance(x, float) else x for x in r])  # both zeros are one
    for k, (where, fold) in enumerate(CONDITIONS[cut::2]):
        for by in ((), ("g",))[k % 2 :][:1]:
            assert O.read_ordered(rows, rows, by, fold, where, kept=rows.columns) is not None
            got = sorted(S.read_all(rows, rows, fold, where, {"s": -1}, by).collect(), key=key)
            with monkeypatch.context() as m:
                m.setattr(S, "read_ordered", lambda *_, **__: None)
                want = sorted(S.read_all(rows, rows, fold, where, {"s": -1}, by).collect(), key=key)
            assert list(map(key, got)) == list(map(key, want)), (where, by)


@pytest.mark.parametrize("most", [8, 30])
@pytest.mark.parametrize("where", ["m.x > a.x AND m._id <> a._id", "m.x <= a.x AND m.g = a.g AND m._id % 5 <> a._id % 5"])
def test_ordered_reads_cut_only_large_groups(spark, monkeypatch, most, where):
    """Cuts for all messages, and for those that an inequality takes out only where these are many."""
    monkeypatch.setattr(O, "PART_ROWS", most)
    monkeypatch.setattr(O, "PARTS", 5)
    cut, along = [], O.along
    monkeypatch.setattr(O, "along", lambda *x: cut.append(bool(x[-1])) or along(*x))
    rows = odd_rows(spark)
    key = lambda r: repr([x + 0.0 if isinstance(x, float) else x for x in r])
    got = sorted(map(key, S.read_all(rows, rows, FOLD, where).collect()))
    assert cut == [True, "%" in where and most == 8]
    monkeypatch.setattr(S, "read_ordered", lambda *_, **__: None)
    assert got == sorted(map(key, S.read_all(rows, rows, FOLD, where).collect()))


def test_small_groups_are_read_in_one_pass(spark, data):
    """Readers stand in the order among the messages: no join back, and no cuts where groups fit one task."""
    plan = catalogue.QUERIES["brute_theta"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan and "_o_part" not in plan


def test_ordered_reads_of_key_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "PART_ROWS", 10)
    rows = odd_rows(spark)
    key = lambda r: repr([x + 0.0 if isinstance(x, float) else x for x in r])
    read = lambda parts: sorted(map(key, S.read_bucket_range(rows, rows, "g - 1", "g + 1", "g", ENDS, "m.x > a.x", parts=parts).collect()))
    got = read(3)
    monkeypatch.setattr(S, "read_ordered", lambda *_, **__: None)
    assert got == read(3) == read(1)


def test_conditions_of_another_form_stay_pairs(spark):
    rows = odd_rows(spark, 12)
    for where in ("m.x > a.x OR m._id = a._id", "m.x > a.x AND m.v < a.v", "m.x + a.x > 3", "m.x BETWEEN a.x AND a.v", "m.v <> a.v AND m.g <> a.g", "m.x > a.x AND v > 3", "m.x > a.x + rand()"):
        assert O.read_ordered(rows, rows, [], FOLD, where, kept=rows.columns) is None, where
    for fold in ({"n": "count(DISTINCT m.v)"}, {"n": "sum(m.v - a.v)"}, {"n": "avg(m.v)"}, {"n": "count(m.v) + count(m.x)"}):
        assert O.read_ordered(rows, rows, [], fold, "m.x > a.x", kept=rows.columns) is None, fold
    assert O.read_ordered(rows, rows, [], ENDS, "m.v <> a.v", kept=rows.columns) is None  # the least of all but some is no difference


@pytest.mark.parametrize("name", ["brute_pairs", "brute_theta", "bucket_range_hot"])
def test_no_pairs_are_made(spark, data, name):
    """As rows of joins: at most a few for each reader and key."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not [x for x in plan.splitlines() if "Join" in x and (" > " in x or " < " in x)]


def test_graphs_are_read_line_by_line(spark, tmp_path):
    """One valid document, a line for each row; other documents are read as before, and a line that is no row fails."""
    nan = float("nan")
    v = spark.createDataFrame([(1, 0.5, 'a\n,{"id":1}', [1.0, nan]), (2, nan, None, None)], "id long, w double, t string, p array<double>")
    e = spark.range(500).selectExpr("1 + id % 2 AS source", "id AS dest", "-id AS c").repartition(7)
    path = tmp_path / "g.json"
    IO.export_graph(Graph(v, e), str(path))
    held = json.loads(path.read_text())
    assert held["nodes"] == [{"id": "1", "w": 0.5, "t": 'a\n,{"id":1}', "p": [1.0, None]}, {"id": "2", "w": None, "t": None, "p": None}]
    assert [(int(x["source"]), int(x["target"]), x["c"]) for x in held["links"]] == sorted(map(tuple, e.collect()))
    kinds = {"w": Variable("w")}, {"c": Variable("c", "int64")}
    back = IO.import_graph(spark, str(path), *kinds)
    assert "Generate" not in back.edges._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, e.collect())) and [r.w for r in back.vertices.orderBy("id").collect()] == [0.5, None]
    for indent in (None, 1):
        other = tmp_path / f"other{indent}.json"
        other.write_text(json.dumps(held, indent=indent))
        assert sorted(map(tuple, IO.import_graph(spark, str(other), *kinds).edges.collect())) == sorted(map(tuple, e.collect()))
    IO.export_graph(Graph(v.limit(0), e.limit(0)), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"nodes": [], "links": []} and not IO.import_graph(spark, str(tmp_path / "none.json"), *kinds).edges.head(1)
    broken = tmp_path / "broken.json"
    broken.write_text(path.read_text().replace(',{"source":"2","target":"7"', '{,"source":"2","target":"7"'))
    with pytest.raises(Exception, match="not a row of a graph"):
        IO.import_graph(spark, str(broken), *kinds).edges.collect()
