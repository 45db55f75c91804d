"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from swarmframe.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    names = sorted(df.columns)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == names
    key = lambda row: tuple((v is None, v) for v in row)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(want.select(*[f'"{c}"' for c in names]).fetchall(), key=key)


def test_diffusion_matches_loops(spark, data):
    from swarmframe.plans.catalogue import WIDTH, customers

    rows = customers(spark, data).collect()
    high = len(rows) // WIDTH
    heat = {(r.ix, r.iy): r.bal for r in rows}
    for _ in range(3):
        heat = {(x, y): v + 0.1 * (sum(heat[(x + a) % WIDTH, (y + b) % high] for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))) - 4 * v) for (x, y), v in heat.items()}
    got = {r["_id"]: r["value"] for r in catalogue.QUERIES["diffusion_3"](spark, data).collect()}
    for r in rows:
        assert math.isclose(got[r["_id"]], heat[(r.ix, r.iy)], rel_tol=1e-6, abs_tol=1e-4)


def test_random_draws(spark):
    from pyspark.sql import functions as F

    from swarmframe.functions.rng import AgentRandom, HostRandom

    r = AgentRandom(7, 2, "f")
    rows = spark.range(20_000).withColumnRenamed("id", "_id").select("_id", r.uniform().alias("u"), r.uniform_int(1, 6, 1).alias("d"), r.normal().alias("z"), r.poisson(4.0, 2).alias("p"), r.log_normal(0, 0.5).alias("l"))
    got = rows.agg(*[f(c).alias(f"{n}_{c}") for c in "udzpl" for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    assert abs(got.m_u - 0.5) < 0.01 and 0 <= got.lo_u and got.hi_u < 1
    assert (got.lo_d, got.hi_d) == (1, 6) and abs(got.m_d - 3.5) < 0.05
    assert abs(got.m_z) < 0.03 and abs(got.s_z - 1) < 0.03
    assert abs(got.m_p - 4) < 0.06 and abs(got.s_p - 2) < 0.06
    assert abs(got.m_l - math.exp(0.125)) < 0.03
    assert rows.collect() == rows.repartition(3).orderBy("_id").collect()
    h = HostRandom(3)
    first = [h.uniform(), h.uniform(1, 6), h.uniform(0.0, 2.0), h.normal(), h.log_normal(0, 1), h.poisson(3)]
    h.set_seed(3)
    assert first == [h.uniform(), h.uniform(1, 6), h.uniform(0.0, 2.0), h.normal(), h.log_normal(0, 1), h.poisson(3)] and h.get_seed() == 3


def test_sorted_populations_are_in_order(spark, data):
    from swarmframe.operators import reductions as R
    from swarmframe.plans.catalogue import orders

    rows = orders(spark, data)
    for keys in ((("price", "asc"),), (("price", "desc"),), (("yr", "desc"), ("price", "asc"))):
        got = [r["_id"] for r in R.sort_population(rows, *keys).collect()]
        sign = [1 if w == "asc" else -1 for _, w in keys]
        want = sorted(rows.collect(), key=lambda r: ([s * r[k] for s, (k, _) in zip(sign, keys, strict=True)], r["_id"]))
        assert got == [r["_id"] for r in want]
        placed = {r["_id"]: r["_place"] for r in R.place_in_order(rows, *keys, parts=7).collect()}
        assert placed == {k: i + 1 for i, k in enumerate(got)}
