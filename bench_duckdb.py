"""Times the SQL of the same queries in DuckDB, for comparison with ``bench.py``: one JSON line."""

import glob
import importlib.util
import json
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


def main() -> None:
    from bench import ENGINE

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(HERE, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    sql = entry.oracle_sql()
    con = duckdb.connect()
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    took = {}
    for n in [*ENGINE, *sorted(k for k in sql if k.startswith("op") and k != "op5_sharding")]:  # checksums byte by byte in SQL are no measure
        if n in sql:
            began = time.perf_counter()
            con.execute(sql[n]).fetchall()
            took[n] = round(time.perf_counter() - began, 3)
            print(n, took[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds_duckdb", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took}))


if __name__ == "__main__":
    main()
