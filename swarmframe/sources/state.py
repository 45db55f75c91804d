"""States, graphs, macro properties and logs on disk.

Parquet directories are the form for large populations: written and read by the
executors. JSON and XML are for interchange: one document, written row by row,
read by Spark under the model's schema. JSON has no NaN or infinity; both are
written as null and come back as NaN.
"""

from __future__ import annotations

import decimal
import json
import math
import os
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StateIOError
from ..model import Model
from ..operators import macros as M
from ..operators.graphs import Graph
from ..operators.population import ID
from ..functions.rng import HostRandom
from ..plans.world import checkpoint_root, macro_schema, World
from ..types import FLOATS, Variable

#: How a value of each type is packed.
BINARY = {"float": "f", "double": "d", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "char": "b", "uchar": "B", "int": "i", "uint": "I", "id": "q", "enum": "i"}
PARTS = ("config", "environment", "macro_environment", "agents")


def suffix_of(path: str, known: Sequence[str]) -> str:
    found = os.path.splitext(path)[1].lower()
    if found not in known:
        raise StateIOError(f"{path}: expected one of {', '.join(known)}")
    return found


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value)
    """A value as JSON can hold it."""
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int | float):
        return int(value)
    return value


def restored(value, v: Variable):
    if v.length:
        return [restored(x, Variable(v.name, v.kind)) for x in value]
    return math.nan if value is None and v.kind in FLOATS else value


# ---- whole states -----------------------------------------------------------------


def config_of(world: World) -> dict:
    return {"steps": world.step_count, "random_seed": world.seed, "run_id": world.run_id} | {f"next_{a}": world.fresh_id(a) for a in world.model.agents}


def export_state(world: World, path: str, pretty: bool = False) -> None:
    """By suffix: .json or .xml, else a Parquet directory for each agent and state."""
    if os.path.splitext(path)[1].lower() not in (".json", ".xml"):
        export_parquet(world, path)
    elif suffix_of(path, (".json", ".xml")) == ".json":
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(json_parts(world, pretty))
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(xml_parts(world, pretty))


def export_parquet(world: World, path: str) -> None:
    for (agent, state), rows in world.populations.items():
        rows.write.mode("overwrite").parquet(f"{path}/agents/{agent}/{state}")
    for name, held in world.macros.items():
        held.write.mode("overwrite").parquet(f"{path}/macro/{name}")
    meta = json.dumps({"config": config_of(world), "environment": {k: plain(v) for k, v in world.env.items()}})
    world.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def json_parts(world: World, pretty: bool) -> Iterator[str]:
    gap = "\n" if pretty else ""
    head = {"config": config_of(world), "stats": {"step_count": world.step_count}, "environment": {k: plain(v) for k, v in world.env.items()}}
    yield json.dumps(head, indent=1 if pretty else None)[:-1].rstrip() + f',{gap}"macro_environment": {{'
    for k, (name, held) in enumerate(world.macros.items()):
        values = [plain(r["value"]) for r in M.dense_macro(held, world.model.environment.macros[name][1]).orderBy(*M.AXES).toLocalIterator()]
        yield f"{',' if k else ''}{json.dumps(name)}: {json.dumps(values)}"
    yield f'}},{gap}"agents": {{'
    for k, agent in enumerate(world.model.agents.values()):
        yield f"{',' if k else ''}{gap}{json.dumps(agent.name)}: {{"
        for j, state in enumerate(agent.all_states):
            yield f"{',' if j else ''}{gap}{json.dumps(state)}: ["
            for i, row in enumerate(world.populations[(agent.name, state)].orderBy(ID).toLocalIterator()):
                yield f"{',' if i else ''}{gap}{json.dumps({n: plain(v) for n, v in row.asDict().items()})}"
            yield "]"
        yield "}"
    yield "}}" + gap


def xml_text(value) -> str:
    return ",".join(map(xml_text, value)) if isinstance(value, list | tuple) else escape(repr(value) if isinstance(value, float) else str(value))


def xml_parts(world: World, pretty: bool) -> Iterator[str]:
    gap = "\n" if pretty else ""
    element = lambda name, value: f"<{name}>{xml_text(value)}</{name}>"
    yield f"<states>{gap}<itno>{world.step_count}</itno>{gap}<config>"
    yield "".join(element(k, v) for k, v in config_of(world).items()) + f"</config>{gap}<environment>"
    yield "".join(element(k, v) for k, v in world.env.items()) + f"</environment>{gap}<macro_environment>"
    for name, held in world.macros.items():
        yield element(name, [r["value"] for r in M.dense_macro(held, world.model.environment.macros[name][1]).orderBy(*M.AXES).toLocalIterator()])
    yield f"</macro_environment>{gap}"
    for (agent, state), rows in world.populations.items():
        for row in rows.orderBy(ID).toLocalIterator():
            yield f"<xagent>{element('name', agent)}{element('state', state)}{''.join(element(k, v) for k, v in row.asDict().items())}</xagent>{gap}"
    yield f"</states>{gap}"


def import_state(world: World, path: str, parts: Sequence[str] = PARTS) -> World:
    """Restores a world, or only some of config, environment, macro_environment and agents."""
    if unknown := set(parts) - set(PARTS):
        raise StateIOError(f"unknown parts {sorted(unknown)}")
    ending = os.path.splitext(path)[1].lower()
    {".json": import_json, ".xml": import_xml}.get(ending, import_parquet)(world, path, parts)
    return world


def restore_meta(world: World, config: dict, env: dict, parts: Sequence[str]) -> None:
    if "config" in parts:
        world.step_count, world.seed = int(config.get("steps", 0)), int(config.get("random_seed", 0))
        world.random = HostRandom(world.seed)
        for agent in world.model.agents:
            world.next_ids[agent] = max(world.next_ids[agent], int(config.get(f"next_{agent}", 1)))
    if "environment" in parts:
        for name, value in env.items():
            p = world.model.environment.properties.get(name)
            if p is None:
                raise StateIOError(f"the model has no property {name}")
            world.env[name] = restored(value, Variable(name, p.kind, p.length))


def population_schema(model: Model, agent: str) -> T.StructType:
    return T.StructType([T.StructField(ID, T.LongType()), *[v.field() for v in model.agents[agent].variables.values()]])


def nan_for_null(rows: DataFrame, variables) -> DataFrame:
    swap = {}
    for v in variables:
        if v.kind in FLOATS:
            nan = F.lit(math.nan).cast(Variable(v.name, v.kind).spark_type)
            swap[v.name] = F.transform(v.name, lambda x, nan=nan: F.coalesce(x, nan)) if v.length else F.coalesce(v.name, nan)
    return rows.withColumns(swap) if swap else rows


def import_parquet(world: World, path: str, parts: Sequence[str]) -> None:
    meta = json.loads(world.spark.read.text(f"{path}/meta").first()["value"])
    restore_meta(world, meta["config"], meta["environment"], parts)
    if "agents" in parts:
        for agent, state in world.populations:
            world.populations[(agent, state)] = world.spark.read.schema(population_schema(world.model, agent)).parquet(f"{path}/agents/{agent}/{state}")
    if "macro_environment" in parts:
        for name in world.macros:
            world.macros[name] = world.spark.read.schema(macro_schema(world.model.environment.macros[name][0])).parquet(f"{path}/macro/{name}")


def import_json(world: World, path: str, parts: Sequence[str]) -> None:
    agents = [T.StructField(a.name, T.StructType([T.StructField(s, T.ArrayType(population_schema(world.model, a.name))) for s in a.all_states])) for a in world.model.agents.values()]
    env = [T.StructField(p.name, Variable(p.name, p.kind, p.length).spark_type) for p in world.model.environment.properties.values()]
    macro = [T.StructField(m, T.ArrayType(Variable(m, kind).spark_type)) for m, (kind, _) in world.model.environment.macros.items()]
    schema = T.StructType([T.StructField("config", T.MapType(T.StringType(), T.LongType())), T.StructField("environment", T.StructType(env)), T.StructField("macro_environment", T.StructType(macro)), T.StructField("agents", T.StructType(agents))])
    document = world.spark.read.schema(schema).json(path, multiLine=True)
    head = document.select("config", "environment", "macro_environment").first().asDict(recursive=True)
    restore_meta(world, head["config"] or {}, head["environment"] or {}, parts)
    if "macro_environment" in parts:
        for name in world.macros:
            world.macros[name] = sparse(world.spark, (head["macro_environment"] or {}).get(name) or [], world.model.environment.macros[name])
    if "agents" in parts:
        for agent, state in world.populations:
            rows = document.select(F.explode(f"agents.{agent}.{state}").alias("r")).select("r.*")
            world.populations[(agent, state)] = nan_for_null(rows, world.model.agents[agent].variables.values())


def import_xml(world: World, path: str, parts: Sequence[str]) -> None:
    config, env, macro = {}, {}, {}
    for _, node in ET.iterparse(path):  # rows are dropped as they pass; only the small parts are kept
        if node.tag == "config":
            config = {x.tag: x.text for x in node}
        elif node.tag == "environment":
            env = {x.tag: x.text for x in node}
        elif node.tag == "macro_environment":
            macro = {x.tag: [v for v in (x.text or "").split(",") if v] for x in node}
        elif node.tag == "xagent":
            node.clear()
    typed = {}
    for name, text in env.items():
        p = world.model.environment.properties.get(name)
        one = float if p is None or p.kind in FLOATS else int
        typed[name] = [one(v) for v in text.split(",")] if p is not None and p.length else one(text)
    restore_meta(world, config, typed, parts)
    if "macro_environment" in parts:
        for name in world.macros:
            world.macros[name] = sparse(world.spark, macro.get(name, []), world.model.environment.macros[name])
    if "agents" in parts:
        for agent, state in world.populations:
            variables = world.model.agents[agent].variables.values()
            text = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "state", ID, *[v.name for v in variables if v.name not in ("name", "state")])])
            rows = world.spark.read.format("xml").option("rowTag", "xagent").schema(text).load(path).where((F.col("name") == agent) & (F.col("state") == state))
            value = lambda v: F.split(v.name, ",").cast(v.spark_type) if v.length else F.col(v.name).cast(v.spark_type)
            world.populations[(agent, state)] = rows.select(F.col(ID).cast("long").alias(ID), *[value(v).alias(v.name) for v in variables])


# ---- macro properties -------------------------------------------------------------


def number(value, kind: str):
    """A cell of this type, as Spark takes it."""
    if kind in FLOATS:
        return math.nan if value is None else float(value)
    return decimal.Decimal(int(value)) if kind == "uint64" else int(value)


def sparse(spark: SparkSession, values: Sequence, spec: tuple[str, Sequence[int]]) -> DataFrame:
    """Cells that are not 0, from values in row-major order; ``spec`` is type and dimensions."""
    kind, size = spec
    values = [number(v, kind) for v in values]
    full = (*size, *(1,) * (4 - len(size)))
    if values and len(values) != full[0] * full[1] * full[2] * full[3]:
        raise StateIOError(f"{len(values)} values for dimensions {full}")
    rows = []
    for at, v in enumerate(values):
        if v:
            rest, index = at, []
            for n in full[::-1]:
                rest, r = divmod(rest, n)
                index.insert(0, r)
            rows.append((*index, v))
    return spark.createDataFrame(rows, macro_schema(kind))


def export_macro(world: World, name: str, path: str, pretty: bool = False) -> None:
    """.json, .xml, or .bin (little-endian values of the property's type in row-major order)."""
    kind = world.model.environment.macros[name][0]
    ending = suffix_of(path, (".json", ".xml", ".bin"))
    rows = M.dense_macro(world.macros[name], world.model.environment.macros[name][1]).orderBy(*M.AXES).toLocalIterator()
    values = [float(r["value"]) if kind in FLOATS else int(r["value"]) for r in rows]
    if ending == ".bin":
        with open(path, "wb") as f:
            f.write(struct.pack(f"<{len(values)}{BINARY[kind]}", *values))
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps({name: values}, indent=1 if pretty else None) if ending == ".json" else f"<macro_environment><{name}>{xml_text(values)}</{name}></macro_environment>")


def import_macro(world: World, name: str, path: str) -> None:
    ending = suffix_of(path, (".json", ".xml", ".bin"))
    raw = bytes(world.spark.read.format("binaryFile").load(path).first()["content"])
    if ending == ".bin":
        code = BINARY[world.model.environment.macros[name][0]]
        values = list(struct.unpack(f"<{len(raw) // struct.calcsize(code)}{code}", raw))
    elif ending == ".json":
        values = json.loads(raw)[name]
    else:
        values = ET.fromstring(raw).find(name).text.split(",")
    world.macros[name] = sparse(world.spark, values, world.model.environment.macros[name])


# ---- graphs -----------------------------------------------------------------------


def finite(column: Column, kind: T.DataType) -> Column:
    """Null for what JSON cannot hold, as ``plain`` does."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(column) & (F.abs(column) < math.inf), column)
    return F.transform(column, lambda x: finite(x, kind.elementType)) if isinstance(kind, T.ArrayType) else column


def export_graph(graph: Graph, path: str) -> None:
    """One JSON document: nodes with their id, links with source and target, all three as strings.

    Each row has a line of its own. Executors sort and write the lines in the
    cluster's folder; the driver only strings their files together, as bytes.
    """
    suffix_of(path, (".json",))
    spark = graph.vertices.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{checkpoint_root(spark)}/graph-{os.urandom(8).hex()}"
    at = hadoop.fs.Path(folder)
    files = at.getFileSystem(conf)
    target = hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for name, rows, keys, head in (("nodes", graph.vertices, {"id": "id"}, '{"nodes":[\n'), ("links", graph.edges, {"source": "source", "dest": "target"}, '],"links":[\n')):
            values = [F.col(k).cast("string").alias(v) for k, v in keys.items()]
            values += [finite(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in keys]
            lines = rows.orderBy(*keys).select(F.concat(F.lit(","), F.to_json(F.struct(*values), {"ignoreNullFields": "false"})).alias("value"))
            lines.write.text(f"{folder}/{name}")
            out.write(bytearray(head, "utf-8"))
            first = True
            for part in sorted((x for x in files.listStatus(hadoop.fs.Path(f"{folder}/{name}")) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda x: (len(x.getPath().getName()), x.getPath().getName())):
                read = files.open(part.getPath())
                read.seek(1 if first else 0)  # no comma before the first row
                hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
                read.close()
                first = False
        out.write(bytearray("]}\n", "utf-8"))
    finally:
        out.close()
        files.delete(at, True)


def import_graph(spark: SparkSession, path: str, vertices: dict[str, Variable], edges: dict[str, Variable]) -> Graph:
    """A document with a line for each row, as ``export_graph`` writes it, is read in splits; any other as one value."""
    suffix_of(path, (".json",))
    text = lambda n: T.StructField(n, T.StringType())
    node = T.StructType([text("id"), *[v.field() for v in vertices.values()]])
    link = T.StructType([text("source"), text("target"), *[v.field() for v in edges.values()]])
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.head(2)]
    if len(head) == 2 and head[0] == '{"nodes":[' and head[1].startswith(('{"id":', '],"links":[')):
        row = F.when(F.col("value").startswith(","), F.expr("substring(value, 2)")).otherwise(F.col("value"))
        bad = F.raise_error(F.concat(F.lit("not a row of a graph: "), F.substring("value", 1, 80))).cast("boolean")
        kind = lambda begin: F.when(row.startswith(begin), F.lit(True)).when(row.startswith('{"id":') | row.startswith('{"source":') | F.col("value").isin('{"nodes":[', '],"links":[', "]}"), F.lit(False)).otherwise(bad)
        taken = lambda begin, schema: lines.where(kind(begin)).select(F.from_json(row, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        v, e = taken('{"id":', node), taken('{"source":', link)
    else:
        schema = T.StructType([T.StructField("nodes", T.ArrayType(node)), T.StructField("links", T.ArrayType(link))])
        document = spark.read.schema(schema).json(path, multiLine=True)
        v = document.select(F.explode("nodes").alias("r")).select("r.*")
        e = document.select(F.explode("links").alias("r")).select("r.*")
    v = v.withColumn("id", F.col("id").cast("long"))
    e = e.withColumns({"source": F.col("source").cast("long"), "target": F.col("target").cast("long")}).withColumnRenamed("target", "dest")
    return Graph(v, e)


# ---- logs -------------------------------------------------------------------------


def log_frame(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """(step, name, value) of log rows."""
    flat = [(r["step"], k, float(v)) for r in rows for k, v in r.items() if k != "step" and isinstance(v, int | float)]
    return spark.createDataFrame(flat, "step long, name string, value double")


def export_log(world: World, path: str, steps: bool = True, exit_: bool = True, pretty: bool = False) -> None:
    """.json or .xml: configuration, step rows and the exit row."""
    ending = suffix_of(path, (".json", ".xml"))
    content = {"config": config_of(world)} | ({"steps": world.log} if steps else {}) | ({"exit": world.exit_log} if exit_ and world.exit_log else {})
    with open(path, "w", encoding="utf-8") as f:
        if ending == ".json":
            json.dump(content, f, indent=1 if pretty else None, default=plain)
        else:
            item = lambda row: "".join(f'<value name="{escape(k)}">{xml_text(v)}</value>' for k, v in row.items())
            parts = [f"<config>{item(content['config'])}</config>", *(f"<step>{item(r)}</step>" for r in content.get("steps", []))]
            f.write("<log>" + "".join(parts) + (f"<exit>{item(content['exit'])}</exit>" if "exit" in content else "") + "</log>")
