"""A world: the frames of every population, message list and property at one step.

``World.step`` composes lazy frames layer by layer; each layer reads one
snapshot. Lineage is cut by written tables in the folder the cluster names, as
every agent table is read by both sides of a join and plans would double.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EnvironmentError_, ModelError, StateIOError
from ..functions.rng import HostRandom
from ..model import Function, Layer, MacroUpdate, Model, SubModel
from ..operators import macros as M
from ..operators import population as P
from ..operators import shapes as S
from ..operators.graphs import Graph
from ..operators.reductions import Reduce, histogram_even, reduce_many, sort_by_place, sort_population
from ..operators.vectors import AgentVector
from ..types import Variable


def macro_schema(kind: str) -> T.StructType:
    """Cells of a macro property of this type."""
    return T.StructType([*[T.StructField(a, T.IntegerType()) for a in M.AXES], T.StructField("value", Variable("value", kind).spark_type)])


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where it names none and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise StateIOError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="swarmframe-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def before_of(populations: dict, agent: str) -> list[DataFrame]:
    return [p for (a, _), p in populations.items() if a == agent]


@dataclass
class StepLog:
    """What to log of populations and environment, and how often."""

    reductions: dict[tuple[str, str], list[Reduce]] = field(default_factory=dict)
    properties: list[str] = field(default_factory=list)
    frequency: int = 1
    timing: bool = False


class World:
    """A running model. Host functions get it as their only argument."""

    by: tuple[str, ...] = ()  # columns that part agents and messages into runs, for a world of many of them

    def __init__(self, spark: SparkSession, model: Model, seed: int = 0, run_id: int = 0, checkpoint_every: int = 1):
        self.spark, self.model, self.seed, self.run_id = spark, model.validate(), seed, run_id
        self.checkpoint_every = checkpoint_every
        self._folder = f"{checkpoint_root(spark)}/world-{uuid.uuid4().hex}"
        self._saves = 0
        self._tables: list[str] = []
        self._host_born: set[str] = set()
        self._old: list[str] = []
        self._closing: list[World] = []
        atexit.register(self.drop_tables)
        self.log: list[dict] = []
        self.exit_log: dict | None = None
        self.times: dict[str, float] = {}
        self.reset()

    # ---- state ------------------------------------------------------------

    def reset(self) -> None:
        """As declared: no agents, no messages, properties at their values."""
        self.step_count = 0
        self.random = HostRandom(self.seed)
        self.graphs: dict[str, Graph] = {}
        self.next_ids = dict.fromkeys(self.model.agents, 1)  # ids are given once, also where agents have died
        self.env = {p.name: p.value for p in self.model.environment.properties.values()}
        self.populations = {(a.name, s): self._empty(a.variables.values()) for a in self.model.agents.values() for s in a.all_states}
        self.messages: dict[str, DataFrame | None] = dict.fromkeys(self.model.messages)
        self.macros = {m: self.spark.createDataFrame([], macro_schema(kind)) for m, (kind, _) in self.model.environment.macros.items()}
        self.log, self.exit_log = [], None

    def _empty(self, variables) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*[T.StructField(c, T.LongType()) for c in (*self.by, P.ID)], *[v.field() for v in variables]]))

    def _state(self, agent: str, state: str | None) -> str:
        if agent not in self.model.agents:
            raise ModelError(f"unknown agent {agent}")
        state = state or self.model.agents[agent].first_state
        if (agent, state) not in self.populations:
            raise ModelError(f"{agent}: unknown state {state}")
        return state

    def set_population(self, agent: str, rows: DataFrame, state: str | None = None, order: str | None = None) -> None:
        """A population from a frame: variables it lacks take their defaults; with ``order``, unset ids are filled."""
        variables = self.model.agents[agent].variables.values()
        named = rows.columns
        id_column = F.col(P.ID).cast("long") if P.ID in named else F.lit(0).cast("long")
        keep = [order] if order and order not in [P.ID, *[v.name for v in variables]] else []
        out = rows.select(*self.by, id_column.alias(P.ID), *[(F.col(v.name).cast(v.spark_type) if v.name in named else v.literal()).alias(v.name) for v in variables], *keep)
        self.fresh_id(agent)
        if order:
            out = P.assign_ids(out, order, self.next_ids[agent]).drop(*keep)
        self.populations[(agent, self._state(agent, state))] = out

    def fresh_id(self, agent: str, *others: DataFrame) -> int:
        """The next id of an agent type: above all that are or were in use, and above those of ``others``."""
        if self._breeds(agent):
            held = [p for (a, _), p in self.populations.items() if a == agent]
            self.next_ids[agent] = max(self.next_ids[agent], P.next_id(*held, *others))
        return self.next_ids[agent]

    def _breeds(self, agent: str) -> bool:
        """Whether agents of the type can be born at all; else no ids need be remembered."""
        m = self.model
        on_host = m.init or m.step or m.exit or m.exit_conditions or any(x.host for x in m.layers)
        return bool(on_host or any(f.birth and f.birth.agent == agent for f in m.functions()) or m.agents[agent].name in self._host_born)

    def population(self, agent: str, state: str | None = None) -> DataFrame:
        return self.populations[(agent, self._state(agent, state))]

    def all_states(self, agent: str) -> DataFrame:
        """Every agent of a type, with its ``_state``."""
        parts = [self.populations[(agent, s)].withColumn("_state", F.lit(s)) for s in self.model.agents[agent].all_states]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def new_agents(self, agent: str, rows: Sequence[dict], state: str | None = None) -> None:
        """Agents born on the host."""
        key = (agent, self._state(agent, state))
        self._host_born.add(agent)
        first = self.fresh_id(agent)
        self.next_ids[agent] = first + len(rows)
        self.populations[key] = P.move(P.host_births(self.spark, list(self.model.agents[agent].variables.values()), rows, first), self.populations[key])

    # ---- environment --------------------------------------------------------

    def get(self, name: str):
        if name not in self.env:
            raise EnvironmentError_(f"unknown property {name}")
        return self.env[name]

    def set(self, name: str, value):
        """Sets a property and gives its old value."""
        old, p = self.get(name), self.model.environment.properties[name]
        if p.const:
            raise EnvironmentError_(f"property {name} is constant")
        self.env[name] = Variable(name, p.kind, p.length).check(value)
        return old

    def sql(self, expression, reader: str = ""):
        """SQL text with ``env.<name>`` as literals; ``reader`` is the reader's prefix in a read."""
        if not isinstance(expression, str):
            return expression

        def value(m: re.Match) -> str:
            name, at = m[1], m[2]
            v = {"_step": self.step_count, "_run": self.run_id, "_seed": self.seed}.get(name, self.env.get(name))
            if v is None:
                raise EnvironmentError_(f"unknown property {name}")
            text = lambda x: f"({x})" if isinstance(x, int) else f"double('{x!r}')"
            if isinstance(v, list):
                return text(v[int(at)]) if at is not None else f"array({', '.join(map(text, v))})"
            return text(v)

        return re.sub(r"\benv\.(\w+)(?:\[(\d+)\])?", value, expression)

    # ---- host reductions ----------------------------------------------------

    def reduce(self, agent: str, *asked: Reduce, state: str | None = None) -> dict[str, object]:
        return reduce_many(self.population(agent, state), *asked)

    def count(self, agent: str, state: str | None = None) -> int:
        return self.population(agent, state).count()

    def histogram(self, agent: str, variable: str, bins: int, low: float, high: float, state: str | None = None) -> list[int]:
        return [r["n"] for r in histogram_even(self.population(agent, state), variable, bins, low, high).orderBy("bin").collect()]

    def sort(self, agent: str, *keys: tuple[str, str], state: str | None = None) -> None:
        s = self._state(agent, state)
        self.populations[(agent, s)] = sort_population(self.populations[(agent, s)], *keys)

    # ---- running ------------------------------------------------------------

    def _read(self, f: Function, rows: DataFrame, messages: dict[str, DataFrame | None]) -> DataFrame:
        r = f.read
        fold = {k: self.sql(v, "a.") for k, v in r.fold.items()}
        where, zero, by = self.sql(r.where, "a."), r.defaults, self.by
        if r.macro is not None:
            return M.read_cells(rows, self.macros[r.macro], {k: self.sql(v) for k, v in r.index.items()}, next(iter(r.fold)))
        if r.graph is not None:
            return S.read_edges(rows, self.graphs[r.graph].edges, self.sql(r.key), fold, r.incoming, where, zero, r.parts)
        spec, near = self.model.messages[r.message], messages[r.message]
        if near is None:
            kinds = [*[T.StructField(c, T.LongType()) for c in by], *[v.field() for v in spec.variables.values()], *[T.StructField(k, T.DoubleType() if spec.shape == "space" else T.LongType()) for k in spec.keys]]
            near = self.spark.createDataFrame([], T.StructType(kinds))
        if spec.shape == "all":
            return S.read_all(rows, near, fold, where, zero, by)
        if spec.shape == "bucket":
            if r.range:
                return S.read_bucket_range(rows, near, self.sql(r.range[0]), self.sql(r.range[1]), "_key", fold, where, zero, r.parts, by)
            return S.read_bucket(rows, near, self.sql(r.key), "_key", fold, where, zero, r.parts, by)
        if spec.shape == "space":
            return S.read_space(rows, near, spec.space, fold, r.wrap, r.within, where, zero, r.parts, by)
        index = list(spec.keys)
        at = [self.sql(e) for e in r.at]
        if r.fold and all(re.fullmatch(r"m\.\w+", v) for v in fold.values()):  # plain values: an index join
            return S.read_at(rows, near, index, at, {k: v[2:] for k, v in fold.items()}, by=by)
        placed = rows.withColumns({c: F.expr(e) for c, e in zip(index, at, strict=True)})
        near = S.written_once(near, [*by, *index])
        return S.read_grid(placed, near, spec.size, index, fold, r.reach, r.wrap, r.neumann, where, zero, r.parts, by).drop(*index)

    def _layer(self, layer: Layer) -> None:
        if layer.host is not None:
            layer.host(self)
            return
        if layer.submodel is not None:
            self._submodel(layer.submodel)
            return
        before, sent = dict(self.populations), dict(self.messages)
        first_writes = self._unwritten
        newborn: list[tuple[tuple[str, str], DataFrame]] = []
        for f in layer.functions:
            agent = self.model.agents[f.agent]
            start, end = f.initial or agent.first_state, f.end or f.initial or agent.first_state
            rows = before[(f.agent, start)]
            own = rows.columns
            rows, condition = self._surrounded(rows), self._condition(f)
            rows, rest = P.split(rows, condition) if condition is not None else (rows, None)
            rest = rest.select(*own) if rest is not None else None
            if f.read:
                rows = self._read(f, rows, sent)
            rows = P.set_variables(rows, {k: self.sql(v) for k, v in f.set.items()})
            if f.emit:
                self._emit(f, rows, first_writes)
            if f.macro:
                rows = self._update_macro(f.macro, rows)
            if f.birth:
                b = f.birth
                first = self.fresh_id(b.agent, *[p for p in before_of(before, b.agent)], *[p for (a, _), p in newborn if a == b.agent])
                child = P.births(rows, list(self.model.agents[b.agent].variables.values()), {k: self.sql(v) for k, v in b.values.items()}, self.sql(b.when), first)
                newborn.append(((b.agent, b.state or self.model.agents[b.agent].first_state), child))
            if f.alive is not None:
                self.fresh_id(f.agent)
                rows = P.bury(rows, self.sql(f.alive), f.allow_death)
            rows = rows.select(*own)
            if start == end:
                self.populations[(f.agent, start)] = P.move(rest, rows) if rest is not None else rows
            else:
                self.populations[(f.agent, start)] = rest if rest is not None else rows.where(F.lit(False))
                self.populations[(f.agent, end)] = P.move(rows, self.populations[(f.agent, end)])
        for key, child in newborn:
            self.populations[key] = P.move(child, self.populations[key])

    def _surrounded(self, rows: DataFrame) -> DataFrame:
        """Agents with what expressions see besides their variables."""
        return rows

    def _condition(self, f: Function):
        return None if f.condition is None else self.sql(f.condition)

    def _update_macro(self, u: MacroUpdate, rows: DataFrame) -> DataFrame:
        """Updates the property; the rows, with what they found if that is asked for."""
        kind, size = self.model.environment.macros[u.macro]
        spark_type = Variable("value", kind).spark_type
        held = self.macros[u.macro]
        cells = M.cells_of(rows, {k: self.sql(v) for k, v in u.index.items()}, self.sql(u.value), (P.ID,) if u.expected is None else (P.ID, F.expr(self.sql(u.expected)).alias("expected")))
        cells = M.checked(cells.withColumn("value", F.col("value").cast(spark_type)), size)
        found = None
        if u.how == "exchange":
            new, found = M.exchange(held, cells), M.exchange_results(held, cells)
        elif u.how == "swap":
            new, found = M.compare_and_swap(held, cells), M.swap_results(held, cells)
        elif u.how == "add" and u.result:
            new, found = M.add_with_results(held, cells)
        else:
            new = M.update(held, cells.drop(P.ID), {"increment": "add", "decrement": "subtract"}.get(u.how, u.how))
        value = F.col("value")
        if u.how in ("increment", "decrement"):
            value = F.pmod(value.cast("decimal(38,0)"), F.lit(2**32).cast("decimal(38,0)"))
        self.macros[u.macro] = new.withColumn("value", value.cast(spark_type))
        if not u.result:
            return rows
        kept = rows.columns
        out = rows.join(found.select(P.ID, F.col("old").cast(rows.schema[u.result].dataType).alias("_old")), P.ID, "left")
        return out.withColumn(u.result, F.col("_old")).select(*kept)

    def _emit(self, f: Function, rows: DataFrame, first_writes: set[str]) -> None:
        spec = self.model.messages[f.emit.message]
        senders = P.split(rows, self.sql(f.emit.when))[0] if f.emit.when is not None else rows
        values = {k: self.sql(v) for k, v in f.emit.values.items()}
        kinds = {v.name: v.spark_type for v in spec.variables.values()} | {k: T.DoubleType() if spec.shape == "space" else T.LongType() for k in spec.keys}
        made = senders.select(*self.by, *[(S.as_column(values[k]).cast(kind) if k in values else spec.variables[k].literal()).alias(k) for k, kind in kinds.items()])
        if spec.shape == "bucket":
            made = S.check_keys(made, "_key", *spec.bounds)
        if spec.shape == "grid":
            made = S.check_index(made, spec.keys, spec.size)
        old = self.messages[spec.name]
        if spec.name in first_writes or old is None:  # the first writer of a step replaces, later ones append
            first_writes.discard(spec.name)
            self.messages[spec.name] = made
        else:
            self.messages[spec.name] = old.unionByName(made)

    def _submodel(self, sub: SubModel) -> None:
        """Mapped populations and properties go in under their own names, run, and come back."""
        inner = World(self.spark, sub.model, self.seed, self.run_id, self.checkpoint_every)
        inner.random = self.random
        for own, outer in sub.agents.items():
            names = sub.variables.get(own, {})
            for a, b in (sub.states.get(own) or {inner.model.agents[own].first_state: self.model.agents[outer].first_state}).items():
                inner.set_population(own, self.populations[(outer, b)].select(P.ID, *[F.col(y).alias(x) for x, y in names.items()]), a)
        for a, b in sub.properties.items():
            inner.env[a] = self.env[b]
        inner.simulate(sub.max_steps)
        for own, outer in sub.agents.items():
            names = sub.variables.get(own, {})
            kept = [v for v in self.model.agents[outer].variables.values() if v.name not in names.values()]
            for a, b in (sub.states.get(own) or {inner.model.agents[own].first_state: self.model.agents[outer].first_state}).items():
                back = inner.populations[(own, a)].select(P.ID, *[F.col(x).alias(y) for x, y in names.items()])
                was = self.all_states(outer).select(P.ID, *[F.col(v.name).alias(f"_was_{v.name}") for v in kept])
                joined = back.join(was, P.ID, "left")
                self.populations[(outer, b)] = joined.select(P.ID, *[(F.coalesce(f"_was_{v.name}", v.literal()) if v in kept else F.col(v.name)).alias(v.name) for v in self.model.agents[outer].variables.values()])
        self._closing.append(inner)  # its tables are read until this world has written its own
        for a, b in sub.properties.items():
            if not self.model.environment.properties[b].const:
                self.env[b] = inner.env[a]

    def step(self) -> bool:
        """One step; True if an exit condition asks to stop."""
        began = time.perf_counter()
        self._unwritten = set(self.messages)
        for layer in self.model.layers:
            self._layer(layer)
        self.step_count += 1
        if self.checkpoint_every and self.step_count % self.checkpoint_every == 0:
            self.cut_lineage()
        for f in self.model.step:
            f(self)
        done = any([bool(c(self)) for c in self.model.exit_conditions])
        for name, spec in self.model.messages.items():
            if not spec.persistent:
                self.messages[name] = None
        self.times[f"step {self.step_count}"] = time.perf_counter() - began
        return done

    def cut_lineage(self) -> None:
        """Writes every frame that will be read again as a table of the shared folder.

        Tables of the cut before this one are dropped, and inner worlds closed:
        a frame that was taken from a world can be read for one step after.
        """
        before, self._tables = self._tables, []

        def saved(df: DataFrame) -> DataFrame:
            self._saves += 1
            path = f"{self._folder}/{self._saves}"
            self._tables.append(path)
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        self.populations = {k: saved(self._laid_out(k[0], p)) for k, p in self.populations.items()}
        self.macros = {k: saved(p) for k, p in self.macros.items()}
        self.messages = {k: saved(m) if m is not None and self.model.messages[k].persistent else m for k, m in self.messages.items()}
        for path in self._old:
            self._delete(path)
        self._old = before
        for inner in self._closing:
            inner.close()
        self._closing = []

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Drops its tables and forgets them; also at the end of a ``with`` block."""
        self.drop_tables()
        atexit.unregister(self.drop_tables)

    def __enter__(self) -> World:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _laid_out(self, agent: str, rows: DataFrame) -> DataFrame:
        """Agents of a space beside their neighbours, every ``sort_period`` steps: a matter of layout only."""
        spec = self.model.agents[agent]
        if not spec.sort_period or self.step_count % spec.sort_period:
            return rows
        for f in self.model.functions():
            space = self.model.messages[f.emit.message].space if f.agent == agent and f.emit else None
            if space is not None and all(spec.has_variable(c) and not spec.variables[c].length for c in space.names):
                return sort_by_place(rows, space)
        return rows

    def vector(self, agent: str, state: str | None = None) -> AgentVector:
        """A small population as a list on the driver."""
        return AgentVector.of(self.population(agent, state), list(self.model.agents[agent].variables.values()))

    def set_vector(self, agent: str, rows: AgentVector, state: str | None = None) -> None:
        """A population from a list; unset ids are filled in the list's order."""
        held = rows.frame(self.spark)
        first = max(P.next_id(held), self.fresh_id(agent))
        free = iter(range(first, first + len(rows)))
        for r in rows:
            r.id = r.id or next(free)
        self.set_population(agent, rows.frame(self.spark), state)

    def drop_tables(self) -> None:
        """Removes the written tables; frames that read them are then of no use."""
        try:
            self._delete(self._folder)
        except Exception:  # the session may be gone at exit; the folder is the cluster's to clean
            pass

    def simulate(self, steps: int = 0, step_log: StepLog | None = None, exit_log: StepLog | None = None) -> World:
        """Runs ``steps`` steps (0: until an exit condition), with logs before the first and after each."""
        if not steps and not self.model.exit_conditions:
            raise ModelError("a run without steps needs an exit condition")
        began = time.perf_counter()
        for f in self.model.init:
            f(self)
        if step_log:
            self.log.append(self.frame(step_log))
        while True:
            done = self.step()
            if step_log and self.step_count % step_log.frequency == 0:
                self.log.append(self.frame(step_log))
            if done or (steps and self.step_count >= steps):
                break
        for f in self.model.exit:
            f(self)
        if exit_log:
            self.exit_log = self.frame(exit_log)
        self.times["simulation"] = time.perf_counter() - began
        return self

    def frame(self, what: StepLog) -> dict:
        """One log row: step, properties, and the fused reductions of each population."""
        row: dict = {"step": self.step_count} | {p: self.get(p) for p in what.properties}
        for (agent, state), asked in what.reductions.items():
            found = self.reduce(agent, Reduce("count"), *[r for r in asked if r.how != "count"], state=state)
            row |= {f"{agent}.{state}.{k}": v for k, v in found.items()}
        if what.timing:
            row["seconds"] = self.times.get(f"step {self.step_count}", 0.0)
        return row
