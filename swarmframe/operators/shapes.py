"""Message reads as joins: agents, the messages near them, and a fold over those.

Every read is ``agents LEFT JOIN messages ON shape GROUP BY agent``. Messages
are dealt to all cells that may read them, so both sides meet on one cell key
and the group keys contain the join keys: the fold needs no shuffle of its own.
A fold that does not look at the reader is computed once for each cell, combined
before the shuffle, and looked up.

Expressions are SQL text over ``a.<agent variable>`` and ``m.<message variable>``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MessageError
from ..types import as_column
from .ordered import read_ordered

Fold = dict[str, str]
#: Rows of a block of either side of an all-pairs read that depends on the reader.
BLOCK_ROWS = 20_000
#: Messages of one key that one task takes, and the keys that may have more: where ``parts`` is 0, larger ones are dealt out.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def looks_at_reader(*expressions: str | None) -> bool:
    return any(re.search(r"\ba\.", e) for e in expressions if e)


def fold_columns(fold: Fold, defaults: dict | None = None) -> list[Column]:
    """Aggregates by name; an empty neighbourhood gives the default, 0 for counts."""
    defaults = {k: 0 for k, v in fold.items() if v.lower().startswith("count")} | (defaults or {})
    return [F.coalesce(F.expr(v), as_column(defaults[k])).alias(k) if k in defaults else F.expr(v).alias(k) for k, v in fold.items()]


def joined(messages: DataFrame, fold: Fold) -> tuple[DataFrame, Fold]:
    """Messages and fold for a left join: rows are counted by a mark that an unmatched agent lacks."""
    return messages.withColumn("_met", F.lit(1)), {k: re.sub(r"\bcount\s*\(\s*(1|\*)\s*\)", "count(m._met)", v, flags=re.I) for k, v in fold.items()}


def dealt(agents: DataFrame, messages: DataFrame, keys: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with one more key: messages of a key in ``parts`` parts, agents at each of them.

    With 0, keys are counted and only those with too many messages are dealt out,
    into as many parts as they need; there are ``HOT_KEYS`` of them at most, so
    they are broadcast. Messages that are equal in all columns share a part.
    """
    keys = list(keys)
    if parts == 1:
        return agents, messages, keys
    share, own = F.lit(parts), messages.columns
    if parts == 0:
        total = messages.count()
        if total <= HOT_ROWS:
            return agents, messages, keys
        most = max(HOT_ROWS, total // HOT_KEYS)
        counts = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
        agents, messages = agents.join(hot, keys, "left"), messages.join(hot, keys, "left")
        share = F.coalesce("_parts", F.lit(1))
    messages = messages.withColumn("_part", F.pmod(F.xxhash64(*own), share).cast("int")).select(*own, "_part")
    return agents.withColumn("_part", F.explode(F.sequence(F.lit(0), share - 1))), messages, [*keys, "_part"]


def meet(agents: DataFrame, messages: DataFrame, keys: Sequence[str], fold: Fold, where: str | None = None, defaults: dict | None = None, parts: int = 1, own: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Left equi-join on ``by`` and ``keys`` (columns of both), residue ``where``, fold by agent.

    Agents keep all their columns but the keys; they must be told apart by them.
    Where one key holds a large share of the messages, ``parts`` deals those of
    each key into so many parts (0: as many as a count finds, of hot keys only):
    agents go to all of them, and partial folds meet in one more shuffle.
    """
    own_given, fold_by = own, agents.columns if own is None else own  # with ``own``, an agent has several keys and is folded over all of them
    own = [c for c in agents.columns if c not in keys]
    keys = [*by, *keys]
    if not looks_at_reader(where, *fold.values()):
        near = messages.alias("m")
        near = near.where(F.expr(where)) if where else near
        found = near.groupBy(*[F.col(f"m.{k}").alias(k) for k in keys]).agg(*[F.expr(v).alias(k) for k, v in fold.items()])
        zero = {k: 0 for k, v in fold.items() if v.lower().startswith("count")} | (defaults or {})
        out = agents.join(found, list(keys), "left")
        return out.select(*own, *[(F.coalesce(k, as_column(zero[k])).alias(k) if k in zero else F.col(k)) for k in fold])
    if own_given is None and (out := read_ordered(agents, messages, keys, fold, where, defaults, own, only_linear=parts == 1)) is not None:
        return out
    messages, fold = joined(messages, fold)
    group = [F.col(f"a.{c}") for c in fold_by]
    agents, messages, keys = dealt(agents, messages, keys, parts)
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"m.{k}") for k in keys])
    on = on & F.expr(where) if where else on
    both = agents.alias("a").join(messages.alias("m"), on, "left")
    return both.groupBy(*group).agg(*fold_columns(fold, defaults)).select(*[F.col(c) for c in own], *fold)


# ---- all messages -------------------------------------------------------------


def read_all(agents: DataFrame, messages: DataFrame, fold: Fold, where: str | None = None, defaults: dict | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Every message (of the same ``by``). A fold free of the reader is one row for all; one along an order needs no pairs; else all pairs under ``where``."""
    if looks_at_reader(where, *fold.values()) and (out := read_ordered(agents, messages, by, fold, where, defaults, agents.columns)) is not None:
        return out
    if by:
        return meet(agents, messages, [], fold, where, defaults, by=by)
    if not looks_at_reader(where, *fold.values()):
        near = messages.alias("m")
        one = (near.where(F.expr(where)) if where else near).agg(*fold_columns(fold, defaults))
        return agents.crossJoin(F.broadcast(one))
    if where and re.search(r"\ba\.\w+\s*=\s*m\.|\bm\.\w+\s*=\s*a\.", where) and not re.search(r"\bor\b|\bnot\b|\bcase\b", where, re.I):  # an equality: a plain join
        near, fold = joined(messages, fold)
        both = agents.alias("a").join(near.alias("m"), F.expr(where), "left")
        return both.groupBy(*[F.col(f"a.{c}") for c in agents.columns]).agg(*fold_columns(fold, defaults))
    # all pairs are asked for: both sides are dealt into blocks, each pair of blocks is one key, and partial folds meet by agent
    held, asks = math.ceil(messages.count() / BLOCK_ROWS) or 1, math.ceil(agents.count() / BLOCK_ROWS) or 1
    block = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = agents.withColumn("_a", block(agents, asks)).withColumn("_b", every(held))
    right = messages.withColumn("_b", block(messages, held)).withColumn("_a", every(asks))
    return meet(left, right, ["_a", "_b"], fold, where, defaults, own=agents.columns)


# ---- keys -----------------------------------------------------------------------


def check_keys(messages: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Messages whose key lies outside the bounds (inclusive) fail the job."""
    if low >= high:
        raise MessageError("the lower bound must be below the upper bound")
    bad = F.raise_error(F.concat(F.lit("key outside bounds: "), F.col(key).cast("string"))).cast("long")
    return messages.withColumn(key, F.when(F.col(key).between(low, high), F.col(key)).otherwise(bad))


def read_bucket(agents: DataFrame, messages: DataFrame, key: str, message_key: str, fold: Fold, where: str | None = None, defaults: dict | None = None, parts: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Messages whose key equals the agent's expression ``key``."""
    return meet(agents.withColumn("_k", F.expr(key)), messages.withColumn("_k", F.col(message_key)), ["_k"], fold, where, defaults, parts, by=by)


def read_bucket_range(agents: DataFrame, messages: DataFrame, begin: str, end: str, message_key: str, fold: Fold, where: str | None = None, defaults: dict | None = None, parts: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Messages with begin <= key < end: the agent asks for each key of its range, and folds over all of them."""
    keys = F.when(F.expr(end) > F.expr(begin), F.sequence(F.expr(begin).cast("long"), F.expr(end).cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    if parts != 1 and (out := read_ordered(agents.withColumn("_k", F.explode_outer(keys)), messages.withColumn("_k", F.col(message_key)), [*by, "_k"], fold, where, defaults, agents.columns, several=True)) is not None:
        return out
    messages, fold = joined(messages.withColumn("_k", F.col(message_key)), fold)
    asked, messages, on_keys = dealt(agents.withColumn("_k", F.explode_outer(keys)), messages, [*by, "_k"], parts)
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"m.{k}") for k in on_keys])
    on = on & F.expr(where) if where else on
    both = asked.alias("a").join(messages.alias("m"), on, "left")
    return both.groupBy(*[F.col(f"a.{c}") for c in agents.columns]).agg(*fold_columns(fold, defaults)).select(*agents.columns, *fold)


# ---- radius ---------------------------------------------------------------------


@dataclass(frozen=True)
class Space:
    """Bounds and radius of a spatial list; two or three axes."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    radius: float
    axes: tuple[str, ...] = ("x", "y", "z")

    def __post_init__(self) -> None:
        if len(self.low) != len(self.high) or len(self.low) not in (2, 3):
            raise MessageError("a space has two or three axes, each with both bounds")
        if self.radius <= 0:
            raise MessageError("the radius must be above 0")
        if any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            raise MessageError("each lower bound must be below its upper bound")

    @property
    def names(self) -> tuple[str, ...]:
        return self.axes[: len(self.low)]

    @property
    def cells(self) -> tuple[int, ...]:
        return tuple(max(1, int(-(-(b - a) // self.radius))) for a, b in zip(self.low, self.high, strict=True))

    def cell(self, axis: int, prefix: str = "") -> Column:
        """The cell on an axis; positions outside fall into the edge cells."""
        name, n = self.names[axis], self.cells[axis]
        at = F.floor((F.col(prefix + name) - F.lit(self.low[axis])) / F.lit(self.radius))
        at = F.when(F.isnan(F.col(prefix + name).cast("double")), F.lit(n - 1)).otherwise(at)  # NaN sorts last; as a long it would be 0
        return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int")

    def checked_wrap(self) -> None:
        for a, b, n in zip(self.low, self.high, self.cells, strict=True):
            if abs(round((b - a) / self.radius) * self.radius - (b - a)) > 1e-9 * (b - a):
                raise MessageError("a wrapped read needs a radius that divides the width")
            if n < 3:
                raise MessageError("a wrapped read needs three cells on each axis")


def virtual(space: Space, axis: int, here: str, there: str) -> Column:
    """The image of a coordinate nearest to ``here`` on a torus."""
    width = space.high[axis] - space.low[axis]
    gap = F.expr(f"({there}) - ({here})")
    return F.when(F.abs(gap) > width / 2, F.expr(there) - F.signum(gap) * F.lit(width)).otherwise(F.expr(there))


def distance_sql(space: Space, wrap: bool = False) -> str:
    """SQL of the squared distance between ``a`` and ``m``."""
    parts = []
    for i, name in enumerate(space.names):
        gap = f"(m.{name} - a.{name})"
        if wrap:
            width = space.high[i] - space.low[i]
            gap = f"(CASE WHEN abs{gap} > {width / 2!r} THEN {gap} - signum{gap} * {width!r} ELSE {gap} END)"
        parts.append(f"{gap} * {gap}")
    return " + ".join(parts)


def deal_offsets(messages: DataFrame, cells: list[Column], sizes: Sequence[int], offsets: list[tuple[int, ...]], wrap: bool) -> DataFrame:
    """A row for each cell that may read the message; ``_d0..`` is message minus reader."""
    n = len(sizes)
    marks = F.array(*[F.struct(*[F.lit(v).cast("int").alias(f"d{i}") for i, v in enumerate(o)]) for o in offsets])
    out = messages.withColumns({f"_h{i}": cells[i] for i in range(n)}).withColumn("_o", F.explode(marks))
    at = [F.col(f"_h{i}") - F.col(f"_o.d{i}") for i in range(n)]
    out = out.withColumns({f"_c{i}": (F.pmod(c, F.lit(s)) if wrap else c).cast("int") for i, (c, s) in enumerate(zip(at, sizes, strict=True))} | {f"_d{i}": F.col(f"_o.d{i}") for i in range(n)})
    if not wrap:
        for i, s in enumerate(sizes):
            out = out.where(F.col(f"_c{i}").between(0, s - 1))
    return out.drop("_o", *[f"_h{i}" for i in range(n)])


def box(reach: int, axes: int) -> list[tuple[int, ...]]:
    spans = [()]
    for _ in range(axes):
        spans = [(*s, d) for s in spans for d in range(-reach, reach + 1)]
    return spans


def read_space(agents: DataFrame, messages: DataFrame, space: Space, fold: Fold, wrap: bool = False, within: float | None = None, where: str | None = None, defaults: dict | None = None, parts: int = 1, by: Sequence[str] = (), edge: bool = False) -> DataFrame:
    """Messages in the agent's cell and those next to it; ``within`` also checks the distance (<=).

    A reader of a wrapped read that stands outside the bounds fails the job;
    with ``edge`` it reads from the edge cell, where messages of that place are.
    """
    if edge and within is not None:
        raise MessageError("no distance on a torus is defined outside its bounds")
    if wrap:
        space.checked_wrap()
    if wrap and not edge:
        inside = reduce(lambda x, y: x & y, [F.col(c).between(a, b) for c, a, b in zip(space.names, space.low, space.high, strict=True)])
        first = space.names[0]
        agents = agents.withColumn(first, F.when(inside, F.col(first)).otherwise(F.raise_error(F.lit("a wrapped read outside the bounds")).cast("double")))
    n = len(space.cells)
    here = agents.withColumns({f"_c{i}": space.cell(i) for i in range(n)})
    dealt = deal_offsets(messages, [space.cell(i) for i in range(n)], space.cells, box(1, n), wrap)
    near = f"{distance_sql(space, wrap)} <= {within * within!r}" if within is not None else None
    both = " AND ".join(f"({x})" for x in (near, where) if x) or None
    return meet(here, dealt, [f"_c{i}" for i in range(n)], fold, both, defaults, parts, by=by)


# ---- grids ----------------------------------------------------------------------


def grid_offsets(axes: int, reach: int, neumann: bool = False) -> list[tuple[int, ...]]:
    """Moore, or von Neumann (sum of distances within reach); never the cell itself."""
    if reach < 1:
        raise MessageError("a radius of 0 reads nothing")
    return [o for o in box(reach, axes) if any(o) and (not neumann or sum(map(abs, o)) <= reach)]


def read_grid(agents: DataFrame, messages: DataFrame, size: Sequence[int], index: Sequence[str], fold: Fold, reach: int = 1, wrap: bool = False, neumann: bool = False, where: str | None = None, defaults: dict | None = None, parts: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Messages of the cells around the agent's own, on one, two or three axes (columns ``index`` of both)."""
    if any(s < 1 for s in size):
        raise MessageError("each dimension must be 1 or more")
    if wrap and any(2 * reach + 1 > s for s in size):
        raise MessageError("a wrapped read may not meet a cell twice")
    n = len(size)
    here = agents.withColumns({f"_c{i}": F.col(c).cast("int") for i, c in enumerate(index)})
    dealt = deal_offsets(messages, [F.col(c).cast("int") for c in index], size, grid_offsets(n, reach, neumann), wrap)
    return meet(here, dealt, [f"_c{i}" for i in range(n)], fold, where, defaults, parts, by=by)


def read_at(agents: DataFrame, messages: DataFrame, index: Sequence[str], at: Sequence[str], take: dict[str, str], zero=0, by: Sequence[str] = ()) -> DataFrame:
    """The message at an index the agent names; unwritten cells read ``zero``, and one written twice fails the job."""
    messages = written_once(messages, [*by, *index])
    asked = agents.withColumns({f"_c{i}": F.expr(e).cast("int") for i, e in enumerate(at)})
    held = messages.select(*by, *[F.col(c).cast("int").alias(f"_c{i}") for i, c in enumerate(index)], *[F.col(v).alias(k) for k, v in take.items()])
    out = asked.join(held, [*by, *[f"_c{i}" for i in range(len(index))]], "left")
    return out.select(*agents.columns, *[F.coalesce(k, F.lit(zero)).alias(k) for k in take])


def linear_index(index: Sequence[str], size: Sequence[int]) -> Column:
    """z * dx * dy + y * dx + x."""
    total, step = F.lit(0).cast("long"), 1
    for name, n in zip(index, size, strict=True):
        total, step = total + F.col(name).cast("long") * step, step * n
    return total


def check_index(messages: DataFrame, index: Sequence[str], size: Sequence[int]) -> DataFrame:
    """Messages whose index lies outside the grid fail the job."""
    inside = reduce(lambda x, y: x & y, [F.col(c).between(0, n - 1) for c, n in zip(index, size, strict=True)])
    bad = F.raise_error(F.concat_ws(" ", F.lit("index outside the grid:"), *[F.col(c).cast("string") for c in index])).cast("long")
    return messages.withColumn(index[0], F.when(inside, F.col(index[0])).otherwise(bad))


def written_once(messages: DataFrame, index: Sequence[str]) -> DataFrame:
    """The messages, one for each index; an index that was written more than once fails the job."""
    rest = [c for c in messages.columns if c not in index]
    bad = F.raise_error(F.concat_ws(" ", F.lit("more than one message at index"), *[F.col(c).cast("string") for c in index])).cast("int")
    held = messages.groupBy(*index).agg(F.count(F.lit(1)).alias("_written"), *[F.first(c).alias(c) for c in rest])
    return held.where(F.when(F.col("_written") == 1, F.lit(1)).otherwise(bad) == 1).select(*messages.columns)


def conflicts(messages: DataFrame, index: Sequence[str]) -> DataFrame:
    """Indices written more than once."""
    return messages.groupBy(*index).agg(F.count(F.lit(1)).alias("written")).where("written > 1")


def dense(messages: DataFrame, index: Sequence[str], size: Sequence[int], values: Sequence[str], zero=0) -> DataFrame:
    """A row for each cell of the grid; cells not written hold ``zero``."""
    total = reduce(lambda a, b: a * b, size, 1)
    cells = messages.sparkSession.range(total)
    at, step = {}, 1
    for name, n in zip(index, size, strict=True):
        at[name] = (F.expr(f"id div {step}") % n).cast("int")
        step *= n
    cells = cells.select(*[e.alias(k) for k, e in at.items()])
    held = messages.select(*[F.col(c).cast("int").alias(c) for c in index], *values)
    return cells.join(held, list(index), "left").select(*index, *[F.coalesce(v, F.lit(zero)).alias(v) for v in values])


# ---- graphs ---------------------------------------------------------------------


def read_edges(agents: DataFrame, edges: DataFrame, vertex: str, fold: Fold, incoming: bool = False, where: str | None = None, defaults: dict | None = None, parts: int = 1) -> DataFrame:
    """Edges that leave (or enter) the agent's vertex; ``m`` is the edge."""
    return read_bucket(agents, edges, vertex, "dest" if incoming else "source", fold, where, defaults, parts)
