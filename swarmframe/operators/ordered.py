"""Reads that need no pairs: conditions of equalities, one inequality and one comparison.

``m.x > f(a)`` asks for all messages behind one place of an order. Messages are
folded by key and value first, then along the order, in which readers stand
among them; ``m.x <> f(a)`` is all messages less those that are equal. The work
grows with rows and not with pairs, whatever the condition lets through. Folds
are counts, sums, least and greatest values that do not look at the reader.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import as_column

#: Rows of a group that are folded without cutting their order, and the parts it is cut into beyond.
PART_ROWS, PARTS = 100_000, 64
#: What this form cannot hold, or what may differ from pair to pair.
REFUSED = re.compile(r"['\"`\[\]{}]|->|<<|>>|<=>|\b(or|not|case|between|like|ilike|rlike|regexp|in|is|exists|select|over|distinct|filter|rand|randn|random|uniform|uuid|shuffle|monotonically_increasing_id)\b", re.I)
COMPARED = re.compile(r"[()]|<=|>=|<>|!=|==|=|<|>")
TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass
class Condition:
    """``equal`` and ``unequal`` hold (reader, message) expressions, ``order`` (reader, sign, message) for message sign reader."""

    of_messages: list[str] = field(default_factory=list)
    of_readers: list[str] = field(default_factory=list)
    equal: list[tuple[str, str]] = field(default_factory=list)
    unequal: tuple[str, str] | None = None
    order: tuple[str, str, str] | None = None


def bare(text: str) -> str:
    """Without parentheses around the whole."""
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for k, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        if k < len(text) - 1:
            break
        text = text[1:-1].strip()
    return text


def conjuncts(text: str) -> list[str]:
    out, depth, start, text = [], 0, 0, bare(text)
    for m in re.finditer(r"[()]|\band\b", text, re.I):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth and m[0] not in "()":
            out.append(text[start : m.start()])
            start = m.end()
    return [x for part in out for x in conjuncts(part)] + conjuncts(text[start:]) if out else [text]


def sides(text: str) -> str:
    return "".join(c for c in "am" if re.search(rf"\b{c}\.", text))


def condition_of(where: str | None) -> Condition | None:
    """None where the text has another form."""
    out = Condition()
    if where is None:
        return out
    if REFUSED.search(where):
        return None
    for part in conjuncts(where):
        if (who := sides(part)) in ("a", "m"):
            (out.of_readers if who == "a" else out.of_messages).append(part)
            continue
        depth, found = 0, []
        for m in COMPARED.finditer(part):
            depth += (m[0] == "(") - (m[0] == ")")
            if not depth and m[0] not in "()":
                found.append(m)
        if len(found) != 1:
            return None
        left, sign, right = part[: found[0].start()], found[0][0], part[found[0].end() :]
        if {sides(left), sides(right)} != {"a", "m"}:
            return None
        if sides(left) == "a":
            left, sign, right = right, TURNED.get(sign, sign), left
        if sign in ("=", "=="):
            out.equal.append((right, left))
        elif sign in ("<>", "!="):
            if out.unequal:
                return None
            out.unequal = (right, left)
        elif out.order:
            return None
        else:
            out.order = (right, sign, left)
    return out


def folds_of(fold: dict[str, str]) -> dict[str, tuple[str, str]] | None:
    """(aggregate, argument) by name."""
    out = {}
    for name, text in fold.items():
        m = re.fullmatch(r"\s*(count|sum|min|max)\s*(\(.*\))\s*", text, re.I | re.S)
        if not m or REFUSED.search(text) or "a" in sides(text) or bare(m[2]) == m[2].strip() or re.search(r",", m[2]):
            return None
        out[name] = (m[1].lower(), "1" if bare(m[2]) == "*" else bare(m[2]))
    return out


def shared_type(a: T.DataType, m: T.DataType) -> T.DataType | None:
    """The type in which two values are compared, where it is plain."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if a == m:
        return a
    if isinstance(a, whole) and isinstance(m, whole):
        return T.LongType()
    return T.DoubleType() if isinstance(a, (*whole, T.DoubleType)) and isinstance(m, (*whole, T.DoubleType)) else None


def merged(how: str, column: Column) -> Column:
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[how](column)


def joint(how: str, x: str, y: str) -> Column:
    """Two partial folds as one; either may be null."""
    if how in ("min", "max"):
        return (F.least if how == "min" else F.greatest)(x, y)
    return F.coalesce(F.col(x) + F.col(y), F.col(x), F.col(y))


def part_of(at: Column, cuts: Sequence) -> Column:
    """The number of cuts below a value, by halves."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at <= F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(cuts))


def along(asked: DataFrame, held: DataFrame, group: list[str], sign: str, hows: dict[str, str], mark: str, cuts: Sequence) -> DataFrame:
    """``asked`` with the folds, named with ``mark``, of all messages of the group whose value is ``sign`` the place.

    Readers stand in the order among the messages, so nothing is joined back.
    """
    names, kinds, own = list(hows), {f.name: f.dataType for df in (held, asked) for f in df.schema.fields}, [c for c in asked.columns if c not in (*group, "_o_at")]
    none = lambda columns: [F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    first = sign in ("<=", ">=")  # of equal values, messages come before the places that they count for
    both = held.select(*group, "_o_at", *names, *none(own), F.lit(0 if first else 1).alias("_o_kind"))
    both = both.unionByName(asked.select(*group, "_o_at", *none(names), *own, F.lit(1 if first else 0).alias("_o_kind")))
    way = F.desc if sign in (">", ">=") else F.asc
    by = [*group, *(["_o_part"] if cuts else [])]
    if cuts:
        both = both.withColumn("_o_part", part_of(F.col("_o_at"), cuts))
    inside = Window.partitionBy(*by).orderBy(way("_o_at"), F.asc("_o_kind")).rowsBetween(Window.unboundedPreceding, 0)
    run = both.select(*by, "_o_at", *own, "_o_kind", *[merged(h, F.col(n)).over(inside).alias(f"{n}{mark}") for n, h in hows.items()])
    run = run.where(F.col("_o_kind") == (1 if first else 0)).drop("_o_kind")
    if not cuts:
        return run
    totals = both.groupBy(*by).agg(*[merged(h, F.col(n)).alias(n) for n, h in hows.items()])
    before = Window.partitionBy(*group).orderBy(way("_o_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, *[merged(h, F.col(n)).over(before).alias(f"_o_before_{n}") for n, h in hows.items()])
    return run.join(offsets, by, "left").select(*group, "_o_at", *own, *[joint(h, f"{n}{mark}", f"_o_before_{n}").alias(f"{n}{mark}") for n, h in hows.items()])


def read_ordered(agents: DataFrame, messages: DataFrame, keys: Sequence[str], fold: dict[str, str], where: str | None, defaults: dict | None = None, kept: Sequence[str] = (), several: bool = False, only_linear: bool = False) -> DataFrame | None:
    """The read on ``keys`` (columns of both) without pairs, or None where condition or fold do not allow it.

    Gives the columns ``kept`` of the agents and the folds. With ``several`` an
    agent has a row for each key it asks, and is folded over all of them.
    ``only_linear`` refuses a comparison.
    """
    c, folds = condition_of(where), folds_of(fold)
    if c is None or folds is None or (only_linear and c.order):
        return None
    loose = set(re.findall(r"(?<![\w.])[A-Za-z_]\w*(?![\w.]|\s*\()", f"{where or ''} {' '.join(x for _, x in folds.values())}"))
    if loose & {*agents.columns, *messages.columns}:  # a column without its side
        return None
    hows, args = {}, {}
    for k, (name, (how, inner)) in enumerate(folds.items()):
        hows[f"_o_f{k}"], args[f"_o_f{k}"] = how, inner
    near, who = messages.alias("m"), agents.alias("a")
    kind = lambda df, text: df.select(F.expr(text)).schema[0].dataType
    if c.unequal:
        exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
        if any(h in ("min", "max") or (h == "sum" and not isinstance(kind(near, args[n]), exact)) for n, h in hows.items()):
            return None
        for n in [n for n, h in hows.items() if h == "sum"]:  # a sum of none is null
            hows[f"{n}_n"], args[f"{n}_n"] = "count", args[n]
    named = {f"_o_e{k}": pair for k, pair in enumerate(c.equal)} | ({"_o_u": c.unequal} if c.unequal else {}) | ({"_o_at": (c.order[0], c.order[2])} if c.order else {})
    types = {n: shared_type(kind(who, a), kind(near, m)) for n, (a, m) in named.items()}
    if any(t is None for t in types.values()) or (c.order and not isinstance(types["_o_at"], T.NumericType)) or (c.order and isinstance(types["_o_at"], T.DecimalType)):
        return None
    for text in c.of_messages:
        near = near.where(F.expr(text))
    sent = near.select(*[F.col(f"m.{k}").alias(k) for k in keys], *[F.expr(m).cast(types[n]).alias(n) for n, (_, m) in named.items()], *[F.expr(x).alias(n) for n, x in args.items()])
    whole = reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in [*keys, *named]], F.lit(True))
    sent = sent.where(whole)
    asks = F.expr(" AND ".join(f"({x})" for x in c.of_readers)) if c.of_readers else F.lit(True)
    base = [f"_o_k{i}" for i in range(len(kept))]
    marked = who.select(*[F.col(f"a.{k}").alias(k) for k in keys], *[F.expr(a).cast(types[n]).alias(n) for n, (a, _) in named.items()], *[F.col(f"a.{x}").alias(b) for b, x in zip(base, kept, strict=True)], F.coalesce(asks, F.lit(False)).alias("_o_asks"))
    first = [*keys, *[n for n in named if n.startswith("_o_e")]]
    asked = marked.where(F.col("_o_asks") & whole).drop("_o_asks")

    def cuts_of(group: list[str]) -> list:
        """None where no group has too many rows for one task."""
        own = [F.lit(0).alias("_o_one"), *group]
        most = sent.select(*own).unionByName(asked.select(*own)).groupBy("_o_one", *group).count().agg(F.max("count")).first()[0]
        if (most or 0) <= PART_ROWS:
            return []
        at = sent.select("_o_at").unionByName(asked.select("_o_at"))
        finite = F.when(~F.isnan(F.col("_o_at").cast("double")), F.col("_o_at"))
        return sorted(set(at.agg(F.percentile_approx(finite, [k / PARTS for k in range(1, PARTS)], 10_000)).first()[0] or []))

    found, cuts = asked, None
    for group, mark in ((first, "_all"), ([*first, "_o_u"], "_same"))[: 2 if c.unequal else 1]:
        held = sent.groupBy(*group, *(["_o_at"] if c.order else [])).agg(*[getattr(F, h)(n).alias(n) for n, h in hows.items()])
        if c.order:
            cuts = cuts_of(group) if cuts is None or cuts else cuts  # the groups of the second are parts of those of the first
            found = along(found, held, group, c.order[1], hows, mark, cuts)
        else:
            part = held.select(*group, *[F.col(n).alias(f"{n}{mark}") for n in hows])
            found = found.join(part, group, "left") if group else found.crossJoin(F.broadcast(part))
    less = lambda n: F.coalesce(f"{n}_all", F.lit(0)) - F.coalesce(f"{n}_same", F.lit(0))
    value = {n: F.col(f"{n}_all") for n in hows}
    if c.unequal:
        value = {n: less(n) if h == "count" else F.when(less(f"{n}_n") > 0, less(n)) for n, h in hows.items()}
    found = found.select(*base, *[value[f"_o_f{k}"].alias(f"_o_r{k}") for k in range(len(folds))])
    rest = marked.where(~(F.col("_o_asks") & whole))  # readers that nothing can meet
    found = found.unionByName(rest.select(*base), allowMissingColumns=True)
    if several:
        found = found.groupBy(*base).agg(*[merged(h, F.col(f"_o_r{k}")).alias(f"_o_r{k}") for k, (h, _) in enumerate(folds.values())])
    schema = messages.alias("m").agg(*[F.expr(v).alias(k) for k, v in fold.items()]).schema
    zero = {k: 0 for k, (h, _) in folds.items() if h == "count"} | (defaults or {})
    out = []
    for k, name in enumerate(folds):
        column = F.col(f"_o_r{k}").cast(schema[name].dataType)
        out.append((F.coalesce(column, as_column(zero[name])) if name in zero else column).alias(name))
    return found.select(*[F.col(b).alias(x) for b, x in zip(base, kept, strict=True)], *out)

