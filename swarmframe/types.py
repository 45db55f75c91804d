"""Variable types and their Spark counterparts.

Unsigned types widen to the next signed one, uint64 to a decimal. Integer
overflow raises (ANSI mode) where wrapping would give a wrong number silently.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ModelError

SPARK_TYPES: dict[str, T.DataType] = {
    "float": T.FloatType(), "double": T.DoubleType(), "char": T.ByteType(), "uchar": T.ShortType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "int": T.IntegerType(), "uint": T.LongType(), "id": T.LongType(), "enum": T.IntegerType(),
}
FLOATS = ("float", "double")
#: Least and greatest value of the integer types.
BOUNDS = {n: ((0, 2**b - 1) if n[0] == "u" else (-(2 ** (b - 1)), 2 ** (b - 1) - 1)) for b in (8, 16, 32, 64) for n in (f"int{b}", f"uint{b}")}
BOUNDS |= {"char": BOUNDS["int8"], "uchar": BOUNDS["uint8"], "int": BOUNDS["int32"], "uint": BOUNDS["uint32"], "enum": BOUNDS["int32"], "id": (0, 2**63 - 1)}


@dataclass(frozen=True)
class Variable:
    """A typed variable; ``length`` over 0 makes it an array of that length."""

    name: str
    kind: str = "double"
    length: int = 0
    default: object = None

    def __post_init__(self) -> None:
        if self.kind not in SPARK_TYPES:
            raise ModelError(f"{self.name}: unknown type {self.kind}")
        if self.length < 0:
            raise ModelError(f"{self.name}: an array needs a length of 1 or more")
        if self.length and self.default is not None and len(self.default) != self.length:
            raise ModelError(f"{self.name}: the default has {len(self.default)} elements, not {self.length}")

    @property
    def spark_type(self) -> T.DataType:
        one = SPARK_TYPES[self.kind]
        return T.ArrayType(one) if self.length else one

    @property
    def initial(self):
        zero = 0.0 if self.kind in FLOATS else 0
        return self.default if self.default is not None else [zero] * self.length if self.length else zero

    def literal(self) -> Column:
        if self.length:
            return F.array(*[F.lit(v) for v in self.initial]).cast(self.spark_type)
        return F.lit(self.initial).cast(self.spark_type)

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type)

    def check(self, value) -> object:
        """The value, or an error if it is not of this type."""
        if self.length:
            if len(value) != self.length:
                raise ModelError(f"{self.name}: {len(value)} elements, not {self.length}")
            one = Variable(self.name, self.kind)
            return [one.check(v) for v in value]
        if self.kind in FLOATS:
            return float(value)
        if isinstance(value, float) and not math.isfinite(value):
            raise ModelError(f"{self.name}: {value} is not an integer")
        low, high = BOUNDS[self.kind]
        if not low <= int(value) <= high:
            raise ModelError(f"{self.name}: {value} is outside {self.kind}")
        return int(value)


def as_column(expression) -> Column:
    """A Column, SQL text or plain value as a Column; text is always SQL."""
    if isinstance(expression, Column):
        return expression
    return F.expr(expression) if isinstance(expression, str) else F.lit(expression)


def set_element(array, index, value) -> Column:
    """The array with one element (from 0) replaced."""
    array, index, value = as_column(array), as_column(index), as_column(value)
    return F.transform(array, lambda x, k: F.when(k == index, value).otherwise(x))


def wrapping_add(value, amount, bits: int = 32) -> Column:
    """Unsigned addition modulo 2**bits, for counters that wrap."""
    return F.pmod(as_column(value).cast("decimal(38,0)") + as_column(amount), F.lit(2**bits).cast("decimal(38,0)")).cast("decimal(20,0)" if bits == 64 else "long")


def floor_divide(a, b) -> Column:
    """Integers truncate first, then the floor of the whole quotient is itself; floats are floored."""
    return F.floor(as_column(a) / as_column(b))
