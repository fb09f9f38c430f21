"""Typed columns: what an expression compiles to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PathTypeError(TypeError):
    """XPTY0004 and its like, found while compiling."""


NUMERIC = ("integer", "decimal", "double")


@dataclass(frozen=True)
class Val:
    """A column with its kind; ``many``: an array that is a sequence; ``const``: its value, if known when compiling."""

    col: Column | None
    kind: str
    many: bool = False
    const: Any = None
    dtype: T.DataType | None = None
    fn: Callable[..., Val] | None = None
    arity: int = 0
    name: str | None = None

    def one(self, col: Column, kind: str | None = None) -> Val:
        return Val(col, kind or self.kind, False, None, self.dtype)

    def seq(self) -> Val:
        return self if self.many else replace(self, col=F.filter(F.array(self.col), lambda x: x.isNotNull()), many=True, const=None)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    names = {T.DecimalType: "decimal", T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime", T.StructType: "node", T.MapType: "map", T.ArrayType: "array", T.BinaryType: "binary", T.DayTimeIntervalType: "dayTimeDuration", T.YearMonthIntervalType: "yearMonthDuration"}
    return next((name for t, name in names.items() if isinstance(dtype, t)), "any")


def of_column(col: Column, dtype: T.DataType) -> Val:
    """A field: an array is a sequence of its elements."""
    if isinstance(dtype, T.ArrayType):
        return Val(col, kind_of(dtype.elementType), True, None, dtype.elementType)
    return Val(col, kind_of(dtype), False, None, dtype)


def literal(value: Any, kind: str) -> Val:
    col = F.lit(value).cast("decimal(38,18)") if kind == "decimal" else F.lit(value).cast("long") if kind == "integer" else F.lit(value)
    return Val(col, kind, False, value)


def wider(a: str, b: str) -> str:
    """The kind that two numeric kinds meet in."""
    return max(a, b, key=NUMERIC.index)


def as_number(v: Val, kind: str) -> Column:
    return v.col.cast({"integer": "long", "decimal": "decimal(38,18)", "double": "double"}[kind])


def comparable(a: Val, b: Val) -> tuple[Val, Val, str]:
    """Both sides in one kind, or a type error: a text is never compared with a number unless it is untyped."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        kind = wider(a.kind, b.kind)
        if a.many or b.many or kind == "integer":
            return a, b, kind
        a, b = (v if v.kind == kind else literal(float(v.const), kind) if kind == "double" and v.const is not None else replace(v, col=as_number(v, kind)) for v in (a, b))
        return a, b, kind
    if a.kind == b.kind or "any" in (a.kind, b.kind):
        return a, b, a.kind
    for x, y, flip in ((a, b, False), (b, a, True)):
        if x.kind in ("dateTime", "date") and y.kind == "string" and y.const is not None:
            y = Val(F.to_timestamp_ntz(F.lit(y.const.replace("T", " "))) if x.kind == "dateTime" else F.lit(y.const).cast("date"), x.kind)
            return (y, x, x.kind) if flip else (x, y, x.kind)
    if {a.kind, b.kind} == {"date", "dateTime"}:
        return a, b, "dateTime"
    raise PathTypeError(f"XPTY0004: {a.kind} is not comparable with {b.kind}")
