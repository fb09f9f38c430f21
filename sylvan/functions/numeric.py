"""Numeric and math functions. Null stands for the empty sequence throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def absolute(x: Column) -> Column:
    return F.abs(x)


def _keep_double(x: Column, whole: Column, kind: str) -> Column:
    """``whole`` in x's own type; infinities and NaN stay as they are."""
    if kind == "double":
        return F.when(F.isnan(x) | (F.abs(x) >= 9.0e15), x).otherwise(whole.cast("double"))
    return whole if kind == "integer" else whole.cast("decimal(38,18)")


def _finite(x: Column, kind: str) -> Column:
    """Large and special doubles replaced, so that the other branch of a when can't overflow."""
    return F.when(F.isnan(x) | (F.abs(x) >= 9.0e15), F.lit(0.0)).otherwise(x) if kind == "double" else x


def ceiling(x: Column, kind: str = "double") -> Column:
    return x if kind == "integer" else _keep_double(x, F.ceil(_finite(x, kind)), kind)


def floor(x: Column, kind: str = "double") -> Column:
    return x if kind == "integer" else _keep_double(x, F.floor(_finite(x, kind)), kind)


def round_up(x: Column, places: int = 0, kind: str = "double") -> Column:
    """fn:round: halves go toward positive infinity."""
    if kind == "integer" and places >= 0:
        return x
    if kind == "integer":
        unit = 10**-places
        return (F.floor((x + unit // 2) / F.lit(unit)) * unit).cast("long")
    if kind == "decimal":
        unit, half = F.lit(10 ** abs(places)).cast("decimal(20,0)"), F.lit("0.5").cast("decimal(2,1)")
        whole = F.floor((x / unit if places < 0 else x * unit) + half)
        return (whole * unit if places < 0 else whole / unit).cast("decimal(38,18)")
    scale = F.lit(10.0**places)
    return _keep_double(x, F.floor(_finite(x, kind) * scale + 0.5), kind) / scale if places else _keep_double(x, F.floor(_finite(x, kind) + 0.5), kind)


def round_half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def number(x: Column) -> Column:
    """fn:number: what is no number is NaN."""
    return F.coalesce(x.try_cast("double"), F.lit(NAN))


def divide(a: Column, b: Column, kind: str) -> Column:
    """Operator div: integers and decimals give decimals and fail on zero; doubles follow IEEE 754."""
    if kind == "double":
        zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
    return a.cast("decimal(38,18)") / b.cast("decimal(38,18)")


def integer_divide(a: Column, b: Column) -> Column:
    """Operator idiv: the quotient cut toward zero."""
    return F.call_function("div", a, b)


def modulo(a: Column, b: Column, kind: str) -> Column:
    """Operator mod: the sign of the dividend; doubles give NaN for a zero divisor."""
    return F.when(b == 0, F.lit(NAN)).otherwise(F.call_function("try_mod", a, b)) if kind == "double" else a % b


def _log(x: Column, of: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(of)


def log(x: Column) -> Column:
    return _log(x, F.ln(x))


def log10(x: Column) -> Column:
    return _log(x, F.log10(x))


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def pi() -> Column:
    return F.lit(math.pi)


def sqrt(x: Column) -> Column:
    return F.sqrt(x)


acos, asin, atan, atan2, cos, exp, power, sin, tan = F.acos, F.asin, F.atan, F.atan2, F.cos, F.exp, F.pow, F.sin, F.tan
