"""Sequences held in a row: Spark arrays. An empty or null array is the empty sequence; a null single value is too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def seq(a: Column) -> Column:
    """Never null."""
    return F.coalesce(a, F.array())


def _none(a: Column) -> Column:
    return F.slice(a, 1, 0)


def count(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def empty(a: Column) -> Column:
    return count(a) == 0


def exists(a: Column) -> Column:
    return count(a) > 0


def total(a: Column, zero: Column | None = None) -> Column:
    """fn:sum: 0 (or ``zero``) of an empty sequence."""
    zero = F.lit(0) if zero is None else zero
    first = F.get(a, F.lit(0))
    return F.when(count(a) == 0, zero).otherwise(F.aggregate(F.slice(a, 2, F.greatest(count(a) - 1, F.lit(0))), first, lambda s, x: s + x))


def average(a: Column, kind: str = "double") -> Column:
    to = "double" if kind == "double" else "decimal(38,18)"
    whole = F.aggregate(a, F.lit(0).cast(to), lambda s, x: (s + x).cast(to))
    return F.when(count(a) > 0, (whole / F.size(a)).cast(to))


def _any_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def minimum(a: Column, kind: str = "double") -> Column:
    """NaN if any item is."""
    least = F.array_min(a)
    return F.when(_any_nan(a), F.lit(float("nan"))).otherwise(least) if kind == "double" else least


def maximum(a: Column, kind: str = "double") -> Column:
    return F.array_max(a)


def distinct_values(a: Column) -> Column:
    """First occurrences, in their order; NaN equals NaN."""
    return F.array_distinct(a)


def head(a: Column) -> Column:
    return F.get(a, F.lit(0))


def tail(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(count(a), F.lit(1)))


def last(a: Column) -> Column:
    return F.get(a, count(a) - 1)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def subsequence(a: Column, start: Column, length: Column | None = None) -> Column:
    """Items at p with round(start) <= p < round(start) + round(length), halves up."""
    begin = F.floor(start.cast("double") + 0.5)
    end = F.lit(2.0**31) if length is None else begin + F.floor(length.cast("double") + 0.5)
    return F.filter(a, lambda x, i: (i + 1 >= begin) & (i + 1 < end) & ~F.isnan(start.cast("double")))


def insert_before(a: Column, position: Column, items: Column) -> Column:
    at = F.least(F.greatest(position, F.lit(1)), count(a) + 1)
    return F.concat(F.slice(a, F.lit(1), at - 1), items, F.slice(a, at, F.greatest(count(a) - at + 1, F.lit(0))))


def remove(a: Column, position: Column) -> Column:
    return F.filter(a, lambda x, i: i + 1 != position)


def index_of(a: Column, value: Column, kind: str = "string") -> Column:
    """All positions of the value; NaN equals nothing."""
    positions = F.transform(a, lambda x, i: F.when((x == value) & (~F.isnan(x) if kind == "double" else F.lit(True)), i + 1))
    return F.filter(positions, lambda p: p.isNotNull())


def for_each(a: Column, action: Callable[[Column], Column], many: bool = False) -> Column:
    out = F.transform(a, action)
    return F.flatten(out) if many else out


def keep(a: Column, test: Callable[[Column], Column]) -> Column:
    """fn:filter"""
    return F.filter(a, lambda x: F.coalesce(test(x), F.lit(False)))


def fold_left(a: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, zero, step)


def fold_right(a: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.reverse(a), zero, lambda s, x: step(x, s))


def for_each_pair(a: Column, b: Column, action: Callable[[Column, Column], Column]) -> Column:
    """Pairs up to the shorter one's length."""
    n = F.least(count(a), count(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), action)


def sort(a: Column, key: Callable[[Column], Column] | None = None, kind: str = "string") -> Column:
    """Ascending and stable; an empty key first, NaN before all numbers."""
    key = key or (lambda x: x)

    def rank(k: Column) -> Column:
        return F.when(k.isNull(), 0).when(F.isnan(k), 1).otherwise(2) if kind == "double" else F.when(k.isNull(), 0).otherwise(2)

    marked = F.transform(a, lambda x, i: F.struct(rank(key(x)).alias("r"), key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(marked), lambda s: s["x"])


def exactly_one(a: Column) -> Column:
    return F.when(count(a) == 1, head(a)).otherwise(F.raise_error(F.lit("FORG0005: not exactly one item")))


def one_or_more(a: Column) -> Column:
    return F.when(count(a) > 0, a).otherwise(F.raise_error(F.lit("FORG0004: no item")))


def zero_or_one(a: Column) -> Column:
    return F.when(count(a) <= 1, head(a)).otherwise(F.raise_error(F.lit("FORG0003: more than one item")))


def span(m: Column, n: Column) -> Column:
    """m to n: empty where m is greater or either is; at most ten million items."""
    few = F.when(n - m >= 10_000_000, F.raise_error(F.lit("XPDY0130: range too long"))).otherwise(n)
    return F.when((m <= n), F.sequence(m, few)).otherwise(F.array().cast("array<bigint>"))


def deep_equal(a: Column, b: Column) -> Column:
    """Item by item; NaN equals NaN, and empty equals empty."""
    return a.eqNullSafe(b)


def effective_boolean(x: Column, kind: str, many: bool = False) -> Column:
    """Never null: nothing is false, an empty text is, zero and NaN are; of several items only nodes (structs) have one."""
    if many:
        single = effective_boolean(head(x), kind)
        if kind == "node":
            return exists(x)
        return F.when(count(x) > 1, F.raise_error(F.lit("FORG0006: several atomic items have no boolean value"))).otherwise(single)
    test = {"boolean": x, "string": x != "", "integer": x != 0, "decimal": x != 0, "double": (x != 0) & ~F.isnan(x) if kind == "double" else None, "node": x.isNotNull()}.get(kind)
    if test is None:
        raise TypeError(f"FORG0006: {kind} has no boolean value")
    return F.coalesce(test, F.lit(False))


def general_compare(op: str, a: Column, b: Column, many_a: bool, many_b: bool, kind: str = "string") -> Column:
    """True if any pair compares so. NaN equals nothing, not even itself."""

    def pair(x: Column, y: Column) -> Column:
        tests = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
        if kind != "double":
            return tests[op]
        numbers = ~F.isnan(x) & ~F.isnan(y)
        return tests[op] & numbers if op != "!=" else tests[op] | ~numbers

    if many_a and many_b:
        test = F.arrays_overlap(a, b) if op == "=" and kind != "double" else F.exists(a, lambda x: F.exists(b, lambda y: pair(x, y)))
    elif many_a:
        test = F.exists(a, lambda x: pair(x, b))
    elif many_b:
        test = F.exists(b, lambda y: pair(a, y))
    else:
        test = pair(a, b)
    return F.coalesce(test, F.lit(False))
