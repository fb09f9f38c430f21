"""Keyed lookups, existential joins, merging of sorted inputs, and set operations on identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_index(df: DataFrame, use: Column, name: str = "key", composite: bool = False) -> DataFrame:
    """key(): an index of rows by the values of ``use``, an array being several of them; NaN and nothing index nothing."""
    rows = df.withColumn(name, use)
    if rows.schema[name].dataType.typeName() == "array" and not composite:
        rows = rows.withColumn(name, F.explode(F.array_distinct(name)))
    if rows.schema[name].dataType.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan(name))
    return rows.where(F.col(name).isNotNull())


def key_lookup(df: DataFrame, value: Column, index: DataFrame, name: str = "key") -> DataFrame:
    """Each row with the indexed rows of its value; the smaller side is broadcast only if Spark finds it small."""
    return df.withColumn("_value", value).join(index, F.col("_value") == F.col(name)).drop("_value")


def semi(df: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """A[x = B/y]"""
    return df.join(other, condition, "left_semi")


def anti(df: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """A[not(x = B/y)]: rows whose comparison is never true, those without a value too."""
    return df.join(other, condition, "left_anti")


def union(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.unionByName(b).dropDuplicates(identity)


def intersect(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.join(b.select(*identity), identity, "left_semi").dropDuplicates(identity)


def except_(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.join(b.select(*identity), identity, "left_anti").dropDuplicates(identity)


def merge(sources: dict[str, DataFrame], keys: list[str], aggregates: list[Column]) -> DataFrame:
    """merge: one row per distinct key over all sources; ``source`` tells their rows apart, so that an aggregate such as
    F.sum(F.when(F.col("source") == "a", ...)) is one of current-merge-group("a"). Missing columns are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).groupBy(*keys).agg(*aggregates)


def unsorted(df: DataFrame, keys: list[str], order: list[str], partition: list[str] | None = None) -> DataFrame:
    """XTDE2220: the rows of a merge input that come after a greater key; empty if it is sorted."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    return df.withColumn("_before", F.lag(F.struct(*keys)).over(w)).where(F.col("_before") > F.struct(*keys)).drop("_before")


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """for-each-pair of two row sequences: joined by position, to the shorter one's length."""
    from sylvan.operators.grouping import ordinal

    return ordinal(a, order_a).join(ordinal(b, order_b), "pos")


def as_of(left: DataFrame, right: DataFrame, at: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it: one union, one window, no pairs."""
    a = left.withColumn("_side", F.lit(1)).withColumns({f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values})
    b = right.select(*by, at, F.lit(0).alias("_side"), *(F.col(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True)
    found = rows.withColumns({f"asof_{v}": F.last(f"_{v}", ignorenulls=True).over(w) for v in values})
    return found.where("_side = 1").drop("_side", *(f"_{v}" for v in values))


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points in spans [start, end]: both go to cells of ``width``, so that only rows of one cell meet."""
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, "_cell").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")
