"""Sorting, positions, numbering and limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions.formats import format_integer


def sort_keys(keys: list[tuple[Column, str]], order: list[str], descending: bool = False) -> list[Column]:
    """Stable sort keys of (key, kind): an empty key first, NaN before all numbers; both last if descending."""
    out = []
    for key, kind in keys:
        value = F.when(F.isnan(key), None).otherwise(key) if kind == "double" else key
        if kind == "double":
            rank = F.when(key.isNull(), 0).when(F.isnan(key), 1).otherwise(2)
            out.append(rank.desc() if descending else rank.asc())
        out.append(value.desc_nulls_last() if descending else value.asc_nulls_first())
    return [*out, *(F.col(c).asc() for c in order)]


def sort(df: DataFrame, keys: list[tuple[Column, str]], order: list[str], descending: bool = False) -> DataFrame:
    return df.orderBy(*sort_keys(keys, order, descending))


def top(df: DataFrame, keys: list[tuple[Column, str]], order: list[str], k: int, descending: bool = False) -> DataFrame:
    """The first k rows: each task keeps k, no full sort."""
    return sort(df, keys, order, descending).limit(k)


def positions(df: DataFrame, partition: list[str], order: list[str], position: str = "position", last: str | None = "last") -> DataFrame:
    """position() and last() within each parent."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn(position, F.row_number().over(w))
    return out.withColumn(last, F.count("*").over(Window.partitionBy(*partition))) if last else out


def nth(df: DataFrame, partition: list[str], order: list[str], n: int, from_end: bool = False) -> DataFrame:
    """E[n], or E[last() - n + 1]."""
    keys = [F.col(c).desc() if from_end else F.col(c).asc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*keys))).where(F.col("_n") == n).drop("_n")


def subsequence(df: DataFrame, partition: list[str], order: list[str], start: float, length: float | None = None) -> DataFrame:
    """Positions p with round(start) <= p < round(start) + round(length)."""
    if start != start or (length is not None and length != length):
        return df.limit(0)
    begin = math.floor(start + 0.5) if abs(start) != float("inf") else start
    end = float("inf") if length is None else begin + math.floor(length + 0.5)
    rows = positions(df, partition, order, "_n", None).where(F.col("_n") >= float(max(begin, -9e15)))
    return (rows if end == float("inf") else rows.where(F.col("_n") < float(end))).drop("_n")


def siblings(df: DataFrame, partition: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """preceding-sibling::*[1] and following-sibling::*[1] of each row, as prev_ and next_ columns."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})


def number_single(df: DataFrame, partition: list[str], order: list[str], counted: Column | None = None, start_at: int = 1, name: str = "number", picture: str | None = None) -> DataFrame:
    """number level=single: how many counted siblings there are up to and with this one; rows not counted get none."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    value = F.when(counted, F.sum(counted.cast("int")).over(w) + (start_at - 1))
    return df.withColumn(name, format_integer(value, picture) if picture else value)


def number_any(df: DataFrame, partition: list[str], order: list[str], counted: Column, reset: Column | None = None, name: str = "number") -> DataFrame:
    """number level=any: counted rows in document order since the last row that matches ``reset``."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if reset is None:
        return df.withColumn(name, F.sum(counted.cast("int")).over(w))
    rows = df.withColumn("_era", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))
    era = Window.partitionBy(*partition, "_era").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(counted.cast("int")).over(era)).drop("_era")


def number_multiple(df: DataFrame, levels: list[tuple[list[str], list[str]]], name: str = "number", separator: str = ".") -> DataFrame:
    """number level=multiple: for each level (its partition, its order) the dense position among its parent's."""
    parts = [F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)).cast("string") for partition, order in levels]
    return df.withColumn(name, F.concat_ws(separator, *parts))


def reverse(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in order))
