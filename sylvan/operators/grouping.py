"""The four ways of grouping a sequence, distinct values, folds and accumulators.

A sequence is a DataFrame with order columns. Groups come with ``group_no`` (from
1, in order of first appearance) only where asked for, as numbering groups needs
one sort of the groups; results are never sorted themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _order(order: list[str] | str) -> list[Column]:
    return [F.col(c) for c in ([order] if isinstance(order, str) else order)]


def _key(order: list[str] | str) -> Column:
    columns = _order(order)
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def group_by(df: DataFrame, keys: list[Column], aggregates: list[Column], order: list[str] | str, composite: bool = False) -> DataFrame:
    """for-each-group group-by: an item is in one group for each distinct value of an array key, in none if it is empty.

    One key column named ``key`` (an array is multi-valued unless ``composite``), or several as key_1, key_2...
    of which the tuple is the key; ``first_at`` is the order struct of the group's first item.
    """
    names = ["key"] if len(keys) == 1 else [f"key_{i + 1}" for i in range(len(keys))]
    rows = df.withColumns(dict(zip(names, keys, strict=True)))
    if len(keys) == 1 and not composite:
        kind = rows.schema["key"].dataType.typeName()
        if kind == "array":
            rows = rows.withColumn("key", F.explode(F.array_distinct("key")))
        rows = rows.where(F.col("key").isNotNull())
    elif len(keys) == 1 and rows.schema["key"].dataType.typeName() == "array":
        rows = rows.withColumn("key", F.coalesce("key", F.array()))  # nothing is the empty tuple
    by = [order] if isinstance(order, str) else order
    if len(by) == 1:  # a plain minimum keeps to a hash aggregate
        return rows.groupBy(*names).agg(*aggregates, F.min(by[0]).alias("_first")).withColumn("first_at", F.struct(F.col("_first").alias(by[0]))).drop("_first")
    return rows.groupBy(*names).agg(*aggregates, F.min(F.struct(*_order(by))).alias("first_at"))


def numbered(groups: DataFrame) -> DataFrame:
    """group_no of groups by first appearance; ranks are made range by range, not in one task."""
    return ordinal(groups, ["first_at"], "group_no").drop("first_at")


def ordinal(df: DataFrame, order: list[str], name: str = "pos", ranges: int | None = None, sample: int = 20_000) -> DataFrame:
    """Positions from 1 in the given order: ranks inside ranges of the order, plus the sizes of the ranges before.

    The ranges' bounds come from a sample of at most about ``sample`` rows. They only balance the work: which range a
    row is in follows from its values alone, so that every part of the plan, and every retry, agrees.
    """
    count = df.count()
    ranges = ranges or max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 1000))
    bounds = []
    if ranges > 1:
        keys = df.select(*_order(order)).sample(min(1.0, sample / count), seed=1).orderBy(*order).collect()
        bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges) if keys]
    types = [df.schema[c].dataType for c in order]
    points = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(b, types, order, strict=True))) for b in bounds)) if bounds else None
    own = F.struct(*(F.col(c).alias(c) for c in order))
    cell = F.size(F.filter(points, lambda b: b <= own)) if bounds else F.lit(0)
    rows = df.withColumn("_cell", cell)
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(*_order(order)))
    return rows.withColumn("_in", within).join(base, "_cell").withColumn(name, F.col("_base") + F.col("_in")).drop("_cell", "_in", "_base")


def _window(partition: list[str] | None, order: list[str] | str) -> WindowSpec:
    return Window.partitionBy(*(partition or [])).orderBy(*_order(order))


def adjacent(df: DataFrame, key: Column, order: list[str] | str, partition: list[str] | None = None, name: str = "group_no") -> DataFrame:
    """group-adjacent: a new group wherever the key differs from the previous item's. ``partition``: independent sequences."""
    w = _window(partition, order)
    rows = df.withColumn("_key", F.struct(key.alias("k")))
    starts = F.when(F.col("_key").eqNullSafe(F.lag("_key").over(w)), 0).otherwise(1)
    rows = rows.withColumn("_start", starts)
    return rows.withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start", "_key")


def starting_with(df: DataFrame, test: Column, order: list[str] | str, partition: list[str] | None = None, name: str = "group_no") -> DataFrame:
    """group-starting-with: a match opens a group; items before the first match are a group of their own."""
    w = _window(partition, order)
    starts = F.when(F.coalesce(test, F.lit(False)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("_start", starts).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def ending_with(df: DataFrame, test: Column, order: list[str] | str, partition: list[str] | None = None, name: str = "group_no") -> DataFrame:
    """group-ending-with: a match closes its group."""
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)
    return df.withColumn("_end", ends).withColumn(name, F.coalesce(F.sum("_end").over(w), F.lit(0)) + 1).drop("_end")


def members(order: list[str] | str, item: Column) -> Column:
    """current-group(): the items of a group in order, as an aggregate. Prefer an aggregate of what is needed of them."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*_order(order), item.alias("_item")))), lambda s: s["_item"])


def first_of(item: Column, order: list[str] | str) -> Column:
    return F.min_by(item, _key(order))


def last_of(item: Column, order: list[str] | str) -> Column:
    return F.max_by(item, _key(order))


def sum_of(x: Column) -> Column:
    """fn:sum as an aggregate: 0 of nothing."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg_of(x: Column, exact: bool = False) -> Column:
    """fn:avg as an aggregate; of integers and decimals a decimal."""
    return F.avg(x.cast("decimal(28,8)")) if exact else F.avg(x)


def min_of(x: Column) -> Column:
    """fn:min of doubles as an aggregate: NaN if any is."""
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.min(x))


def max_of(x: Column) -> Column:
    return F.max(x)


def distinct(df: DataFrame, key: Column, order: list[str] | str) -> DataFrame:
    """distinct-values over rows: the first row of each key."""
    rest = [c for c in df.columns]
    packed = F.min_by(F.struct(*rest), F.struct(*_order(order))).alias("_row")
    return df.groupBy(key.alias("_key")).agg(packed).select("_row.*")


def running(df: DataFrame, aggregates: dict[str, Callable[[WindowSpec], Column]], order: list[str] | str, partition: list[str]) -> DataFrame:
    """iterate or an accumulator whose state is a running aggregate: each takes the frame up to and with the row."""
    frame = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: make(frame) for name, make in aggregates.items()})


def accumulate(df: DataFrame, value: Column, order: list[str] | str, partition: list[str], before: str = "acc_before", after: str = "acc_after", initial: float = 0) -> DataFrame:
    """A summing accumulator: its value before and after each item."""
    w = _window(partition, order)
    upto = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(after, F.lit(initial) + F.coalesce(upto, F.lit(0))).withColumn(before, F.lit(initial) + F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def iterate(df: DataFrame, partition: list[str], order: list[str], initial: dict, step: Callable[[dict, pd.Series], tuple[dict, dict | None, bool]], schema: str, on_completion: Callable[[dict], dict] | None = None) -> DataFrame:
    """iterate with any state: ``step(state, item)`` gives the next state, a row to put out (or None) and whether to stop.

    One pass over each sequence in order, streamed batch by batch, so that a long sequence is never held whole;
    sequences (``partition``) are independent. ``on_completion(state)`` adds a row, unless a step has stopped.
    """
    names = [p.split()[0] for p in schema.split(", ")]
    dealt = df.repartition(*partition).sortWithinPartitions(*partition, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, stopped = None, dict(initial), True
        for batch in batches:
            out: list[dict] = []
            for item in batch.to_dict("records"):
                mine = tuple(item[c] for c in partition)
                if mine != key:
                    if key is not None and not stopped and on_completion:
                        out.append(dict(zip(partition, key, strict=True)) | on_completion(state))
                    key, state, stopped = mine, dict(initial), False
                if stopped:
                    continue
                state, row, stopped = step(state, item)
                if row is not None:
                    out.append(dict(zip(partition, mine, strict=True)) | row)
            yield pd.DataFrame(out, columns=names)
        if key is not None and not stopped and on_completion:
            yield pd.DataFrame([dict(zip(partition, key, strict=True)) | on_completion(state)], columns=names)

    return dealt.mapInPandas(run, schema)


def fork(df: DataFrame, *branches: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """fork: several results of one input, branch after branch (column ``branch``, from 1)."""
    out = None
    for k, branch in enumerate(branches, 1):
        part = branch(df).select(F.lit(k).alias("branch"), *columns)
        out = part if out is None else out.unionByName(part)
    return out
