"""Record streams: the same operators over data that arrives, with bounded state.

Stateless expressions (plans.query.compile_row) work on streams as they are. Here
are those with state: groups that start or end with a match, accumulators and
iterate (one state a stream partition), and, beyond the path language, windows of
event time with watermarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class NotStreamable(ValueError):
    """XTSE3430"""


def read_records(spark: SparkSession, path: str, schema: object, form: str = "parquet", row_tag: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Records from a folder of files as they arrive."""
    reader = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("rowTag", row_tag) if row_tag else reader).load(path)


def check_streamable(df: DataFrame, *operators: str) -> None:
    """Refuse, before anything runs, what needs the whole of a stream."""
    bounded = {"for-each", "filter", "iterate", "accumulator", "group-starting-with", "group-ending-with", "fork", "window", "copy-of", "map"}
    if df.isStreaming and (bad := [o for o in operators if o not in bounded]):
        raise NotStreamable(f"XTSE3430: {bad[0]} needs the whole stream")


def fold(df: DataFrame, key: str, order: str, initial: tuple, state_schema: str, step: Callable[[tuple, dict], tuple[tuple, list[dict]]], schema: str) -> DataFrame:
    """iterate or an accumulator on a stream: ``step(state, record)`` gives the next state and rows to put out.

    State is one tuple a key. Records of one micro-batch are taken in order; batches follow each other.
    """
    names = [p.split()[0] for p in schema.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else initial
        rows: list[dict] = []
        for frame in frames:
            rows += frame.to_dict("records")
        out: list[dict] = []
        for record in sorted(rows, key=lambda r: r[order]):
            held, made = step(tuple(held), record)
            out += made
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def group_starting_with(df: DataFrame, key: str, order: str, test: Callable[[dict], bool], value: str) -> DataFrame:
    """Closed groups of a stream: (key, group_no, n, total). A group is closed by the next match, so state is one group's sums."""

    def step(state: tuple, record: dict) -> tuple[tuple, list[dict]]:
        group, n, total = state
        if n and test(record):
            return (group + 1, 1, float(record[value])), [{key: record[key], "group_no": group, "n": n, "total": total}]
        return (group, n + 1, total + float(record[value])), []

    return fold(df, key, order, (1, 0, 0.0), "group_no long, n long, total double", step, f"{key} {dict(df.dtypes)[key]}, group_no long, n long, total double")


def group_ending_with(df: DataFrame, key: str, order: str, test: Callable[[dict], bool], value: str) -> DataFrame:
    """Closed groups of a stream, each closed by its match: (key, group_no, n, total)."""

    def step(state: tuple, record: dict) -> tuple[tuple, list[dict]]:
        group, n, total = state[0], state[1] + 1, state[2] + float(record[value])
        if test(record):
            return (group + 1, 0, 0.0), [{key: record[key], "group_no": group, "n": n, "total": total}]
        return (group, n, total), []

    return fold(df, key, order, (1, 0, 0.0), "group_no long, n long, total double", step, f"{key} {dict(df.dtypes)[key]}, group_no long, n long, total double")


def accumulate(df: DataFrame, key: str, order: str, value: str, record_id: str) -> DataFrame:
    """A summing accumulator on a stream: (key, id, before, after) of each record."""

    def step(state: tuple, record: dict) -> tuple[tuple, list[dict]]:
        after = state[0] + float(record[value])
        return (after,), [{key: record[key], record_id: record[record_id], "before": state[0], "after": after}]

    kinds = dict(df.dtypes)
    return fold(df, key, order, (0.0,), "total double", step, f"{key} {kinds[key]}, {record_id} {kinds[record_id]}, before double, after double")


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows of event time; on a stream, records later than ``late`` are left out."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(window.alias("window"), *keys).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *(c for c in _names(aggregates)))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *(c for c in _names(aggregates)))


def _names(aggregates: list[Column]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[1].strip("`") for c in aggregates]


def fork(df: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> object:
    """fork on a stream: each micro-batch is read once and written by every branch under its name."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, branch in sinks.items():
            branch(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now, and read what it wrote (append mode, exactly once by its checkpoint)."""
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
