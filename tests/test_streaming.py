"""Streams give what the same operators give over the whole table."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators import grouping
from sylvan.plans.query import compile_row
from sylvan.streaming import records

SCHEMA = "id long, u string, v double"
ROWS = [(i, "ab"[i % 2], float(i % 4)) for i in range(40)]


@pytest.fixture
def stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for k in range(4):  # a file after the other
        df.where((F.col("id") >= 10 * k) & (F.col("id") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return files, df, str(tmp_path)


def _drain(spark, out, name):
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_stateless(spark, stream):
    files, df, _ = stream
    expr = compile_row("v * 2 + 1", df.schema).alias("x")
    assert _drain(spark, files.select("id", expr), "s1") == sorted(map(tuple, df.select("id", expr).collect()))


def test_accumulator(spark, stream):
    files, df, _ = stream
    got = _drain(spark, records.accumulate(files, "u", "id", "v", "id"), "s2")
    whole = grouping.accumulate(df, F.col("v"), "id", ["u"]).select("u", "id", "acc_before", "acc_after")
    assert got == sorted(map(tuple, whole.collect()))


def test_group_ending_with(spark, stream):
    files, df, _ = stream
    got = _drain(spark, records.group_ending_with(files, "u", "id", lambda r: r["v"] == 2.0, "v"), "s3")
    rows = grouping.ending_with(df, F.col("v") == 2.0, "id", ["u"]).groupBy("u", "group_no").agg(F.count("*").alias("n"), F.sum("v").alias("t"), F.max((F.col("v") == 2.0).cast("int")).alias("closed"))
    assert got == sorted((r.u, r.group_no, r.n, r.t) for r in rows.where("closed = 1").collect())


def test_refused(stream):
    with pytest.raises(records.NotStreamable):
        records.check_streamable(stream[0], "group-by")


def test_fork(spark, stream):
    files, df, path = stream
    branches = {"a": lambda b: b.where("u = 'a'"), "n": lambda b: b.groupBy().count()}
    records.fork(files, branches, path + "/out", path + "/state").awaitTermination()
    assert spark.read.parquet(path + "/out/a").count() == 20
    assert sum(r[0] for r in spark.read.option("recursiveFileLookup", "true").parquet(path + "/out/n").select("count").collect()) == 40
