"""Operators over rows, against plain Python over lists."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sylvan.operators import grouping, joins, ordering, rules, validation
from sylvan.plans.query import Query

random.seed(7)
ROWS = [(i, i % 5, random.choice(["a", "b", None]), random.choice([1.0, 2.0, -0.0, math.nan, None])) for i in range(200)]
SCHEMA = "id long, g long, k string, x double"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _ordered(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_group_by_leaves_out_empty_keys_and_takes_each_value(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "id long, ks array<string>")
    got = grouping.group_by(df, [F.col("ks")], [F.count("*").alias("n")], "id")
    assert sorted((r.key, r.n, r.first_at.id) for r in got.collect()) == [("a", 1, 1), ("b", 2, 1)]
    one = grouping.group_by(df, [F.col("ks")], [F.count("*").alias("n")], "id", composite=True)
    assert sorted((tuple(r.key), r.n) for r in one.collect()) == [((), 2), (("a", "b", "a"), 1), (("b",), 1)]


def test_adjacent_starting_ending(rows):
    def model(rule):
        out = {}
        for g in range(5):
            n, before = 0, None
            for r in (r for r in ROWS if r[1] == g):
                n = rule(n, before, r)
                out[r[0]] = n
                before = r
        return out

    adjacent = model(lambda n, b, r: n + (b is None or b[2] != r[2]))
    got = grouping.adjacent(rows, F.col("k"), "id", ["g"]).select("id", "group_no").collect()
    assert {r.id: r.group_no for r in got} == adjacent
    starting = model(lambda n, b, r: n + (b is None or r[2] == "a"))
    got = grouping.starting_with(rows, F.col("k") == "a", "id", ["g"]).select("id", "group_no").collect()
    assert {r.id: r.group_no for r in got} == starting
    ending = model(lambda n, b, r: max(n, 1) + (b is not None and b[2] == "a"))
    got = grouping.ending_with(rows, F.col("k") == "a", "id", ["g"]).select("id", "group_no").collect()
    assert {r.id: r.group_no for r in got} == ending


def test_sort_is_stable_with_nan_below_numbers(rows):
    def rank(x):
        return (0, 0.0) if x is None else (1, 0.0) if math.isnan(x) else (2, x)

    up = [r[0] for r in _ordered(ordering.sort(rows, [(F.col("x"), "double")], ["id"]).limit(500).withColumn("n", F.monotonically_increasing_id()), "n")]
    assert up == [r[0] for r in sorted(ROWS, key=lambda r: (rank(r[3]), r[0]))]
    down = [r.id for r in ordering.sort(rows, [(F.col("x"), "double")], ["id"], descending=True).collect()]
    assert down == [r[0] for r in sorted(sorted(ROWS, key=lambda r: r[0]), key=lambda r: rank(r[3]), reverse=True)]


def test_ordinal_counts_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = {r.v: r.pos for r in grouping.ordinal(df, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(1000)}


def test_iterate_stops_and_completes(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(10)], "g long, i long")

    def step(state, item):
        total = state["t"] + item["i"]
        stop = item["g"] == 1 and total > 5
        return {"t": total}, {"t": total} if stop else None, stop

    got = grouping.iterate(df, ["g"], ["i"], {"t": 0}, step, "g long, t long", on_completion=lambda s: {"t": s["t"]})
    assert sorted(map(tuple, got.collect())) == [(0, 45), (1, 6), (2, 45)]


def test_accumulate_and_numbers(rows):
    df = rows.withColumn("v", F.lit(1))
    for r in grouping.accumulate(df, F.col("v"), "id", ["g"]).collect():
        assert r.acc_after == r.acc_before + 1 == r.id // 5 + 1
    got = {r.id: r.number for r in ordering.number_single(rows, ["g"], ["id"], F.col("k") == "a").collect()}
    for g in range(5):
        n = 0
        for r in (r for r in ROWS if r[1] == g):
            n += r[2] == "a"
            assert got[r[0]] == (n if r[2] == "a" else None)


@pytest.mark.parametrize(("start", "length", "want"), [(2, 2, [2, 3]), (0, 2, [1]), (1.5, 1.5, [2, 3]), (math.nan, 1, []), (3, None, [3, 4, 5]), (-math.inf, 3, [])])
def test_subsequence(spark, start, length, want):
    df = spark.createDataFrame([(1, i) for i in range(1, 6)], "g long, i long")
    assert sorted(r.i for r in ordering.subsequence(df, ["g"], ["i"], start, length).collect()) == (want if start != -math.inf else [])


def test_merge_zip_and_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    counts = [F.sum((F.col("source") == s).cast("int")).alias(s) for s in "ab"]
    assert sorted(map(tuple, joins.merge({"a": a, "b": b}, ["k"], counts).collect())) == [(1, 1, 0), (2, 2, 1), (3, 0, 1)]
    assert sorted(r.k for r in joins.union(a, b, ["k"]).collect()) == [1, 2, 3]
    assert [r.k for r in joins.intersect(a, b, ["k"]).collect()] == [2]
    assert [r.k for r in joins.except_(a, b, ["k"]).collect()] == [1]
    assert joins.unsorted(spark.createDataFrame([(1, 5), (2, 3), (3, 4)], "i long, k long"), ["k"], ["i"]).count() == 1
    zipped = joins.zip_rows(a.withColumnRenamed("k", "x"), b.withColumnRenamed("k", "y"), ["x"], ["y"])
    assert sorted((r.x, r.y) for r in zipped.collect()) == [(1, 2), (2, 3)]


def test_key_index_drops_nan_and_nothing(rows):
    index = joins.key_index(rows.select("id", "x"), F.col("x"))
    assert index.count() == sum(r[3] is not None and not math.isnan(r[3]) for r in ROWS)


def test_as_of_and_range(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9)], "u string, t long")
    right = spark.createDataFrame([("u", 2, "x"), ("u", 4, "y"), ("v", 10, "z")], "u string, t long, s string")
    assert sorted((r.u, r.t, r.asof_s) for r in joins.as_of(left, right, "t", ["u"], ["s"]).collect()) == [("u", 1, None), ("u", 5, "y"), ("v", 9, None)]
    points = spark.createDataFrame([(i,) for i in range(30)], "p long")
    spans = spark.createDataFrame([(3, 12), (10, 10), (25, 40)], "a long, b long")
    want = sorted((p, a, b) for p, (a, b) in itertools.product(range(30), [(3, 12), (10, 10), (25, 40)]) if a <= p <= b)
    assert sorted((r.p, r.a, r.b) for r in joins.range_join(points, spans, "p", "a", "b", 4).collect()) == want


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, k string")
    low, high = rules.Rule(F.col("k") != "c", F.lit("low"), 0), rules.Rule(F.col("k") == "a", F.lit("high"), 1)
    assert sorted((r.id, r.result) for r in rules.Mode(low, high).apply(df).collect()) == [(1, "high"), (2, "low")]
    empty = rules.Rule(F.col("k") == "a", F.lit(None).cast("string"), 1)
    assert sorted((r.id, r.result) for r in rules.Mode(low, empty).apply(df).collect()) == [(1, None), (2, "low")]
    assert [r.x for r in df.select(rules.Mode(low, empty).next_match().alias("x")).collect()] == [[None, "low"], ["low"], []]
    texts = df.sparkSession.createDataFrame([("1",), ("x",), (None,)], "s string")
    caught = [rules.try_catch(F.col("s").try_cast("int"), F.lit(-1), *reads).alias(name) for name, reads in (("a", ()), ("b", (F.col("s"),)))]
    assert [tuple(r) for r in texts.select(*caught).collect()] == [(1, 1), (-1, -1), (-1, None)]
    kept = rules.Mode(low, on_no_match="shallow-copy", default=F.col("k")).apply(df)
    assert {r.id: r.result for r in kept.collect()}[3] == "c"
    with pytest.raises(Exception, match="XTDE0555"):
        rules.Mode(low, on_no_match="fail").apply(df).collect()
    fallback = rules.attempt(lambda: df.select(F.raise_error(F.lit("FOO1: x"))), {"FOO1": lambda e: df.limit(1)})
    assert fallback.count() == 1


def test_validation_collects_all_errors(spark):
    df = spark.createDataFrame([(1, "7", "ab"), (2, "x", None), (3, "300", "abcdef")], "id long, n string, s string")
    record = validation.RecordType({"n": validation.Simple("xs:unsignedByte"), "s": validation.Simple(max_length=3, pattern="[a-z]+")}, required=("s",), assertions=("id < 3",))
    got = sorted((r.doc, r.path, r.code) for r in validation.validate_records(df, record, ["id"]).collect())
    assert got == [("2", "n", "cvc-datatype-valid.1"), ("2", "s", "cvc-complex-type.4"), ("3", "", "cvc-assertion"), ("3", "n", "cvc-maxInclusive-valid"), ("3", "s", "cvc-maxLength-valid")]
    assert validation.not_key(spark.createDataFrame([(1,), (1,), (None,)], "k long"), ["k"]).count() == 2


def test_paths_over_tables(spark):
    t = spark.createDataFrame([(i, i % 3, float(i)) for i in range(10)], "id long, g long, v double")
    u = spark.createDataFrame([(1, "one"), (2, "two")], "g long, name string")
    q = Query({"t": (t, ["id"]), "u": (u, ["g"])})
    assert q.run("sum(/t/row[g = 1]/v)").first()[0] == 12.0
    assert q.run("sum(/t/row[g = 9]/v)").first()[0] == 0
    assert q.run("/t/row[3]/id").first()[0] == 2
    assert [r[0] for r in q.run("/t/row[last()]/id").collect()] == [9]
    assert q.run("count(/t/row[g = /u/row[name = 'two']/g])").first()[0] == 3
    assert q.run("count(/t/row[not(g = /u/row/g)])").first()[0] == 4
    assert q.run("count(/t/row[g != /u/row/g])").first()[0] == 10
    odd = Query({"t": (spark.createDataFrame([(1, float("nan")), (2, None), (3, 5.0)], "id long, v double"), ["id"])})
    counts = {"v > 1": 1, "v >= 5": 1, "v = v": 1, "v < 9": 1, "v != 5": 1, "not(v = 5)": 2, "v gt 1 or v lt 1": 1, "v <= v": 1}
    assert {p: odd.run(f"count(/t/row[{p}])").first()[0] for p in counts} == counts
    joined = q.run("for $a in /t/row, $b in /u/row[g = $a/g] return map{'id': $a/id, 'name': $b/name}")
    assert joined.count() == 6 and "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()
    assert q.run("every $a in /t/row satisfies $a/v >= 0").first()[0] is True
    assert q.run("exists(/t/row[v > 100])").first()[0] is False


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    q = Query({"t": (spark.read.parquet(str(tmp_path / "t")), ["id"])})
    plan = q.run("sum(/t/row[v > 3 and id < 8]/v)")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,3.0)" in plan and "LessThan(id,8)" in plan
