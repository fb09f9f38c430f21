"""What queries over trees may do with large tables and large documents."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan import catalog
from sylvan.operators import axes
from sylvan.sources import nodes as trees

SF = "/root/testdata/sf0.001"
#: Queries that failed on larger tables, as node tables were sent to the driver.
SENT = ["tree_axis_descendant", "tree_axis_descendant_or_self", "tree_descendants", "tree_expr_compare", "tree_expr_count", "tree_expr_except", "tree_expr_filtered", "tree_expr_join", "tree_expr_not", "tree_expr_or", "tree_expr_siblings", "tree_expr_up", "tree_paths"]


def _plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SENT)
def test_no_node_table_is_sent_to_the_driver(spark, name):
    plan = _plan(spark, name)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents_are_parsed_once(spark):
    plan = _plan(spark, "tree_transform").partition("\n== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1  # which serialises


def test_documents_share_batches(spark):
    texts = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.format_string('<a n="%s"><b>x</b></a>', "id").alias("x")).coalesce(1)
    nodes = trees.shred(texts, F.col("id"), F.col("x"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    assert nodes.mapInArrow(sizes, "n long").where("n > 1000").count()
    assert {(r.doc_id, r.text) for r in trees.serialize(nodes).collect()} == {(r.id, r.x) for r in texts.collect()}


def test_nodes_of_small_documents_lie_in_one_block(spark):
    ids = spark.createDataFrame([(0, 0), (77, 80), (4000, 4095), (4000, 4096), (70_000, 80_000), (5, None)], "at int, last int")
    assert [len(r[0]) for r in ids.select(axes._keys_of_id(F.col("at"), F.col("last"))).collect()] == [1, 1, 1, 2, 3, 6]


@pytest.fixture(scope="module")
def large(spark):
    """A document of 80,000 nodes, some of them deep, beside a small one."""
    dice, out, open_ = random.Random(5), ["<r>"], ["r"]
    for k in range(80_000):
        while len(open_) > 1 and dice.random() < 0.45:
            out.append(f"</{open_.pop()}>")
        open_.append("d" if k in (200, 4_000, 66_000) else dice.choice("abc"))
        out.append(f"<{open_[-1]}>")
        if len(open_) > 14:
            while len(open_) > dice.randrange(1, 14):
                out.append(f"</{open_.pop()}>")
    out += [f"</{n}>" for n in reversed(open_)]
    df = spark.createDataFrame([("x", "".join(out)), ("y", "<r><d><a/></d></r>")], "id string, x string")
    return trees.shred(df, F.col("id"), F.col("x")).cache()


def test_axes_of_a_large_document(large):
    rows = {(r.doc_id, r.node_id): r for r in large.select("doc_id", "node_id", "size", "parent_id", "local").collect()}
    starts = [r for k, r in enumerate(rows.values()) if r.local in ("r", "d") or k % 50 == 0]
    context = large.where(" or ".join(f"(doc_id = '{d}' and node_id in ({','.join(str(r.node_id) for r in starts if r.doc_id == d)}))" for d in "xy"))
    got = {(r.doc_id, r.ctx_id): (r.n, r.s) for r in axes.step(context, large, "descendant").groupBy("doc_id", "ctx_id").agg(F.count("*").alias("n"), F.sum("node_id").alias("s")).collect()}
    assert got == {(r.doc_id, r.node_id): (r.size, sum(range(r.node_id + 1, r.node_id + r.size + 1))) for r in starts if r.size}
    found = sorted((r.doc_id, r.ctx_id, r.node_id) for r in axes.step(context, large, "ancestor-or-self").collect())
    want = []
    for r in starts:
        at = r.node_id
        while at is not None:
            want.append((r.doc_id, r.node_id, at))
            at = rows[r.doc_id, at].parent_id
    assert found == sorted(want)


def test_string_values_are_one_join_and_one_group(spark, large):
    texts = spark.createDataFrame([("d", "<a>1<b>2</b><c/>3</a>")], "id string, x string")
    nodes = trees.shred(texts, F.col("id"), F.col("x"))
    values = axes.string_values(nodes.where("kind <> 'text'"), nodes)
    assert [r.text for r in values.orderBy("node_id").collect()] == ["123", "123", "2", ""]
    assert values._jdf.queryExecution().executedPlan().toString().partition("\n== Initial Plan ==")[0].count("SortMergeJoin") == 1
