"""Node tables, axes and serialisation, against the standard library's tree."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from sylvan.operators import axes, validation
from sylvan.plans.query import compile_row
from sylvan.plans.values import PathTypeError
from sylvan.sources import nodes as trees
from sylvan.sources.files import Files, PathRefused

DOCS = [("d1", '<a id="x"><b n="1">t<c/></b><b n="2"><c>u</c>v</b><!--w--></a>'), ("d2", '<a xmlns:p="urn:p" xml:lang="en-GB"><p:b><c idref="x y">&lt;z</c></p:b></a>')]


@pytest.fixture
def nodes(spark):
    df = spark.createDataFrame(DOCS, "id string, x string")
    return trees.shred(df, F.col("id"), F.col("x")).cache()


def test_round_trip(spark, nodes):
    got = {r.doc_id: r.text for r in trees.serialize(nodes).collect()}
    for doc, text in DOCS:
        assert ET.canonicalize(got[doc]) == ET.canonicalize(text)


def _steps(nodes, axis, name, **test):
    ctx = nodes.where(F.col("local") == name)
    return sorted((r.doc_id, r.ctx_id, r.node_id) for r in axes.step(ctx, nodes, axis, axes.node_test(**test)).collect())


@pytest.mark.parametrize("axis", ["child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "self", "following-sibling", "preceding-sibling", "following", "preceding"])
@pytest.mark.parametrize("name", ["a", "b", "c"])
def test_axes_match_a_model(nodes, axis, name):
    rows = [r.asDict() for r in nodes.collect()]
    inside = lambda a, b: a["node_id"] < b["node_id"] <= a["node_id"] + a["size"]
    rule = {
        "self": lambda c, n: c is n,
        "child": lambda c, n: n["parent_id"] == c["node_id"],
        "parent": lambda c, n: c["parent_id"] == n["node_id"],
        "descendant": inside,
        "descendant-or-self": lambda c, n: c is n or inside(c, n),
        "ancestor": lambda c, n: inside(n, c),
        "ancestor-or-self": lambda c, n: c is n or inside(n, c),
        "following-sibling": lambda c, n: n["parent_id"] == c["parent_id"] and n["node_id"] > c["node_id"],
        "preceding-sibling": lambda c, n: n["parent_id"] == c["parent_id"] and n["node_id"] < c["node_id"],
        "following": lambda c, n: n["node_id"] > c["node_id"] + c["size"],
        "preceding": lambda c, n: n["node_id"] + n["size"] < c["node_id"],
    }[axis]
    want = sorted((c["doc_id"], c["node_id"], n["node_id"]) for c in rows if c["local"] == name for n in rows if n["doc_id"] == c["doc_id"] and n["kind"] != "document" and rule(c, n))
    assert _steps(nodes.where("kind <> 'document'"), axis, name, kind="node") == want


def test_functions_that_follow_nodes(nodes):
    assert {r.path for r in axes.paths(nodes).collect()} == {"/a[1]", "/a[1]/b[1]", "/a[1]/b[1]/c[1]", "/a[1]/b[2]", "/a[1]/b[2]/c[1]", "/a[1]/Q{urn:p}b[1]", "/a[1]/Q{urn:p}b[1]/c[1]"}
    texts = axes.string_values(nodes.where("local = 'a'"), nodes)
    assert {r.doc_id: r.text for r in texts.collect()} == {"d1": "tuv", "d2": "<z"}
    spark = nodes.sparkSession
    assert axes.by_id(spark.createDataFrame([(" x q ",)], "value string"), nodes).count() == 1
    assert axes.idref(spark.createDataFrame([("y",)], "value string"), nodes).count() == 1
    assert axes.lang(nodes, "en").where("doc_id = 'd2'").count() == 3 and axes.lang(nodes, "en").where("doc_id = 'd1'").count() == 0
    chosen = nodes.where("local in ('b', 'c')")
    assert {r.local for r in axes.outermost(chosen).collect()} == {"b"}
    assert axes.innermost(chosen).where("local = 'c'").count() == 3
    assert axes.match_pattern(nodes, "a", "b").count() == 3 and axes.match_pattern(nodes, "a", "**", "c").count() == 3
    second = axes.positional(axes.step(nodes.where("kind = 'document' or local = 'a'"), nodes, "child", axes.node_test("b")), "child", 2)
    assert [r.attrs for r in second.collect()] == [{"n": "2"}]


def test_content_model(nodes):
    model = validation.Particle(kind="sequence", parts=(validation.Particle("b", most=None),))
    assert validation.validate_content(nodes, {"a": model}).count() == 0
    assert validation.validate_content(nodes, {"a": validation.Particle("b")}).count() == 1


def test_malformed_and_html(spark):
    df = spark.createDataFrame([("x", "<a><b></a>"), ("y", None)], "id string, x string")
    assert trees.shred(df, F.col("id"), F.col("x"), lenient=True).count() == 0
    with pytest.raises(Exception, match="FODC0006"):
        trees.shred(df, F.col("id"), F.col("x")).count()
    page = spark.createDataFrame([("p", "<p>one<p>two<br>three<ul><li>x<li>y</ul>")], "id string, x string")
    found = trees.shred(page, F.col("id"), F.col("x"), html=True).where("kind = 'element'").groupBy("local").count()
    assert {r.local: r["count"] for r in found.collect()} == {"p": 2, "br": 1, "ul": 1, "li": 2}


def test_files_are_guarded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\r\ny\n")
    (tmp_path / "out.txt").write_text("secret")
    (tmp_path / "in" / "link.txt").symlink_to(tmp_path / "out.txt")
    files = Files(spark, str(tmp_path / "in"))
    assert [r.line for r in files.unparsed_text_lines(str(tmp_path / "in" / "a.txt")).collect()] == ["x", "y"]
    assert files.available(str(tmp_path / "in" / "a.txt")) and not files.available(str(tmp_path / "out.txt"))
    for bad in (str(tmp_path / "out.txt"), str(tmp_path / "in" / "link.txt"), "http://example.com/x"):
        with pytest.raises(PathRefused):
            files.collection(bad)


def test_blocks_of_a_range_hold_each_id_once(spark):
    ranges = [(0, 1), (1, 1), (3, 40), (15, 17), (16, 4096), (255, 70_001), (1, 3_000_000), (2**30, 2**31 - 1)]
    rows = spark.createDataFrame(ranges, "low int, end int").select("low", "end", axes._blocks_of_range(F.col("low"), F.col("end")).alias("blocks")).collect()
    for r in rows:
        spans = sorted((b.block << 4 * b.rank, (b.block + 1) << 4 * b.rank) for b in r.blocks)
        assert sum(b - a for a, b in spans) == r.end - r.low and len(spans) <= 30 * axes.RANKS
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and (not spans or (spans[0][0], spans[-1][1]) == (r.low, r.end))


def test_functions_of_the_context_row(nodes):
    calls = ["name(.)", "local-name(.)", "generate-id(.)", "nilled(.)", "in-scope-prefixes(.)", "has-children(.)", "namespace-uri(.)"]
    rows = nodes.where("doc_id = 'd2' and local = 'b'").select(*(compile_row(c, nodes.schema).alias(f"x{k}") for k, c in enumerate(calls))).collect()
    assert [(*r[:4], sorted(r[4]), *r[5:]) for r in rows] == [("p:b", "b", "idd2_2", False, ["p", "xml"], True, "urn:p")]
    assert [r.n for r in nodes.where("local = 'a' and doc_id = 'd1'").select(compile_row("name(.)", nodes.schema).alias("n")).collect()] == ["a"]
    with pytest.raises(PathTypeError):
        compile_row("name(.)", nodes.select("doc_id").schema)
