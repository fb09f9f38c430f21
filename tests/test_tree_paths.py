"""Paths over node tables, against the standard library's tree or the values that the language's rules give."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from sylvan.plans.tree import Tree
from sylvan.plans.values import PathTypeError
from sylvan.sources import nodes as trees

SHOP = (
    '<shop><order id="1" by="ann"><price>700</price><item>pen</item><item>ink</item></order>'
    '<order id="2" by="bob"><price>300</price><item>pen</item></order>'
    '<group><order id="3" by="ann"><price>n/a</price><limit>300</limit></order><order id="4"><price>900</price><limit>900</limit><item/></order></group></shop>'
)
DOCS = [("d1", SHOP), ("d2", '<shop xmlns:p="urn:p"><p:order id="9"><price>800</price></p:order></shop>'), ("d3", "<empty/>"), ("d4", None)]


@pytest.fixture(scope="module")
def tree(spark):
    df = spark.createDataFrame(DOCS, "id string, x string")
    return Tree(trees.shred(df, F.col("id"), F.col("x")).cache(), {"p": "urn:p"})


def _texts(tree, path, doc="d1"):
    rows = tree.run(path).where(F.col("doc_id") == doc).orderBy("node_id", "name").collect()
    return [r.text for r in rows]


@pytest.mark.parametrize("path", [".//order", "./order", ".//order/item", ".//*[price]", ".//order[@by='ann']/item", ".//order[@by]", "./order[1]/item", ".//order[last()]", ".//item[1]", ".//order[price='300']/price", "./group/order/..//limit"])
def test_paths_match_the_standard_library(tree, path):
    want = ["".join(e.itertext()) for e in ET.fromstring(SHOP).findall(path)]
    assert _texts(tree, "/shop" + path[1:]) == want


@pytest.mark.parametrize(
    "path, want",
    [
        ("//order[price > 500]/@id", ["1", "4"]),
        ("//order[price != 300]/@id", ["1", "3", "4"]),
        ("//order[500 < price]/price/text()", ["700", "900"]),
        ("//order[not(item)]/@id", ["3"]),
        ("//order[not(price > 500) and @by]/@id", ["2", "3"]),
        ("//order[price > 800 or item = 'ink']/@id", ["1", "4"]),
        ("//order[count(item) = 2]/@id", ["1"]),
        ("//order[count(item) + 1]/@id", ["2", "3", "4"]),
        ("/shop/order[position() = 2]/@id", ["2"]),
        ("/shop/order[position() < last()]/@id", ["1"]),
        ("(//order)[last()]/@id", ["4"]),
        ("(//order)[3]/@id", ["3"]),
        ("//item/preceding-sibling::*[1]", ["700", "pen", "300", "900"]),
        ("//order[price = limit]/@id", ["4"]),
        ("//order[price != limit]/@id", ["3"]),
        ("//order[price = //limit]/@id", ["2", "4"]),
        ("//order[limit < 2 * 200]/@id", ["3"]),
        ("//order[price > 2 * sum(limit) + 1]/@id", ["1", "2"]),
        ("//order[contains(@by, 'nn')]/@id", ["1", "3"]),
        ("//order[starts-with(price, '9')]/@id", ["4"]),
        ("//order[string-join(item, '+') = 'pen+ink']/@id", ["1"]),
        ("//*[local-name() = 'limit']", ["300", "900"]),
        ("//@by[. = 'ann']/../price", ["700", "n/a"]),
        ("//@id/ancestor::group/order[1]/@id", ["3"]),
        ("//limit | //order[1]/price", ["700", "n/a", "300", "900"]),
        ("//order[@id = ('1', '4')]/price", ["700", "900"]),
        ("//order except //group/order", ["700penink", "300pen"]),
        ("//item[not(normalize-space())]/parent::order/@id", ["4"]),
        ("/*/group/order[price][2]/following::*", []),
        ("//order[item[2]]/descendant-or-self::node()/self::text()", ["700", "pen", "ink"]),
        ("//group/preceding::item", ["pen", "ink", "pen"]),
        ("//order[@id = 1]/@*", ["ann", "1"]),
        ("//order[.//item = 'ink']/following-sibling::order[item]/@id", ["2"]),
    ],
)
def test_paths(tree, path, want):
    assert _texts(tree, path) == want


@pytest.mark.parametrize("text, want", [("count(//order)", [4, 0, 0]), ("sum(//limit)", [1200.0, 0.0, 0.0]), ("exists(//p:order)", [False, True, False]), ("count(//*[price > 500]) * 2", [4, 2, 0]), ("if (//order) then 'some' else 'none'", ["some", "none", "none"]), ("//price > 850", [True, False, False]), ("string-join(//@id, ',')", ["1,2,3,4", "9", ""])])
def test_values_of_documents(tree, text, want):
    assert [r.value for r in tree.run(text).orderBy("doc_id").collect()] == want


def test_names_and_refusals(tree):
    assert _texts(tree, "//p:order/@id", "d2") == ["9"] == _texts(tree, "//*:order/@id", "d2") == _texts(tree, "//Q{urn:p}order/@id", "d2")
    assert _texts(tree, "//order", "d2") == []
    for wrong in ("//q:order", "//namespace::*", "//order[some $i in item satisfies $i = 'pen']"):
        with pytest.raises(PathTypeError):
            tree.run(wrong)
    with pytest.raises(Exception, match="XPTY0004"):
        tree.run("//order[starts-with(item, 'p')]").collect()


def test_no_documents(tree, spark):
    assert Tree(tree.table.limit(0)).run("//a[b = 1]").collect() == []
