"""Navigation over node tables (sources.nodes): the axes, node tests and the functions that follow nodes.

A step takes context rows (with doc_id and node_id) and gives the nodes reached,
each once for each context, as columns ctx_id and the node's own. Every join has
an equality on doc_id, so that only nodes of one document meet. Descendants and
ancestors are ranges of node_id within it, joined by equality on blocks of ids, so
that a large document is not one task's work. No join is a broadcast (see joined).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["doc_id", "node_id", "size", "level", "parent_id", "kind", "ns", "local", "prefix", "value", "attrs", "ns_in_scope", "last"]
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}


def node_test(name: str = "*", kind: str = "element", ns: str | None = None) -> Column:
    """A name, *, or a kind (node for any) test on node rows."""
    test = F.lit(True) if kind == "node" else F.col("kind") == kind
    if name != "*":
        test = test & (F.col("local") == name)
    return test & (F.col("ns") == ns) if ns is not None else test


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join over node tables, by sorted keys. Spark would guess sizes from what is read, of which parsing, exploding and
    decompressing make many times as much, and so send tables to the driver that do not fit there."""
    return left.join(right.hint("merge"), on, how)


#: A block of rank k holds 16^k numbers; numbers of 32 bits need no more ranks.
RANKS = 7
#: Ids are numbered by so many together: where a range begins or ends in the midst of them, pairs are compared.
TOGETHER = 256


def _blocks_of_range(low: Column, end: Column) -> Column:
    """The fewest blocks that make up the ids from low to before end: at each rank those that no block of the next rank holds."""
    first = [F.ceil(low / 16**k).cast("long") for k in range(RANKS)]
    after = [F.floor(end / 16**k).cast("long") for k in range(RANKS)]

    def span(k: int, a: Column, b: Column) -> Column:
        none = F.array().cast("array<struct<rank:int,block:bigint>>")
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda i: F.struct(F.lit(k).alias("rank"), i.alias("block")))).otherwise(none)

    parts = []
    for k in range(RANKS - 1):
        wider = first[k + 1] < after[k + 1]
        parts += [span(k, first[k], F.when(wider, first[k + 1] * 16).otherwise(after[k])), span(k, F.when(wider, after[k + 1] * 16).otherwise(after[k]), after[k])]
    return F.concat(*parts, span(RANKS - 1, first[-1], after[-1]))


def _key(rank: Column, block: Column) -> Column:
    return F.shiftleft(rank.cast("long"), 32) + block


def _keys_of_range(low: Column, end: Column) -> Column:
    """The ids from low to before end as blocks of TOGETHER ids: the first and the last of them, and the fewest blocks that make up those between."""
    first, final = F.floor(low / TOGETHER).cast("long"), F.floor((end - 1) / TOGETHER).cast("long")
    between = F.transform(_blocks_of_range(first + 1, final), lambda b: _key(b["rank"], b["block"]))
    return F.when(low >= end, F.array().cast("array<bigint>")).when(first == final, F.array(first)).otherwise(F.concat(F.array(first, final), between))


def _keys_of_id(at: Column, last: Column) -> Column:
    """The block of each rank that holds an id, of the ranks that a document with so many ids has."""
    block, most = F.floor(at / TOGETHER).cast("long"), F.floor(F.coalesce(last, F.lit(2**31 - 1)) / TOGETHER).cast("long")
    ranks = F.filter(F.array(*(F.lit(k) for k in range(RANKS))), lambda k: (k == 0) | (F.pow(F.lit(16), k) <= most))
    return F.when(most < 16, F.array(block)).otherwise(F.transform(ranks, lambda k: _key(k, F.floor(block / F.pow(F.lit(16), k)).cast("long"))))


def _within(nodes: DataFrame, of_nodes: Column, context: DataFrame, of_context: Column, inside: Column) -> DataFrame:
    """Pairs of a node and a context of one document of which one is an id in the range of the other. Each pair is
    found once, as the blocks of a range are disjoint."""
    n = nodes.withColumn("_n", F.explode(of_nodes))
    c = context.withColumn("_c", F.explode(of_context))
    return joined(c, n, (F.col("doc_id") == F.col("c_doc")) & (F.col("_n") == F.col("_c")) & inside)


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One step from the context rows; ``test`` is a condition on node rows, ``carry`` names context columns to keep."""
    if axis in ("attribute", "namespace"):
        held = "attrs" if axis == "attribute" else "ns_in_scope"
        return context.where("kind = 'element'").select(*carry, "doc_id", F.col("node_id").alias("ctx_id"), F.explode(held).alias("local", "value"))
    if test is not None:
        nodes = nodes.where(test)
    c = context.select(*carry, F.col("doc_id").alias("c_doc"), F.col("node_id").alias("ctx_id"), F.col("parent_id").alias("c_parent"), (F.col("node_id") + F.col("size")).alias("c_end"), F.col("last").alias("c_last"))
    at, end, me, c_end = F.col("node_id"), F.col("node_id") + F.col("size"), F.col("ctx_id"), F.col("c_end")
    own = 0 if axis.endswith("-or-self") else 1
    if axis in ("descendant", "descendant-or-self"):
        found = _within(nodes, _keys_of_id(at, F.col("last")), c, _keys_of_range(me + own, c_end + 1), (at >= me + own) & (at <= c_end))
    elif axis in ("ancestor", "ancestor-or-self"):
        found = _within(nodes, _keys_of_range(at + own, end + 1), c, _keys_of_id(me, F.col("c_last")), (me >= at + own) & (me <= end))
    else:
        on = {
            "self": at == me,
            "child": F.col("parent_id") == me,
            "parent": at == F.col("c_parent"),
            "following-sibling": (F.col("parent_id") == F.col("c_parent")) & (at > me),
            "preceding-sibling": (F.col("parent_id") == F.col("c_parent")) & (at < me),
            "following": at > c_end,
            "preceding": end < me,
        }
        if axis not in on:
            raise ValueError(f"XPST0003: no axis {axis}")
        found = joined(c, nodes, (F.col("doc_id") == F.col("c_doc")) & on[axis])
    return found.select(*carry, "ctx_id", *NODE)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """The node set of a step: each node once (document order is (doc_id, node_id))."""
    return nodes.drop("ctx_id").dropDuplicates(["doc_id", "node_id"])


def positional(stepped: DataFrame, axis: str, n: int | None) -> DataFrame:
    """axis::test[n] for each context, counted backwards on reverse axes; None is [last()]."""
    backward = (axis in REVERSE) != (n is None)
    order = F.col("node_id").desc() if backward else F.col("node_id").asc()
    w = Window.partitionBy("doc_id", "ctx_id").orderBy(order)
    return stepped.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == (n or 1)).drop("_n")


def path(nodes: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    """A path of (axis, test) from the document nodes; the result is a node set."""
    found = nodes.where("kind = 'document'")
    for axis, test in steps:
        found = distinct_nodes(step(found, nodes, axis, test))
    return found


def string_values(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text): the text nodes inside each context node, in order."""
    parts = step(context, nodes, "descendant-or-self", F.col("kind") == "text").select("doc_id", F.col("ctx_id").alias("node_id"), F.struct(F.col("node_id").alias("at"), "value").alias("part"))
    empty = context.select("doc_id", "node_id", F.lit(None).cast("struct<at:int,value:string>").alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["value"]), "")
    return parts.unionByName(empty).groupBy("doc_id", "node_id").agg(text.alias("text"))


def root(context: DataFrame, nodes: DataFrame) -> DataFrame:
    return joined(nodes.where("node_id = 0"), context.select("doc_id").distinct(), "doc_id", "left_semi")


def by_id(values: DataFrame, nodes: DataFrame, attribute: str = "id") -> DataFrame:
    """id(): elements whose id attribute is one of the white-space separated tokens in values.value."""
    tokens = values.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("id")).where("id <> ''").distinct()
    return joined(nodes.where("kind = 'element'").withColumn("_id", F.try_element_at("attrs", F.lit(attribute))), tokens, F.col("_id") == F.col("id"), "left_semi").drop("_id")


def idref(ids: DataFrame, nodes: DataFrame, attribute: str = "idref") -> DataFrame:
    """idref(): elements whose idref attribute mentions one of the ids in ids.value."""
    mentions = nodes.where("kind = 'element'").withColumn("_ref", F.explode(F.split(F.try_element_at("attrs", F.lit(attribute)), r"\s+")))
    return joined(mentions, ids.select(F.col("value").alias("_ref")).distinct(), "_ref", "left_semi").drop("_ref").dropDuplicates(["doc_id", "node_id"])


def outermost(nodes: DataFrame) -> DataFrame:
    """Nodes of the set without an ancestor in it: one pass in document order."""
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("_end", F.max(F.col("node_id") + F.col("size")).over(w)).where("_end is null or _end < node_id").drop("_end")


def innermost(nodes: DataFrame) -> DataFrame:
    """Nodes of the set without a descendant in it: the next node of the set is beyond them."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return nodes.withColumn("_next", F.lead("node_id").over(w)).where("_next is null or _next > node_id + size").drop("_next")


def paths(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, path) of all elements: /a[1]/b[2], each step numbered among siblings of its name."""
    named = nodes.where("kind = 'element'")
    among = Window.partitionBy("doc_id", "parent_id", "ns", "local").orderBy("node_id")
    label = F.concat(F.when(F.col("ns") != "", F.concat(F.lit("Q{"), "ns", F.lit("}"))).otherwise(""), "local", F.lit("["), F.row_number().over(among), F.lit("]"))
    up = step(named, named.withColumn("value", label), "ancestor-or-self")
    parts = F.array_sort(F.collect_list(F.struct("node_id", "value")))
    return up.groupBy("doc_id", F.col("ctx_id").alias("node_id")).agg(F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda x: x["value"]), "/")).alias("path"))


def lang(nodes: DataFrame, wanted: str) -> DataFrame:
    """Elements whose nearest xml:lang, their own or an ancestor's, is the language or a part of it."""
    marked = nodes.where("kind = 'element'").withColumn("_lang", F.lower(F.try_element_at("attrs", F.lit("xml:lang"))))
    near = positional(step(nodes.where("kind = 'element'"), marked.where("_lang is not null").drop("_lang"), "ancestor-or-self"), "ancestor-or-self", 1)
    tag = F.lower(F.try_element_at("attrs", F.lit("xml:lang")))
    fits = near.where((tag == wanted.lower()) | tag.startswith(wanted.lower() + "-")).select("doc_id", F.col("ctx_id").alias("node_id"))
    return joined(nodes, fits, ["doc_id", "node_id"], "left_semi")


def match_pattern(nodes: DataFrame, *steps: str) -> DataFrame:
    """Elements that match a pattern such as a/b (parents right to left; ** for any ancestors between, / first for the root)."""
    found = nodes.where((F.col("kind") == "element") & (node_test(steps[-1]))).withColumns({"_top": F.col("parent_id"), "_me": F.col("node_id")})
    elements = nodes.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_i"), F.col("parent_id").alias("_p"), F.col("local").alias("_l"), F.col("size").alias("_s"))
    loose = False
    for name in reversed(steps[:-1]):
        if name == "**":
            loose = True
            continue
        on = (F.col("doc_id") == F.col("_d")) & (F.lit(name == "*") | (F.col("_l") == name))
        on = on & ((F.col("_i") <= F.col("_top")) & (F.col("_i") + F.col("_s") >= F.col("_top")) if loose else F.col("_i") == F.col("_top"))
        found = joined(found, elements, on).withColumn("_top", F.col("_p")).drop("_d", "_i", "_p", "_l", "_s").dropDuplicates(["doc_id", "node_id", "_top"])
        loose = False
    return found.drop("_top", "_me").dropDuplicates(["doc_id", "node_id"])


def accumulate_tree(nodes: DataFrame, start: Column, end: Column, initial: float = 0) -> DataFrame:
    """A summing accumulator over a tree: ``start`` counts when a node is entered, ``end`` when it is left.

    accumulator_before is the value once the node is entered, accumulator_after once it is left. Every node is
    two events; one window runs over a document's events in the order in which a walk meets them.
    """
    last = F.col("node_id") + F.col("size")
    enter = nodes.withColumns({"_at": F.col("node_id"), "_out": F.lit(0), "_deep": F.lit(0), "_v": F.coalesce(start, F.lit(0))})
    leave = nodes.withColumns({"_at": last, "_out": F.lit(1), "_deep": -F.col("level"), "_v": F.coalesce(end, F.lit(0))})
    w = Window.partitionBy("doc_id").orderBy("_at", "_out", "_deep").rowsBetween(Window.unboundedPreceding, 0)
    events = enter.unionByName(leave).withColumn("_sum", F.lit(initial) + F.sum("_v").over(w))
    values = events.groupBy("doc_id", "node_id").agg(F.max(F.when(F.col("_out") == 0, F.col("_sum"))).alias("accumulator_before"), F.max(F.when(F.col("_out") == 1, F.col("_sum"))).alias("accumulator_after"))
    return joined(nodes, values, ["doc_id", "node_id"])


def transform_tree(nodes: DataFrame, drop: Column | None = None, unwrap: Column | None = None, rename: Column | None = None, attrs: Column | None = None) -> DataFrame:
    """Rules over a whole tree in one pass: what matches ``drop`` goes with all inside it (deep-skip), what matches
    ``unwrap`` goes alone (shallow-skip), elements get the name ``rename`` and the attributes ``attrs`` where those
    are not null; all else is copied. Node ids stay, so that the result serialises in order."""
    if drop is not None:
        w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
        gone = F.max(F.when(drop, F.col("node_id") + F.col("size"))).over(w)
        nodes = nodes.withColumn("_gone", gone).where("_gone is null or _gone < node_id").drop("_gone")
    if unwrap is not None:
        nodes = nodes.where(~F.coalesce(unwrap, F.lit(False)) | (F.col("kind") == "document"))
    if rename is not None:
        nodes = nodes.withColumn("local", F.when(F.col("kind") == "element", F.coalesce(rename, F.col("local"))).otherwise(F.col("local")))
    return nodes.withColumn("attrs", F.coalesce(attrs, F.col("attrs"))) if attrs is not None else nodes


def snapshot(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """fn:snapshot: each context node with the names and attributes of its ancestors, outermost first."""
    up = step(context, nodes, "ancestor", F.col("kind") == "element")
    spine = up.groupBy("doc_id", F.col("ctx_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "local", F.to_json("attrs").alias("attrs")))), lambda x: F.struct(x["local"].alias("local"), x["attrs"].alias("attrs"))).alias("ancestors"))
    return joined(context, spine, ["doc_id", "node_id"], "left")
