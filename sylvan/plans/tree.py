"""Paths over node tables (sources.nodes): //order[price > 500]/@id over all documents at once.

Each step is one join of axes.step, or none for attributes. A predicate becomes a
semi or anti join with the nodes for which it holds, or, where it counts, adds or
formats, an aggregate joined to the row; the rest is an expression over one row.
Only positions sort, inside the context that they count in.

A document is a context of its own: absolute paths stay in it, and an expression
that is no path has one value a document. Node sets hold each node once. Values of
nodes are untyped: compared with a number as numbers (a text that is none is NaN),
else as texts; in arithmetic numbers. A function of one item raises XPTY0004 for
two. Each step reads the node table, so give one that is written, not one that would be
parsed again. An attribute has the node_id of its element; it has a parent, ancestors and
itself, and nothing on other axes. Variables cannot be bound to nodes here.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators import axes
from sylvan.plans import library
from sylvan.plans.parser import Node, parse
from sylvan.plans.query import RowCompiler, Scope
from sylvan.plans.values import NUMERIC, PathTypeError, Val

KEY = ["doc_id", "node_id", "attr"]
COLUMNS = [*axes.NODE, "attr"]
#: Axes on which distinct contexts reach distinct nodes.
APART = ("child", "attribute", "self")
FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
ANYWHERE = Node("step", "descendant-or-self", extra=("kind", "node", ()))


@dataclass
class _Place:
    """Rows that an expression is compiled for, with the columns that were joined to them for it."""

    df: DataFrame
    unique: bool = True
    attributes: bool = False
    found: dict[str, Val] = field(default_factory=dict)


class Tree:
    """Expressions over the documents of a node table; ``namespaces`` maps prefixes to URIs ('' for names without one)."""

    def __init__(self, nodes: DataFrame, namespaces: Mapping[str, str] | None = None):
        self.table = nodes.select(*axes.NODE)
        self.nodes = self.table.withColumn("attr", F.lit(""))
        self.namespaces, self.rows, self.made = dict(namespaces or {}), RowCompiler(), 0
        self.documents = self.nodes.where("kind = 'document'")

    def run(self, text: str) -> DataFrame:
        """A path: doc_id, node_id, name and text of its nodes; another expression: doc_id and value, one a document."""
        n = parse(text)
        if _is_path(n):
            return self._valued(self.select(text), n).select("doc_id", "node_id", F.when(F.col("kind") == "attribute", F.col("attr")).otherwise(F.col("local")).alias("name"), "text")
        place = _Place(self.documents)
        v = self._built(place, self._attached(place, n))
        return place.df.select("doc_id", v.col.alias("value"))

    def select(self, text: str) -> DataFrame:
        """The node rows of a path, attributes among them with their name in attr."""
        n = parse(text)
        if not _is_path(n):
            raise PathTypeError(f"a path is wanted, not {n.kind}")
        return self._path(self.documents, n, [])

    def _name(self, stem: str) -> str:
        self.made += 1
        return f"_{stem}{self.made}"

    # steps

    def _path(self, start: DataFrame, n: Node, carry: list[str], attributes: bool = False) -> DataFrame:
        """The nodes reached from the rows of ``start``, each once for each value of the columns ``carry``."""
        if n.kind == "paren":
            return self._path(start, n.parts[0], carry, attributes)
        if n.kind == "set":
            a, b = (self._path(start, p, carry, attributes) for p in n.parts)
            if n.name == "union":
                return a.unionByName(b).dropDuplicates([*carry[:1], *KEY])
            return axes.joined(a, b, [*carry[:1], *KEY], {"intersect": "left_semi", "except": "left_anti"}[n.name])
        rows = start
        for s in _fused(n.parts if n.kind == "path" else (n,)):
            rows = self._step(rows, s, carry, attributes)
            attributes = _of_attributes(s)
        return rows.select(*carry, *COLUMNS)

    def _step(self, rows: DataFrame, n: Node, carry: list[str], attributes: bool) -> DataFrame:
        if n.kind == "context":
            return rows
        if n.kind == "root":
            if rows is self.documents:
                return rows
            return axes.joined(rows.select(*carry, "doc_id").distinct(), self.documents, "doc_id").select(*carry, *COLUMNS)
        if n.kind == "step":
            return self._once(self._reached(rows, n, carry, attributes), n.name, carry)
        if n.kind != "filter":
            if not _is_path(n):
                raise PathTypeError(f"no {n.kind} as a step over trees")
            return self._path(rows, n, carry, attributes)
        tests, base = [], n
        while base.kind == "filter":
            tests, base = [base.parts[1], *tests], base.parts[0]
        if base.kind == "step":
            found, group = self._reached(rows, base, carry, attributes), [*carry, "doc_id", "ctx_id"]
        else:
            found, group = self._path(rows, base, carry, attributes), [*carry, "doc_id"]
        for test in tests:
            found = self._where(found, test, base, group)
        return self._once(found, base.name, carry) if base.kind == "step" else found

    def _once(self, found: DataFrame, axis: str, carry: list[str]) -> DataFrame:
        found = found.select(*carry, *COLUMNS)
        return found if axis in APART else found.dropDuplicates([*carry[:1], *KEY])

    def _reached(self, rows: DataFrame, n: Node, carry: list[str], attributes: bool) -> DataFrame:
        """One step, with ctx_id: a node as often as there are contexts that reach it."""
        if n.name == "namespace":
            raise PathTypeError("the namespace axis has no nodes here: use axes.step")
        if n.name == "attribute":
            return self._attributes(rows, n, carry)
        if not attributes:
            return axes.step(rows, self.table, n.name, self._test(n), carry).withColumn("attr", F.lit(""))
        owned = rows.where("attr <> ''")
        above = {"parent": "self", "ancestor": "ancestor-or-self", "ancestor-or-self": "ancestor-or-self"}.get(n.name)
        itself = owned.select(*carry, F.col("node_id").alias("ctx_id"), *COLUMNS)
        if n.extra[:2] not in (("kind", "node"), ("kind", "attribute")) or not n.name.endswith("self"):
            itself = itself.where(F.lit(False))
        if above is None:
            return itself
        return axes.step(owned, self.table, above, self._test(n), carry).withColumn("attr", F.lit("")).unionByName(itself)

    def _attributes(self, rows: DataFrame, n: Node, carry: list[str]) -> DataFrame:
        how, prefix, local = n.extra
        rows = rows.where("kind = 'element'")
        if how == "name" and local != "*":
            name = f"{prefix}:{local}" if prefix else local
            rows = rows.withColumns({"attr": F.lit(name), "value": F.try_element_at("attrs", F.lit(name))}).where("value is not null")
        else:
            rows = rows.select(*(c for c in rows.columns if c not in ("attr", "value")), F.explode("attrs").alias("attr", "value"))
        own = {"size": F.lit(0), "level": F.col("level") + 1, "parent_id": F.col("node_id"), "kind": F.lit("attribute"), "local": F.col("attr"), "ns": F.lit(""), "prefix": F.lit("")}
        return rows.withColumn("ctx_id", F.col("node_id")).withColumns(own).select(*carry, "ctx_id", *COLUMNS)

    def _test(self, n: Node) -> Column | None:
        how, prefix, local = n.extra
        if how == "kind":
            names = [w.strip("'\"") for w in local if w not in (",", "*")]
            if prefix == "node":
                return None
            return axes.node_test(names[0] if names else "*", "document" if prefix == "document-node" else prefix)
        if prefix.startswith("{"):
            return axes.node_test(local, ns=prefix[1:])
        if prefix == "*" or not prefix and local == "*":
            return axes.node_test(local)
        if prefix and prefix not in self.namespaces:
            raise PathTypeError(f"XPST0081: no namespace for {prefix}")
        return axes.node_test(local, ns=self.namespaces.get(prefix, ""))

    # predicates

    def _where(self, found: DataFrame, test: Node, base: Node, group: list[str]) -> DataFrame:
        while test.kind == "paren":
            test = test.parts[0]
        counts = _calls(test, "position", "last")
        if test.kind == "logic" and test.name == "and" and not counts:
            return reduce(lambda df, part: self._where(df, part, base, group), (_boolean(p) for p in test.parts), found)
        place = _Place(found, base.kind != "step" or base.name in APART, _of_attributes(base))
        negated = _named(test) == "not"
        core = test.parts[0] if negated or _named(test) in ("exists", "boolean") else test
        if not counts and (_is_path(core) or _compares_path(core)):
            at = self._name("at")
            hits = self._hits(place, core, at)
            return axes.joined(place.df, hits, at, "left_anti" if negated else "left_semi").drop(at, *place.found)
        order = [F.col(c).desc() if base.kind == "step" and base.name in axes.REVERSE else F.col(c) for c in ("node_id", "attr")]
        position, size = F.row_number().over(Window.partitionBy(*group).orderBy(*order)), F.count("*").over(Window.partitionBy(*group))
        if counts:
            place.df = place.df.withColumns({"_position": position, "_size": size} if _calls(test, "last") else {"_position": position})
        v = self._built(place, self._attached(place, test, True), True)
        if v.kind in NUMERIC:
            if not counts:
                place.df = place.df.withColumn("_position", position)
            keep = F.col("_position") == v.col
        else:
            keep = library.boolean(v).col
        return place.df.where(keep).drop("_position", "_size", *place.found)

    def _built(self, place: _Place, n: Node, positions: bool = False) -> Val:
        """A column for an expression whose paths have been joined; position() and last() are columns where asked for."""
        scope = Scope(place.found, None, F.col("_position") if positions else F.lit(1), F.col("_size") if positions else F.lit(1))
        return self.rows.build(n, scope)

    def _origins(self, place: _Place, at: str, extra: Column | None = None) -> DataFrame:
        """The rows with their identity ``at``, which is joined by; a value they are compared with is part of it."""
        place.df = place.df.withColumn(at, F.struct(*KEY, *([extra.alias("other")] if extra is not None else [])))
        rows = place.df.select(at, *COLUMNS)
        return rows if place.unique else rows.dropDuplicates([at])

    def _hits(self, place: _Place, n: Node, at: str) -> DataFrame:
        """The identities of the rows from which a path reaches a node, or one that compares as wanted."""
        if _is_path(n):
            return self._path(self._origins(place, at), n, [at], place.attributes).select(at).distinct()
        a, b = n.parts
        op = n.name
        if _is_path(a) and _is_path(b):
            start = self._origins(place, at)
            x, y = (self._valued(self._path(start, p, [at], place.attributes), p).select(at, "text") for p in (a, b))
            if op == "=":
                return axes.joined(x, y, [at, "text"], "left_semi").select(at).distinct()
            ends = lambda df, name: df.groupBy(at).agg(F.min("text").alias(name + "0"), F.max("text").alias(name + "1"))
            x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
            test = {"<": x0 < y1, "<=": x0 <= y1, ">": x1 > y0, ">=": x1 >= y0, "!=": (x0 != y1) | (x1 != y0)}[op]
            return axes.joined(ends(x, "x"), ends(y, "y"), at).where(test).select(at)
        if not _is_path(a):
            a, b, op = b, a, FLIPPED.get(op, op)
        other = self._built(place, self._attached(place, b))
        constant = other.const is not None or not place.found and not _calls(b, "position", "last")
        start = self._origins(place, at, None if constant else other.col)
        values = self._valued(self._path(start, a, [at], place.attributes), a)
        col = other.col if constant else F.col(at)["other"]
        return values.where(_compared(F.col("text"), op, replace(other, col=col))).select(at).distinct()

    def _attached(self, place: _Place, n: Node, boolean: bool = False) -> Node:
        """The expression with variables for its paths, whose values are joined to the rows."""
        name = _named(n)
        if _compares_path(n) or _is_path(n) and (boolean or n.kind == "root"):
            return self._flag(place, n)
        if n.kind == "context":
            return self._joined(place, n, "first")
        if _is_path(n):
            return self._joined(place, n, "first")
        if n.kind == "call":
            if not n.parts and name in ("string", "number", "normalize-space", "string-length"):
                return self._attached(place, replace(n, parts=(Node("context"),)))
            if name in ("local-name", "name") and (not n.parts or n.parts[0].kind == "context"):
                local = F.when(F.col("kind") == "attribute", F.col("attr")).otherwise(F.col("local"))
                full = F.when(F.col("prefix") != "", F.concat("prefix", F.lit(":"), local)).otherwise(local)
                return self._bound(place, Val(F.regexp_replace(local, "^.*:", "") if name == "local-name" else full, "string"))
            if n.parts and _is_path(n.parts[0]):
                if name in ("exists", "boolean", "not", "empty"):
                    flag = self._flag(place, n.parts[0])
                    return flag if name in ("exists", "boolean") else Node("call", "not", (flag,))
                if name in ("count", "sum", "avg", "min", "max"):
                    return self._joined(place, n.parts[0], name)
                if name == "string-join":
                    return replace(n, parts=(self._joined(place, n.parts[0], "all"), *n.parts[1:]))
            wants = name in ("not", "boolean")
            return replace(n, parts=tuple(self._attached(place, p, wants) for p in n.parts))
        if n.extra and n.kind in ("for", "let", "some", "every", "function", "map-constructor"):
            raise PathTypeError(f"no {n.kind} over trees")
        parts = []
        for k, p in enumerate(n.parts):
            made = self._attached(place, p, n.kind == "logic" or n.kind == "if" and k == 0 or n.kind == "paren" and boolean)
            parts.append(made)
        return replace(n, parts=tuple(parts))

    def _bound(self, place: _Place, v: Val) -> Node:
        name = self._name("v")
        place.df = place.df.withColumn(name, v.col)
        place.found[name] = replace(v, col=F.col(name))
        return Node("variable", name)

    def _flag(self, place: _Place, n: Node) -> Node:
        at, name = self._name("at"), self._name("v")
        hits = self._hits(place, n, at).withColumn(name, F.lit(True))
        place.df = axes.joined(place.df, hits, at, "left").drop(at).withColumn(name, F.coalesce(name, F.lit(False)))
        place.found[name] = Val(F.col(name), "boolean")
        return Node("variable", name)

    def _joined(self, place: _Place, n: Node, how: str) -> Node:
        """A variable for what a path gives each row: its count, a figure of its numbers, its texts, or its one text."""
        at, name = self._name("at"), self._name("v")
        reached = self._path(self._origins(place, at), n, [at], place.attributes)
        values = reached if how == "count" else self._valued(reached, n)
        number = F.coalesce(F.col("text").try_cast("double"), F.lit(float("nan"))) if how != "count" else None
        if how == "count":
            made, kind = F.count("*"), "integer"
        elif how == "all":
            parts = F.array_sort(F.collect_list(F.struct("node_id", "attr", "text")))
            made, kind = F.transform(parts, lambda p: p["text"]), "string"
        elif how == "first":
            made, kind = F.when(F.count("*") == 1, F.min("text")).otherwise(F.raise_error(F.lit("XPTY0004: more than one item"))), "string"
        elif how in ("min", "max"):
            made, kind = F.when(F.max(F.isnan(number)), F.lit(float("nan"))).otherwise(F.min(number) if how == "min" else F.max(number)), "double"
        else:
            made, kind = F.sum(number) if how == "sum" else F.avg(number), "double"
        place.df = axes.joined(place.df, values.groupBy(at).agg(made.alias(name)), at, "left").drop(at)
        missing = {"count": F.lit(0).cast("long"), "sum": F.lit(0.0), "all": F.array().cast("array<string>")}.get(how)
        if missing is not None:
            place.df = place.df.withColumn(name, F.coalesce(name, missing))
        place.found[name] = Val(F.col(name), kind, how == "all")
        return Node("variable", name)

    # values

    def _valued(self, found: DataFrame, n: Node) -> DataFrame:
        """Nodes with their string value as ``text``: that of elements and documents is the text inside them."""
        if _has_value(n):
            return found.withColumn("text", F.col("value"))
        inner = found.where("kind in ('element', 'document')").select("doc_id", "node_id", "parent_id", "size", "last").distinct()
        texts = axes.step(inner, self.table, "descendant", F.col("kind") == "text").groupBy("doc_id", "ctx_id")
        parts = F.array_sort(F.collect_list(F.struct("node_id", "value")))
        inner_texts = texts.agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("_inside")).withColumnRenamed("ctx_id", "node_id")
        inside = F.when(F.col("kind").isin("element", "document"), F.coalesce("_inside", F.lit(""))).otherwise(F.col("value"))
        return axes.joined(found, inner_texts, ["doc_id", "node_id"], "left").withColumn("text", inside).drop("_inside")


def _compared(text: Column, op: str, other: Val) -> Column:
    """An untyped text against a value, or any of a sequence."""
    if other.kind not in (*NUMERIC, "string", "date", "dateTime"):
        raise PathTypeError(f"XPTY0004: nodes are not comparable with {other.kind}")

    def test(y: Column) -> Column:
        if other.kind in NUMERIC:
            x, y = text.try_cast("double"), y.cast("double")
            if op == "!=":
                return x.isNull() | F.isnan(x) | (x != y)
            fine = x.isNotNull() & ~F.isnan(x)
        else:
            x = text if other.kind == "string" else text.try_cast("date" if other.kind == "date" else "timestamp_ntz")
            fine = x.isNotNull()
        return fine & {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    return F.exists(other.col, test) if other.many else F.coalesce(test(other.col) & other.col.isNotNull(), F.lit(False))


def _is_path(n: Node) -> bool:
    if n.kind == "filter" or n.kind == "paren":
        return _is_path(n.parts[0])
    if n.kind == "set":
        return all(_is_path(p) for p in n.parts)
    return n.kind in ("step", "root", "context") or n.kind == "path" and _is_path(n.parts[0])


def _compares_path(n: Node) -> bool:
    return n.kind == "general" and any(_is_path(p) for p in n.parts)


def _boolean(n: Node) -> Node:
    """A side of ``and``: a number there is not a position."""
    return n if _is_path(n) or n.kind in ("general", "logic", "paren") or _named(n) in ("not", "exists", "empty", "boolean") else Node("call", "boolean", (n,))


def _named(n: Node) -> str:
    return n.name.removeprefix("fn:") if n.kind == "call" else ""


def _calls(n: Node, *names: str) -> bool:
    """Whether an expression calls one of the functions for its own context: inside paths' predicates they speak of others."""
    if _named(n) in names:
        return True
    return not _is_path(n) and any(_calls(p, *names) for p in n.parts if isinstance(p, Node))


def _of_attributes(n: Node) -> bool:
    while n.kind == "filter":
        n = n.parts[0]
    return n.kind == "step" and n.name == "attribute"


def _has_value(n: Node) -> bool:
    """Whether a path can only end at nodes that hold their value themselves."""
    if n.kind in ("filter", "paren"):
        return _has_value(n.parts[0])
    if n.kind in ("path", "set"):
        return all(_has_value(p) for p in (n.parts if n.kind == "set" else n.parts[-1:]))
    return n.kind == "step" and (n.name == "attribute" or n.extra[:2] in (("kind", "text"), ("kind", "comment"), ("kind", "processing-instruction")))


def _fused(steps: tuple[Node, ...]) -> list[Node]:
    """descendant-or-self::node()/child::x[...] is descendant::x[...], unless a predicate may count positions."""
    out: list[Node] = []
    for s in steps:
        tests, base = [], s
        while base.kind == "filter":
            tests, base = [base.parts[1], *tests], base.parts[0]
        plain = all((t.kind in ("general", "logic") or _is_path(t) or _named(t) in ("not", "exists", "empty", "boolean", "contains", "starts-with", "ends-with", "matches")) and not _calls(t, "position", "last") for t in tests)
        if out and out[-1] == ANYWHERE and base.kind == "step" and base.name == "child" and plain:
            out[-1] = reduce(lambda step, t: Node("filter", parts=(step, t)), tests, replace(base, name="descendant"))
        else:
            out.append(s)
    return out
