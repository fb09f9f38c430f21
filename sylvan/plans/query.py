"""Compiling the path language to DataFrames.

``compile_row`` makes a Column of an expression over one row. ``Query`` runs an
expression over tables bound as documents: a table t is /t/row*, its columns are
child elements, its order is its key columns. Paths and predicates become scans
and filters; comparisons with other tables' paths become semi and anti joins; for
clauses become joins on the equalities among them; aggregates become aggregates.
Nothing is sorted unless positions are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions import numeric, sequences, strings
from sylvan.operators.grouping import ordinal
from sylvan.plans import library
from sylvan.plans.parser import Node, parse
from sylvan.plans.values import NUMERIC, PathTypeError, Val, as_number, comparable, kind_of, literal, of_column, wider

EMPTY = Val(None, "empty")


@dataclass(frozen=True)
class Scope:
    """Variables, and the context item with its position in an array, if it is in one."""

    variables: dict[str, Val]
    item: Val | None = None
    position: Column | None = None
    size: Column | None = None

    def bind(self, **more: Val) -> Scope:
        return replace(self, variables=self.variables | more)

    def focus(self, item: Val, position: Column | None = None, size: Column | None = None) -> Scope:
        return replace(self, item=item, position=position, size=size)


def row_item(schema: T.StructType, prefix: str = "") -> Val:
    """The row itself as context: its fields are columns, named with a prefix where tables are joined."""
    return Val(None, "row", False, prefix, schema)


def compile_row(text: str, schema: T.StructType, variables: dict[str, Val] | None = None) -> Column:
    """A Column of an expression whose context item is a row of this schema."""
    return RowCompiler().build(parse(text), Scope(variables or {}, row_item(schema))).col


XSD = {
    "xs:integer": ("integer", "long", r"^[ \t\r\n]*[+-]?[0-9]+[ \t\r\n]*$"),
    "xs:decimal": ("decimal", "decimal(38,18)", r"^[ \t\r\n]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"),
    "xs:double": ("double", "double", r"^[ \t\r\n]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)[ \t\r\n]*$"),
    "xs:float": ("double", "float", r"^[ \t\r\n]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)[ \t\r\n]*$"),
    "xs:boolean": ("boolean", "boolean", r"^[ \t\r\n]*(true|false|1|0)[ \t\r\n]*$"),
    "xs:string": ("string", "string", None),
    "xs:untypedAtomic": ("string", "string", None),
    "xs:anyURI": ("string", "string", None),
    "xs:date": ("date", "date", r"^[ \t\r\n]*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}[ \t\r\n]*$"),
    "xs:dateTime": ("dateTime", "timestamp_ntz", r"^[ \t\r\n]*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?[ \t\r\n]*$"),
}

_DAY_TIME = r"^[ \t\r\n]*-?P(?=.)([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?[ \t\r\n]*$"
_YEAR_MONTH = r"^[ \t\r\n]*-?P(?=.)([0-9]+Y)?([0-9]+M)?[ \t\r\n]*$"
XSD |= {
    "xs:dayTimeDuration": ("dayTimeDuration", "interval day to second", _DAY_TIME),
    "xs:yearMonthDuration": ("yearMonthDuration", "interval year to month", _YEAR_MONTH),
    "xs:hexBinary": ("binary", "binary", r"^[ \t\r\n]*([0-9A-Fa-f]{2})*[ \t\r\n]*$"),
    "xs:base64Binary": ("binary", "binary", r"^[ \t\r\n]*([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?[ \t\r\n]*$"),
    "xs:gYear": ("string", "string", r"^-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?$"),
    "xs:gYearMonth": ("string", "string", r"^-?[0-9]{4,}-(0[1-9]|1[0-2])(Z|[+-][0-9]{2}:[0-9]{2})?$"),
    "xs:gMonth": ("string", "string", r"^--(0[1-9]|1[0-2])(Z|[+-][0-9]{2}:[0-9]{2})?$"),
    "xs:gMonthDay": ("string", "string", r"^--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$"),
    "xs:gDay": ("string", "string", r"^---(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$"),
    "xs:normalizedString": ("string", "string", None),
    "xs:token": ("string", "string", None),
    "xs:language": ("string", "string", r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$"),
    "xs:Name": ("string", "string", r"^[\p{L}_:][\p{L}\p{N}_:.\-]*$"),
    "xs:NCName": ("string", "string", r"^[\p{L}_][\p{L}\p{N}_.\-]*$"),
    "xs:ID": ("string", "string", r"^[\p{L}_][\p{L}\p{N}_.\-]*$"),
    "xs:IDREF": ("string", "string", r"^[\p{L}_][\p{L}\p{N}_.\-]*$"),
    "xs:NMTOKEN": ("string", "string", r"^[\p{L}\p{N}_:.\-]+$"),
}
#: Ranges of the derived integer types.
INTEGER_RANGES = {
    "xs:byte": (-128, 127),
    "xs:short": (-32768, 32767),
    "xs:int": (-(2**31), 2**31 - 1),
    "xs:long": (-(2**63), 2**63 - 1),
    "xs:unsignedByte": (0, 255),
    "xs:unsignedShort": (0, 65535),
    "xs:unsignedInt": (0, 2**32 - 1),
    "xs:nonNegativeInteger": (0, None),
    "xs:positiveInteger": (1, None),
    "xs:nonPositiveInteger": (None, 0),
    "xs:negativeInteger": (None, -1),
}
XSD |= {name: XSD["xs:integer"] for name in INTEGER_RANGES}


def cast(v: Val, type_name: str) -> Val:
    """cast as: by the lexical rules of the type; what they refuse fails with FORG0001."""
    if type_name.rstrip("?") not in XSD:
        raise PathTypeError(f"XPST0051: unknown type {type_name}")
    kind, spark, pattern = XSD[type_name.rstrip("?")]
    return Val(F.when(castable_column(v, type_name), _cast(v, kind, spark, type_name)).when(v.col.isNotNull(), F.raise_error(F.lit(f"FORG0001: no {type_name}"))), kind)


def _cast(v: Val, kind: str, spark: str, type_name: str = "") -> Column:
    if kind == "string":
        text = strings.string(v.col, v.kind)
        return F.regexp_replace(text, r"[\t\r\n]", " ") if "normalizedString" in type_name else F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")) if "token" in type_name else text
    if kind in ("dayTimeDuration", "yearMonthDuration") and v.kind == "string":

        def part(letter: str, after: str = "") -> Column:
            return F.coalesce(F.regexp_extract(v.col, after + rf"([0-9.]+){letter}", 1).try_cast("decimal(18,6)"), F.lit(0))

        sign = F.when(F.contains(v.col, F.lit("-")), -1).otherwise(1)
        if kind == "yearMonthDuration":
            return F.make_ym_interval((sign * part("Y")).cast("int"), (sign * part("M")).cast("int"))
        return F.make_dt_interval((sign * part("D")).cast("int"), (sign * part("H")).cast("int"), (sign * part("M", "T.*?")).cast("int"), sign * part("S"))
    if kind == "binary" and v.kind == "string":
        return F.unhex(F.trim(v.col)) if "hex" in type_name else F.unbase64(F.trim(v.col))
    if v.kind == "string":
        text = F.trim(F.regexp_replace(v.col, r"[ \t\r\n]+", " "))
        if kind == "double":
            text = F.when(text == "INF", F.lit("Infinity")).when(text == "-INF", F.lit("-Infinity")).otherwise(text)
        if kind == "boolean":
            return text.isin("true", "1")
        return (F.replace(text, F.lit("T"), F.lit(" ")) if kind == "dateTime" else text).try_cast(spark)
    if kind == "integer" and v.kind in ("double", "decimal"):
        return v.col.try_cast("decimal(38,0)").try_cast(spark) if v.kind == "decimal" else F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col)).try_cast(spark)
    return v.col.try_cast(spark)


def castable_column(v: Val, type_name: str) -> Column:
    kind, spark, pattern = XSD[type_name.rstrip("?")]
    name = type_name.rstrip("?")
    if v.kind == "string" and pattern:  # only what the pattern lets through is cast
        fits = F.rlike(v.col, F.lit(pattern))
        v = Val(F.when(fits, v.col), "string")
    value = _cast(v, kind, spark, name)
    test = value.isNotNull() & v.col.isNotNull()
    low, high = INTEGER_RANGES.get(name, (None, None))
    if low is not None and name != "xs:long":
        test = test & (value >= low)
    if high is not None and name != "xs:long":
        test = test & (value <= high)
    return F.coalesce(test, F.lit(type_name.endswith("?")))


class RowCompiler:
    """Expressions over one row."""

    def build(self, n: Node, s: Scope) -> Val:
        return getattr(self, "do_" + n.kind.replace("-", "_"))(n, s)

    def condition(self, n: Node, s: Scope) -> Column:
        """An expression as a filter: null counts as false there, so comparisons stay plain and reach the scan."""
        if n.kind == "paren":
            return self.condition(n.parts[0], s)
        if n.kind == "logic":
            a, b = (self.condition(p, s) for p in n.parts)
            return a & b if n.name == "and" else a | b
        if n.kind in ("general", "value"):
            a, b = (self.build(p, s) for p in n.parts)
            op = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.get(n.name, n.name)
            if "empty" not in (a.kind, b.kind) and not a.many and not b.many:
                a, b, kind = comparable(a, b)
                x, y = a.col, b.col
                test = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
                if kind == "double":  # NaN is Spark's greatest number, and equal to itself
                    for v, wins in ((a, (">", ">=", "=", "<=")), (b, ("<", "<=", "=", ">="))):
                        if v.const is None and op in wins and not (op == "=" and (a.const is not None or b.const is not None)):
                            test = test & ~F.isnan(v.col)
                return test
            if not a.many and b.many and op == "=" and n.parts[1].kind == "paren" and all(p.kind == "literal" for p in n.parts[1].parts[0].parts) and a.kind not in NUMERIC:
                return a.col.isin(*(p.name for p in n.parts[1].parts[0].parts))
        return library.boolean(self.build(n, s)).col

    def do_literal(self, n: Node, s: Scope) -> Val:
        return literal(n.name, n.extra)

    def do_paren(self, n: Node, s: Scope) -> Val:
        return self.build(n.parts[0], s)

    def do_variable(self, n: Node, s: Scope) -> Val:
        if n.name not in s.variables:
            raise PathTypeError(f"XPST0008: no variable ${n.name}")
        return s.variables[n.name]

    def do_context(self, n: Node, s: Scope) -> Val:
        if s.item is None:
            raise PathTypeError("XPDY0002: no context item")
        return s.item

    def do_sequence(self, n: Node, s: Scope) -> Val:
        parts = [v for v in (self.build(p, s) for p in n.parts) if v.kind != "empty"]
        if not parts:
            return EMPTY
        kinds = {v.kind for v in parts}
        if kinds <= set(NUMERIC):
            kind = reduce(wider, kinds)
            parts = [v if v.many else replace(v, col=as_number(v, kind), kind=kind) for v in parts]
        elif len(kinds) > 1:
            raise PathTypeError(f"a sequence of {sorted(kinds)} has no one column type")
        if all(not v.many for v in parts):
            return Val(F.filter(F.array(*(v.col for v in parts)), lambda x: x.isNotNull()), parts[0].kind, True, None, parts[0].dtype)
        return Val(F.concat(*(v.seq().col for v in parts)), parts[0].kind, True, None, parts[0].dtype)

    def do_range(self, n: Node, s: Scope) -> Val:
        a, b = (self.build(p, s) for p in n.parts)
        return Val(sequences.span(as_number(a, "integer"), as_number(b, "integer")), "integer", True)

    def do_if(self, n: Node, s: Scope) -> Val:
        test, then, other = (self.build(p, s) for p in n.parts)
        if then.kind in NUMERIC and other.kind in NUMERIC and then.kind != other.kind and not then.many:
            kind = wider(then.kind, other.kind)
            then, other = replace(then, col=as_number(then, kind), kind=kind), replace(other, col=as_number(other, kind), kind=kind)
        if other.kind == "empty":
            return replace(then, col=F.when(library.boolean(test).col, then.col), const=None)
        return replace(then if then.kind != "empty" else other, col=F.when(library.boolean(test).col, then.col if then.kind != "empty" else F.lit(None)).otherwise(other.col), const=None)

    def do_logic(self, n: Node, s: Scope) -> Val:
        a, b = (library.boolean(self.build(p, s)).col for p in n.parts)
        return Val(a & b if n.name == "and" else a | b, "boolean")

    def do_concat(self, n: Node, s: Scope) -> Val:
        return library.find("concat", 2).build(*(self.build(p, s) for p in n.parts))

    def do_negate(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        return replace(v, col=-v.col, const=None)

    def do_arithmetic(self, n: Node, s: Scope) -> Val:
        a, b = (self.build(p, s) for p in n.parts)
        if "empty" in (a.kind, b.kind):
            return EMPTY
        a, b = (replace(v, col=v.col.cast("double"), kind="double") if v.kind == "string" else v for v in (a, b))
        if a.kind in NUMERIC and b.kind in NUMERIC:
            kind = wider(a.kind, b.kind)
            if n.name == "div":
                kind = "decimal" if kind == "integer" else kind
                return Val(numeric.divide(as_number(a, kind), as_number(b, kind), kind), kind)
            x, y = as_number(a, kind), as_number(b, kind)
            if n.name == "idiv":
                return Val(numeric.integer_divide(x, y) if kind != "double" else F.when(y == 0, F.raise_error(F.lit("FOAR0001: division by zero"))).otherwise((x / y).cast("long")), "integer")
            if n.name == "mod":
                return Val(numeric.modulo(x, y, kind), kind)
            return Val({"+": x + y, "-": x - y, "*": x * y}[n.name], kind)
        if n.name in ("+", "-"):
            moment = a.kind in ("date", "dateTime")
            kind = "dayTimeDuration" if moment and b.kind in ("date", "dateTime") else a.kind
            return Val(a.col + b.col if n.name == "+" else a.col - b.col, kind)
        return Val(a.col * b.col if n.name == "*" else a.col / b.col, a.kind if a.kind not in NUMERIC else b.kind)

    def do_general(self, n: Node, s: Scope) -> Val:
        a, b = (self.build(p, s) for p in n.parts)
        if "empty" in (a.kind, b.kind):
            return literal(False, "boolean")
        a, b, kind = comparable(a, b)
        return Val(sequences.general_compare(n.name, a.col, b.col, a.many, b.many, kind), "boolean")

    def do_value(self, n: Node, s: Scope) -> Val:
        a, b = (self.build(p, s) for p in n.parts)
        if "empty" in (a.kind, b.kind):
            return EMPTY
        a, b, kind = comparable(a, b)
        x, y = a.col, b.col
        test = {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[n.name]
        if kind == "double":
            fine = ~F.isnan(x) & ~F.isnan(y)
            test = test | ~fine if n.name == "ne" else test & fine
        return Val(test, "boolean")

    def do_node_compare(self, n: Node, s: Scope) -> Val:
        a, b = (F.struct(v.col["doc_id"], v.col["node_id"]) for v in (self.build(p, s) for p in n.parts))
        return Val({"is": a == b, "<<": a < b, ">>": a > b}[n.name], "boolean")

    def do_set(self, n: Node, s: Scope) -> Val:
        a, b = (self.build(p, s).seq() for p in n.parts)
        if a.kind != "node":
            raise PathTypeError("XPTY0004: set operators take nodes")
        return replace(a, col={"union": F.array_union, "intersect": F.array_intersect, "except": F.array_except}[n.name](a.col, b.col))

    def do_for(self, n: Node, s: Scope) -> Val:
        (name, source), rest = n.extra[0], n.extra[1:]
        body = Node("for", parts=n.parts, extra=rest) if rest else n.parts[0]
        v = self.build(source, s).seq()
        seen: list[Val] = []

        def each(x: Column) -> Column:
            got = self.build(body, s.bind(**{name: replace(v, col=x, many=False, const=None)}))
            seen.append(got)
            return got.col

        out = F.transform(v.col, each)
        return replace(seen[-1], col=F.flatten(out) if seen[-1].many else F.filter(out, lambda x: x.isNotNull()), many=True, const=None)

    def do_let(self, n: Node, s: Scope) -> Val:
        for name, value in n.extra:
            s = s.bind(**{name: self.build(value, s)})
        return self.build(n.parts[0], s)

    def _quantified(self, n: Node, s: Scope, some: bool) -> Val:
        (name, source), rest = n.extra[0], n.extra[1:]
        body = Node(n.kind, parts=n.parts, extra=rest) if rest else n.parts[0]
        v = self.build(source, s).seq()
        test = lambda x: library.boolean(self.build(body, s.bind(**{name: replace(v, col=x, many=False, const=None)}))).col
        return Val(F.exists(v.col, test) if some else F.forall(v.col, test), "boolean")

    def do_some(self, n: Node, s: Scope) -> Val:
        return self._quantified(n, s, True)

    def do_every(self, n: Node, s: Scope) -> Val:
        return self._quantified(n, s, False)

    def do_map(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        if not v.many:
            return self.build(n.parts[1], s.focus(v))
        seen: list[Val] = []

        def each(x: Column, i: Column) -> Column:
            got = self.build(n.parts[1], s.focus(replace(v, col=x, many=False, const=None), i + 1, F.size(v.col)))
            seen.append(got)
            return got.col

        out = F.transform(v.col, each)
        return replace(seen[-1], col=F.flatten(out) if seen[-1].many else out, many=True, const=None)

    def do_filter(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        test = n.parts[1]
        if v.kind == "empty":
            return v
        if not v.many:
            got = self.build(test, s.focus(v, F.lit(1), F.lit(1)))
            keep = got.col == 1 if got.kind in NUMERIC else library.boolean(got).col
            return replace(v, col=F.when(keep, v.col), const=None)
        probe = self.build(test, s.focus(replace(v, col=F.lit(None), many=False, const=None), F.lit(1), F.size(v.col)))
        if probe.kind in NUMERIC and not probe.many and not _positional(test):
            return replace(v, col=F.get(v.col, probe.col.cast("int") - 1), many=False, const=None)

        def keeps(x: Column, i: Column) -> Column:
            got = self.build(test, s.focus(replace(v, col=x, many=False, const=None), i + 1, F.size(v.col)))
            return got.col == i + 1 if got.kind in NUMERIC else library.boolean(got).col

        return replace(v, col=F.filter(v.col, keeps), const=None)

    def do_path(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        for step in n.parts[1:]:
            v = self._step(step, v, s)
        return v

    def _step(self, step: Node, v: Val, s: Scope) -> Val:
        if step.kind == "filter":
            return self.do_filter(Node("filter", parts=(_Built(self._step(step.parts[0], v, s)), step.parts[1])), s)
        if step.kind == "step":
            return self._child(step, v)
        if not v.many:
            return self.build(step, s.focus(v))
        return self.do_map(Node("map", parts=(_Built(v), step)), s)

    def do__built(self, n: Node, s: Scope) -> Val:
        return n.name

    def do_step(self, n: Node, s: Scope) -> Val:
        return self._child(n, self.do_context(n, s))

    def _child(self, n: Node, v: Val) -> Val:
        if n.name == "self":
            return v
        if n.name not in ("child", "attribute") or n.extra[0] != "name":
            if n.extra[:2] == ("kind", "text"):
                return v
            raise PathTypeError(f"the {n.name} axis needs a node table (operators.axes)")
        local = n.extra[2]
        if not isinstance(v.dtype, T.StructType):
            raise PathTypeError(f"XPTY0019: a step needs a record, not {v.kind}")
        options = (local, f"_{local}", f"@{local}") if n.name == "attribute" else (local,)
        found = next((f for o in options for f in v.dtype.fields if f.name == o), None)
        if found is None:
            raise PathTypeError(f"no column {local} among {v.dtype.names}")
        if v.kind == "row":
            return of_column(F.col(f"`{v.const}{found.name}`"), found.dataType)
        if not v.many:
            return of_column(v.col[found.name], found.dataType)
        got = of_column(F.transform(v.col, lambda x: x[found.name]), found.dataType)
        return replace(got, col=F.flatten(got.col) if got.many else F.filter(got.col, lambda x: x.isNotNull()), many=True)

    def do_lookup(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        if v.kind == "array" or isinstance(v.dtype, T.ArrayType):
            if len(n.parts) == 1:
                return library.find("array:flatten", 1).build(v)
            return library.find("array:get", 2).build(v, replace(self.build(n.parts[1], s)))
        if v.kind == "node":
            return self._child(Node("step", "child", extra=("name", "", str(n.parts[1].name))), v)
        if len(n.parts) == 1:
            values = library._value_kind(v)
            return replace(values, col=F.flatten(F.map_values(v.col)) if values.many else F.map_values(v.col), many=True)
        return library.find("map:get", 2).build(v, self.build(n.parts[1], s))

    def do_array(self, n: Node, s: Scope) -> Val:
        members = [self.build(p, s) for p in n.parts]
        kind = members[0].kind if members else "string"
        if members and {m.kind for m in members} <= set(NUMERIC):
            kind = reduce(wider, (m.kind for m in members))
            members = [m if m.many else replace(m, col=as_number(m, kind)) for m in members]
        types = {"integer": T.LongType(), "decimal": T.DecimalType(38, 18), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
        element = types.get(kind)
        if any(m.many for m in members):
            element = T.ArrayType(element) if element else None
            members = [m.seq() for m in members]
        elif members and members[0].kind == "array":
            element = members[0].dtype
        return Val(F.array(*(m.col for m in members)), "array", False, None, T.ArrayType(element) if element else None, name=kind)

    def do_array_of(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        types = {"integer": T.LongType(), "decimal": T.DecimalType(38, 18), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
        return Val(v.seq().col if v.kind != "empty" else F.array(), "array", False, None, T.ArrayType(types.get(v.kind, v.dtype or T.StringType())), name=v.kind)

    def do_map_constructor(self, n: Node, s: Scope) -> Val:
        pairs = [(self.build(k, s), self.build(v, s)) for k, v in n.extra]
        types = {"integer": T.LongType(), "decimal": T.DecimalType(38, 18), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
        kinds = {v.kind for _, v in pairs}
        kind = reduce(wider, kinds) if kinds <= set(NUMERIC) and kinds else next(iter(kinds), "string")
        value = types.get(kind, pairs[0][1].dtype if pairs else T.StringType())
        if any(v.many for _, v in pairs):
            value, pairs = T.ArrayType(value), [(k, v.seq()) for k, v in pairs]
        cols = [c for k, v in pairs for c in (k.col, as_number(v, kind) if kind in NUMERIC and not v.many else v.col)]
        return Val(F.create_map(*cols), "map", False, {k.const: v for k, v in pairs}, T.MapType(types.get(pairs[0][0].kind, T.StringType()) if pairs else T.StringType(), value))

    def do_function(self, n: Node, s: Scope) -> Val:
        body = n.parts[0]
        return Val(None, "function", fn=lambda *vs: self.build(body, s.bind(**dict(zip(n.extra, vs, strict=True)))), arity=len(n.extra))

    def do_reference(self, n: Node, s: Scope) -> Val:
        return library.reference(n.name, n.extra)

    def do_call(self, n: Node, s: Scope) -> Val:
        name, args = n.name, n.parts
        if name in ("position", "fn:position", "last", "fn:last") and not args:
            col = s.position if name.endswith("position") else s.size
            if col is None:
                raise PathTypeError(f"XPDY0002: {name}() needs a sequence as context")
            return Val(col.cast("long"), "integer")
        if name in XSD:
            return cast(self.build(args[0], s), name)
        if any(a.kind == "placeholder" for a in args):
            fixed = [None if a.kind == "placeholder" else self.build(a, s) for a in args]
            found = library.find(name, len(args))

            def partial(*vs: Val) -> Val:
                given = iter(vs)
                return found.build(*(next(given) if f is None else f for f in fixed))

            return Val(None, "function", fn=partial, arity=fixed.count(None))
        vals = [self.build(a, s) for a in args]
        full = name if ":" in name else f"fn:{name}"
        if not vals and 0 not in library.LIBRARY.get(full, library.find(name, 0) if full in library.LIBRARY else library.find(name, 1)).arities:
            vals = [self.do_context(n, s)]
        return library.find(name, len(vals)).build(*vals)

    def do_dynamic(self, n: Node, s: Scope) -> Val:
        f = self.build(n.parts[0], s)
        args = [self.build(p, s) for p in n.parts[1:]]
        if f.kind in ("map", "array"):
            return library.find(f"{f.kind}:get", 2).build(f, *args)
        return f.fn(*args)

    def do_instance(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        name, occurs = n.name.rstrip("?*+"), n.name[-1] if n.name[-1] in "?*+" else ""
        if v.kind == "empty":
            return literal(occurs in ("?", "*") or name == "empty-sequence()", "boolean")
        fits = name == "item()" or XSD.get(name, (name.split("(")[0],))[0] == v.kind or (name in ("xs:decimal",) and v.kind == "integer") or (name == "xs:numeric" and v.kind in NUMERIC) or name == "xs:anyAtomicType"
        count = F.size(v.col) if v.many else F.when(v.col.isNull(), 0).otherwise(1)
        test = {"": count == 1, "?": count <= 1, "*": count >= 0, "+": count >= 1}[occurs]
        return Val(test & F.lit(fits) | ((count == 0) & F.lit(occurs in ("?", "*"))), "boolean")

    def do_treat(self, n: Node, s: Scope) -> Val:
        v = self.build(n.parts[0], s)
        return replace(v, col=F.when(self.do_instance(n, s).col, v.col).otherwise(F.raise_error(F.lit(f"XPDY0050: no {n.name}"))))

    def do_cast(self, n: Node, s: Scope) -> Val:
        return cast(self.build(n.parts[0], s), n.name)

    def do_castable(self, n: Node, s: Scope) -> Val:
        return Val(castable_column(self.build(n.parts[0], s), n.name), "boolean")


def _Built(v: Val) -> Node:
    return Node("_built", v)


def _positional(n: Node) -> bool:
    """Whether an expression speaks of each item's own position."""
    return n.kind == "call" and n.name in ("position", "fn:position") or any(_positional(p) for p in n.parts if isinstance(p, Node))


# --- over tables


@dataclass(frozen=True)
class Rows:
    """A sequence of rows: the frame, the item in terms of its columns, and its order columns."""

    df: DataFrame
    item: Val
    order: tuple[str, ...]


class Query:
    """Expressions over tables bound as documents."""

    def __init__(self, tables: Mapping[str, tuple[DataFrame, list[str]]]):
        self.tables, self.rows = tables, RowCompiler()

    def run(self, text: str) -> DataFrame:
        """The result: one row per item; a map constructor's keys are columns, another item is ``value``."""
        return self.of(parse(text), Scope({}))

    def of(self, n: Node, s: Scope) -> DataFrame:
        if n.kind == "for":
            return self._for(n, s)
        if n.kind == "paren":
            return self.of(n.parts[0], s)
        if n.kind in ("some", "every"):
            rows = self._bound(n.extra, s)
            test = library.boolean(self.rows.build(n.parts[0], rows[1])).col
            found = F.coalesce(F.max(test.cast("int")) if n.kind == "some" else F.min(test.cast("int")), F.lit(0 if n.kind == "some" else 1))
            return rows[0].agg((found == 1).alias("value"))
        if n.kind == "call":
            return self._aggregate(n, s)
        rows = self.path(n, s)
        return rows.df.select(rows.item.col.alias("value")) if rows.item.kind != "row" else rows.df

    # paths

    def path(self, n: Node, s: Scope) -> Rows:
        """The rows of a path, a filter of one, a set operation of two, or a call that keeps rows."""
        if n.kind == "paren":
            return self.path(n.parts[0], s)
        if n.kind == "filter":
            return self._where(self.path(n.parts[0], s), n.parts[1], s)
        if n.kind == "set":
            a, b = (self.path(p, s) for p in n.parts)
            from sylvan.operators import joins

            make = {"union": joins.union, "intersect": joins.intersect, "except": joins.except_}[n.name]
            return replace(a, df=make(a.df, b.df, list(a.order)))
        if n.kind == "path" and n.parts[0].kind == "root":
            steps = list(n.parts[1:])
            name = _step_name(steps[0])
            if name not in self.tables:
                raise PathTypeError(f"no table {name}")
            df, order = self.tables[name]
            rows = Rows(df, row_item(df.schema), tuple(order))
            steps = [_Rooted(steps[0])] if steps[0].kind == "filter" and len(steps) == 1 else steps[1:]
            for k, step in enumerate(steps):
                rows = self._advance(rows, step, s, first=k == 0)
            return rows
        raise PathTypeError(f"a path over tables is wanted, not {n.kind}")

    def _advance(self, rows: Rows, step: Node, s: Scope, first: bool) -> Rows:
        if step.kind == "filter":
            return self._where(self._advance(rows, step.parts[0], s, first), step.parts[1], s)
        if first and step.kind == "step" and step.extra[0] == "name" and step.extra[2] in ("row", "*"):
            return rows
        v = self.rows._step(step, rows.item, s.focus(rows.item))
        if v.many:
            df = rows.df.withColumn("_item", F.explode(v.col))
            return replace(rows, df=df, item=of_column(F.col("_item"), df.schema["_item"].dataType))
        return replace(rows, df=rows.df.where(v.col.isNotNull()), item=v)

    def _where(self, rows: Rows, test: Node, s: Scope) -> Rows:
        inner = s.focus(rows.item)
        if test.kind == "logic" and test.name == "and":
            return self._where(self._where(rows, test.parts[0], s), test.parts[1], s)
        negated = test.kind == "call" and test.name in ("not", "fn:not")
        core = test.parts[0] if negated else test
        while core.kind == "paren":
            core = core.parts[0]
        exists = core.kind == "call" and core.name in ("exists", "fn:exists", "empty", "fn:empty")
        if exists and _rooted(core.parts[0]):
            return self._joined(rows, core.parts[0], None, None, inner, negated != (core.name.endswith("empty")))
        if core.kind == "general" and (_rooted(core.parts[0]) or _rooted(core.parts[1])):
            left = _rooted(core.parts[0])
            op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(core.name, core.name) if left else core.name
            return self._joined(rows, core.parts[0 if left else 1], core.parts[1 if left else 0], op, inner, negated)
        if test.kind == "literal" and test.extra == "integer":
            numbered = ordinal(rows.df, list(rows.order), "_pos") if test.name > 1 else None
            return replace(rows, df=numbered.where(F.col("_pos") == test.name).drop("_pos") if numbered is not None else rows.df.orderBy(*rows.order).limit(1))
        if test.kind == "call" and test.name in ("last", "fn:last"):
            return replace(rows, df=rows.df.orderBy(*(F.col(c).desc() for c in rows.order)).limit(1))
        if test.kind == "general" and test.parts[0].kind == "call" and test.parts[0].name in ("position", "fn:position"):
            if test.name == "<=" and test.parts[1].kind == "literal":
                return replace(rows, df=rows.df.orderBy(*rows.order).limit(test.parts[1].name))
            df = ordinal(rows.df, list(rows.order), "_pos")
            got = self.rows.build(test, inner.focus(rows.item, F.col("_pos")))
            return replace(rows, df=df.where(got.col).drop("_pos"))
        return replace(rows, df=rows.df.where(self.rows.condition(test, inner)))

    def _joined(self, rows: Rows, other: Node, mine: Node | None, op: str | None, s: Scope, anti: bool) -> Rows:
        """A[x op B/y], or A[B[...]] with variables: a semi join, or an anti join where it is negated."""
        there = self.path(other, s)
        if mine is None:
            some = there.df.select(F.lit(1).alias("_there")).limit(1)
            return replace(rows, df=rows.df.join(some, F.lit(1) == F.col("_there"), "left_anti" if anti else "left_semi"))
        a, b, _ = comparable(self.rows.build(mine, s), replace(there.item, col=F.col("_there")))
        values = there.df.select(there.item.col.alias("_there")).where("_there is not null")
        values = values.distinct() if op == "=" else values
        x, y = a.col, b.col
        test = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op in ("<", "<=", ">", ">="):  # a pair exists if one does with the extreme value
            values = values.agg((F.max if op in ("<", "<=") else F.min)("_there").alias("_there")).where("_there is not null")
        if op == "!=":  # one that differs exists if there are two, or one other
            values = values.agg(F.array_distinct(F.array(F.min("_there"), F.max("_there"))).alias("_ends")).select(F.explode("_ends").alias("_there")).where("_there is not null")
        return replace(rows, df=rows.df.join(values, test, "left_anti" if anti else "left_semi"))

    # for clauses

    def _bound(self, bound: tuple, s: Scope) -> tuple[DataFrame, Scope]:
        """The rows of all variables, prefixed by their names and joined by the predicates that name earlier ones."""
        df = None
        for name, source in bound:
            tests: list[Node] = []
            while source.kind == "filter" or source.kind == "path" and source.parts[-1].kind == "filter":
                if source.kind == "filter":
                    tests.append(source.parts[1])
                    source = source.parts[0]
                else:
                    tests.append(source.parts[-1].parts[1])
                    source = Node("path", parts=(*source.parts[:-1], source.parts[-1].parts[0]))
            rows = self.path(source, s)
            if rows.item.kind != "row":
                rows = replace(rows, df=rows.df.select(rows.item.col.alias("value"), *rows.order), item=rows.item)
            free = [t for t in tests if not _variables(t) & set(s.variables)]
            for t in free:
                rows = self._where(rows, t, s)
            prefix = f"{name}__"
            named = rows.df.select(*(F.col(c).alias(prefix + c) for c in rows.df.columns))
            item = row_item(rows.df.schema, prefix) if rows.item.kind == "row" else of_column(F.col(prefix + "value"), rows.df.schema["value"].dataType)
            linked = [t for t in tests if t not in free]
            on = [library.boolean(self.rows.build(t, s.focus(item))).col if t.kind != "general" else self._equal(t, s.focus(item)) for t in linked]
            df = named if df is None else df.join(named, reduce(lambda a, b: a & b, on) if on else F.lit(True))
            s = s.bind(**{name: item})
        return df, s

    def _equal(self, t: Node, s: Scope) -> Column:
        """A comparison as a join condition: a plain operator, which Spark can hash on."""
        a, b, _ = comparable(*(self.rows.build(p, s) for p in t.parts))
        if a.many or b.many:
            return self.rows.build(t, s).col
        x, y = a.col, b.col
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[t.name]

    def _for(self, n: Node, s: Scope) -> DataFrame:
        df, s = self._bound(n.extra, s)
        body = n.parts[0]
        while body.kind == "let":
            for name, value in body.extra:
                s = s.bind(**{name: self.rows.build(value, s)})
            body = body.parts[0]
        if body.kind == "if" and body.parts[2] == Node("sequence"):
            df, body = df.where(self.rows.condition(body.parts[0], s)), body.parts[1]
        if body.kind == "map-constructor":
            return df.select(*(self.rows.build(v, s).col.alias(str(k.name)) for k, v in body.extra))
        v = self.rows.build(body, s)
        return df.select(F.explode(v.col).alias("value")) if v.many else df.select(v.col.alias("value")).where("value is not null")

    # aggregates

    def _aggregate(self, n: Node, s: Scope) -> DataFrame:
        name = n.name.removeprefix("fn:")
        source = n.parts[0]
        frame = self.of(source, s) if source.kind == "for" else None
        rows = None if frame is not None else self.path(source, s)
        df, item = (frame, of_column(F.col("value"), frame.schema["value"].dataType)) if frame is not None else (rows.df, rows.item)
        if name == "count":
            return df.agg(F.count("*").alias("value"))
        if name in ("exists", "empty"):
            there = df.limit(1).agg(F.count("*").alias("n"))
            return there.select(((F.col("n") > 0) if name == "exists" else (F.col("n") == 0)).alias("value"))
        x = item.col
        if name == "distinct-values":
            return df.select(x.alias("value")).distinct()
        if name == "sum":
            return df.agg(F.coalesce(F.sum(x), F.lit(0)).alias("value"))
        if name == "avg":
            return df.agg((F.avg(x) if item.kind == "double" else F.avg(x.cast("decimal(28,8)"))).alias("value"))
        if name in ("min", "max"):
            value = F.min(x) if name == "min" else F.max(x)
            if item.kind == "double":
                value = F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(value)
            return df.agg(value.alias("value"))
        if name == "string-join":
            separator = n.parts[1].name if len(n.parts) > 1 else ""
            keys = list(rows.order) if rows is not None else ["value"]
            parts = F.array_sort(F.collect_list(F.struct(*(F.col(k) for k in keys), strings.string(x, item.kind).alias("_s"))))
            return df.agg(F.array_join(F.transform(parts, lambda p: p["_s"]), separator).alias("value"))
        if name in ("head", "tail", "reverse", "sort"):
            raise PathTypeError(f"{name} over a table: use operators.ordering")
        raise PathTypeError(f"{name} is no aggregate over a table")


def _Rooted(step: Node) -> Node:
    return replace(step, parts=(Node("step", "child", extra=("name", "", "row")), *step.parts[1:]))


def _step_name(n: Node) -> str:
    return _step_name(n.parts[0]) if n.kind == "filter" else n.extra[2]


def _rooted(n: Node) -> bool:
    """Whether an expression is a path from a table."""
    return n.kind == "path" and n.parts[0].kind == "root" or n.kind in ("paren", "filter") and _rooted(n.parts[0])


def _variables(n: Node) -> set[str]:
    found = {n.name} if n.kind == "variable" else set()
    for p in n.parts:
        if isinstance(p, Node):
            found |= _variables(p)
    return found


__all__ = ["Query", "Rows", "Scope", "cast", "compile_row", "kind_of", "row_item"]
