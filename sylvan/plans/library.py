"""The function library: what each named function compiles to.

``class`` of a function: C a Spark expression as it is; A one with an adapter; P an
Arrow function; R a relational plan (see plans.query and operators); D settled
while compiling; X not provided.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions import collections as C
from sylvan.functions import datetimes as D
from sylvan.functions import formats, numeric, sequences, strings
from sylvan.plans.values import NUMERIC, PathTypeError, Val, as_number, literal


@dataclass(frozen=True)
class Function:
    name: str
    arities: tuple[int, ...]
    kind: str
    build: Callable[..., Val] | None


LIBRARY: dict[str, Function] = {}


def _add(name: str, arities: int | tuple[int, ...], kind: str, build: Callable[..., Val] | None) -> None:
    LIBRARY[name] = Function(name, (arities,) if isinstance(arities, int) else arities, kind, build)


def const(v: Val, what: str = "argument") -> object:
    if v.const is None and v.kind != "empty":
        raise PathTypeError(f"{what} must be a literal")
    return v.const


def _s(v: Val) -> Column:
    """As text: numbers in their canonical form, nothing as null."""
    if v.many:
        return strings.string_join(v.col)
    return strings.string(v.col, v.kind) if v.kind != "empty" else F.lit(None).cast("string")


def _atoms(v: Val) -> Val:
    return v.seq() if v.kind != "empty" else Val(F.array().cast("array<string>"), "string", True)


def _string1(fn: Callable[[Column], Column], kind: str = "string") -> Callable[..., Val]:
    return lambda v: Val(fn(_s(v)), kind)


def _string2(fn: Callable[..., Column], kind: str) -> Callable[..., Val]:
    return lambda a, b, c=None: Val(fn(_s(a), _s(b), *([const(c, "collation")] if c else [])), kind)


def _number1(fn: Callable[[Column, str], Column]) -> Callable[..., Val]:
    def build(v: Val) -> Val:
        v = v if v.kind in NUMERIC else replace(v, col=v.col.cast("double"), kind="double")
        return Val(fn(v.col, v.kind), v.kind)

    return build


def _math(fn: Callable[..., Column]) -> Callable[..., Val]:
    return lambda *vs: Val(fn(*(as_number(v, "double") for v in vs)), "double")


def _date(fn: Callable[[Column], Column], kind: str = "integer") -> Callable[..., Val]:
    return lambda v: Val(fn(v.col), kind)


def boolean(v: Val) -> Val:
    if v.kind == "empty":
        return literal(False, "boolean")
    if v.kind in ("map", "array", "function"):
        raise PathTypeError(f"FORG0006: a {v.kind} has no boolean value")
    return Val(sequences.effective_boolean(v.col, v.kind if v.kind != "any" else "node", v.many), "boolean")


def _sum(v: Val, zero: Val | None = None) -> Val:
    v = _atoms(v)
    if v.kind == "string":
        v = replace(v, col=F.transform(v.col, lambda x: x.cast("double")), kind="double")
    return Val(sequences.total(v.col, zero.col if zero else None), v.kind)


def _avg(v: Val) -> Val:
    v = _atoms(v)
    kind = "double" if v.kind in ("double", "string") else "decimal"
    return Val(sequences.average(v.col, kind), kind)


def _extreme(fn: Callable[[Column, str], Column]) -> Callable[..., Val]:
    return lambda v, c=None: Val(fn(_atoms(v).col, v.kind), v.kind)


def _lambda(f: Val, *kinds: Val) -> Callable[..., Column]:
    """A function item as a function over columns, its arguments typed like ``kinds``."""
    if f.fn is None:
        raise PathTypeError("XPTY0004: a function is wanted")

    def call(*cols: Column) -> Column:
        return f.fn(*(replace(k, col=c, many=False, const=None) for k, c in zip(kinds, cols, strict=True))).col

    # Spark looks at the number of parameters
    return (lambda x: call(x)) if len(kinds) == 1 else (lambda x, y: call(x, y))


def _item(v: Val) -> Val:
    return Val(None, v.kind, False, None, v.dtype)


def _result(f: Val, *kinds: Val) -> Val:
    """The kind of a function item's result, by compiling it once on placeholders."""
    return f.fn(*(replace(k, col=F.lit(None), many=False) for k in kinds))


def _for_each(v: Val, f: Val) -> Val:
    v = _atoms(v)
    got = _result(f, _item(v))
    return Val(sequences.for_each(v.col, _lambda(f, _item(v)), got.many), got.kind, True, None, got.dtype)


def _filter(v: Val, f: Val) -> Val:
    v = _atoms(v)
    return replace(v, col=sequences.keep(v.col, _lambda(f, _item(v))), const=None)


def _fold(right: bool) -> Callable[..., Val]:
    def build(v: Val, zero: Val, f: Val) -> Val:
        v = _atoms(v)
        state = Val(None, zero.kind)
        order = (_item(v), state) if right else (state, _item(v))
        kind = _result(f, *order).kind
        start = zero
        if zero.kind in NUMERIC and kind in NUMERIC and kind != zero.kind:
            start = Val(as_number(zero, kind), kind)
            state = Val(None, kind)
            order = (_item(v), state) if right else (state, _item(v))
        if start.kind == "integer":
            start = replace(start, col=start.col.cast("long"))
        step = _lambda(f, *order)
        return Val((sequences.fold_right if right else sequences.fold_left)(v.col, start.col, step), start.kind)

    return build


def _pairs(a: Val, b: Val, f: Val) -> Val:
    a, b = _atoms(a), _atoms(b)
    return Val(sequences.for_each_pair(a.col, b.col, _lambda(f, _item(a), _item(b))), _result(f, _item(a), _item(b)).kind, True)


def _sort(v: Val, collation: Val | None = None, key: Val | None = None) -> Val:
    v = _atoms(v)
    made = _lambda(key, _item(v)) if key else None
    return replace(v, col=sequences.sort(v.col, made, _result(key, _item(v)).kind if key else v.kind), const=None)


def _cardinality(fn: Callable[[Column], Column], many: bool) -> Callable[..., Val]:
    return lambda v: replace(_atoms(v), col=fn(_atoms(v).col), many=many, const=None)


def _positional(fn: Callable[..., Column], many: bool) -> Callable[..., Val]:
    return lambda v, *rest: replace(_atoms(v), col=fn(_atoms(v).col, *(r.col for r in rest)), many=many, const=None)


def _map(fn: Callable[..., Column], kind: str, many: bool = False) -> Callable[..., Val]:
    return lambda *vs: Val(fn(*(v.col for v in vs)), kind, many, None, None)


def _value_kind(m: Val) -> Val:
    from sylvan.plans.values import of_column

    dtype = getattr(m.dtype, "valueType", None)
    return of_column(F.lit(None), dtype) if dtype is not None else Val(None, "any")


def _map_get(m: Val, k: Val) -> Val:
    return replace(_value_kind(m), col=C.map_get(m.col, k.col))


def _same(fn: Callable[..., Column]) -> Callable[..., Val]:
    """Arrays and maps: the result is of the first argument's kind."""
    return lambda v, *rest: replace(v, col=fn(v.col, *(r.col for r in rest)), const=None)


def _member(fn: Callable[..., Column]) -> Callable[..., Val]:
    from sylvan.plans.values import of_column

    def build(v: Val, *rest: Val) -> Val:
        element = getattr(v.dtype, "elementType", None)
        base = of_column(F.lit(None), element) if element is not None else Val(None, "any")
        return replace(base, col=fn(v.col, *(r.col for r in rest)))

    return build


def _error(code: Val | None = None, text: Val | None = None, value: Val | None = None) -> Val:
    message = F.concat_ws(": ", *(x.col.cast("string") for x in (code or literal("FOER0000", "string"), text) if x is not None))
    return Val(F.raise_error(message), "any")


def _map_merge(v: Val, options: Val | None = None) -> Val:
    """Later maps give the keys that earlier ones lack, or the other way round; reject raises for a key of two maps."""
    chosen = options.const.get("duplicates") if options is not None and isinstance(options.const, dict) else None
    duplicates = str(const(chosen, "duplicates")) if chosen is not None else "use-first"
    start = F.create_map().cast(v.dtype.simpleString()) if v.dtype is not None else F.create_map()
    if duplicates == "reject":
        clash = F.lit("FOJS0003: a key of several maps")
        merged = lambda a, b: F.when(F.arrays_overlap(F.map_keys(a), F.map_keys(b)), F.raise_error(clash)).otherwise(C.map_merge(a, b))
    else:
        merged = lambda a, b: C.map_merge(a, b, duplicates=duplicates)
    return Val(F.aggregate(v.col, start, merged), "map", False, None, v.dtype)


# aggregates over a sequence in a row; over rows of a table see plans.query
_add("fn:count", 1, "C", lambda v: Val(sequences.count(_atoms(v).col).cast("long"), "integer"))
_add("fn:sum", (1, 2), "A", _sum)
_add("fn:avg", 1, "A", _avg)
_add("fn:min", (1, 2), "A", _extreme(sequences.minimum))
_add("fn:max", (1, 2), "A", _extreme(sequences.maximum))
_add("fn:distinct-values", (1, 2), "R", lambda v, c=None: replace(_atoms(v), col=sequences.distinct_values(_atoms(v).col)))
# sequences, booleans, functions of functions
_add("fn:apply", 2, "D", lambda f, a: f.fn(*(Val(F.get(a.col, i), "any") for i in range(f.arity))))
_add("fn:available-environment-variables", 0, "D", lambda: Val(F.array().cast("array<string>"), "string", True))
_add("fn:environment-variable", 1, "D", lambda n: Val(F.lit(None).cast("string"), "string"))
_add("fn:boolean", 1, "A", boolean)
_add("fn:not", 1, "A", lambda v: Val(~boolean(v).col, "boolean"))
_add("fn:true", 0, "C", lambda: literal(True, "boolean"))
_add("fn:false", 0, "C", lambda: literal(False, "boolean"))
_add("fn:data", 1, "A", lambda v: v)
_add("fn:deep-equal", (2, 3), "A", lambda a, b, c=None: Val(sequences.deep_equal(a.col, b.col), "boolean"))
_add("fn:default-collation", 0, "D", lambda: literal(next(iter(strings.COLLATIONS)), "string"))
_add("fn:default-language", 0, "D", lambda: literal("en", "string"))
_add("fn:empty", 1, "A", lambda v: Val(sequences.empty(_atoms(v).col) if v.many or v.kind == "empty" else v.col.isNull(), "boolean"))
_add("fn:exists", 1, "A", lambda v: Val(sequences.exists(_atoms(v).col) if v.many or v.kind == "empty" else v.col.isNotNull(), "boolean"))
_add("fn:error", (0, 1, 2, 3), "C", _error)
_add("fn:exactly-one", 1, "A", _cardinality(sequences.exactly_one, False))
_add("fn:one-or-more", 1, "A", _cardinality(sequences.one_or_more, True))
_add("fn:zero-or-one", 1, "A", _cardinality(sequences.zero_or_one, False))
_add("fn:filter", 2, "C", _filter)
_add("fn:fold-left", 3, "A", _fold(False))
_add("fn:fold-right", 3, "A", _fold(True))
_add("fn:for-each", 2, "C", _for_each)
_add("fn:for-each-pair", 3, "C", _pairs)
_add("fn:function-arity", 1, "D", lambda f: literal(f.arity, "integer"))
_add("fn:function-lookup", 2, "D", lambda n, a: reference(str(const(n)), int(const(a))))
_add("fn:function-name", 1, "D", lambda f: literal(f.name or "", "string"))
_add("fn:head", 1, "C", _cardinality(sequences.head, False))
_add("fn:tail", 1, "C", _cardinality(sequences.tail, True))
_add("fn:reverse", 1, "C", _cardinality(sequences.reverse, True))
_add("fn:unordered", 1, "C", lambda v: v)
_add("fn:trace", (1, 2), "D", lambda v, label=None: v)
_add("fn:index-of", (2, 3), "A", lambda v, x, c=None: Val(sequences.index_of(_atoms(v).col, x.col, v.kind), "integer", True))
_add("fn:insert-before", 3, "A", lambda v, p, i: replace(_atoms(v), col=sequences.insert_before(_atoms(v).col, p.col.cast("int"), _atoms(i).col), const=None))
_add("fn:remove", 2, "A", _positional(sequences.remove, True))
_add("fn:subsequence", (2, 3), "A", _positional(sequences.subsequence, True))
_add("fn:sort", (1, 2, 3), "A", _sort)
_add("fn:last", 0, "R", None)
_add("fn:position", 0, "R", None)
_add("fn:load-xquery-module", (1, 2), "X", None)
_add("fn:transform", 1, "D", None)
_add("fn:random-number-generator", (0, 1), "P", lambda seed=None: Val(formats.random_numbers((seed or literal(0, "integer")).col, 8), "double", True))
# strings
_add("fn:analyze-string", (2, 3), "A", lambda s, p, f=None: Val(strings.analyze_string(_s(s), str(const(p)), str(const(f)) if f else ""), "node", True))
_add("fn:codepoint-equal", 2, "C", _string2(strings.codepoint_equal, "boolean"))
_add("fn:codepoints-to-string", 1, "P", lambda v: Val(strings.codepoints_to_string(_atoms(v).col), "string"))
_add("fn:collation-key", (1, 2), "P", lambda s, c=None: Val(strings.collation_key(_s(s), const(c) if c else None), "binary"))
_add("fn:compare", (2, 3), "A", _string2(strings.compare, "integer"))
_add("fn:concat", tuple(range(2, 40)), "A", lambda *vs: Val(strings.concat(*map(_s, vs)), "string"))
_add("fn:contains", (2, 3), "A", _string2(strings.contains, "boolean"))
_add("fn:contains-token", (2, 3), "A", lambda s, t, c=None: Val(strings.contains_token(_atoms(s).col, _s(t), const(c) if c else None), "boolean"))
_add("fn:encode-for-uri", 1, "A", _string1(strings.encode_for_uri))
_add("fn:ends-with", (2, 3), "A", _string2(strings.ends_with, "boolean"))
_add("fn:escape-html-uri", 1, "P", _string1(strings.escape_html_uri))
_add("fn:iri-to-uri", 1, "P", _string1(strings.iri_to_uri))
_add("fn:lower-case", 1, "C", _string1(strings.lower_case))
_add("fn:upper-case", 1, "C", _string1(strings.upper_case))
_add("fn:matches", (2, 3), "A", lambda s, p, f=None: Val(strings.matches(_s(s), str(const(p, "pattern")), str(const(f)) if f else ""), "boolean"))
_add("fn:normalize-space", 1, "A", _string1(strings.normalize_space))
_add("fn:normalize-unicode", (1, 2), "P", lambda s, f=None: Val(strings.normalize_unicode(_s(s), str(const(f)) if f else "NFC"), "string"))
_add("fn:replace", (3, 4), "A", lambda s, p, r, f=None: Val(strings.replace(_s(s), str(const(p, "pattern")), str(const(r, "replacement")), str(const(f)) if f else ""), "string"))
_add("fn:resolve-uri", (1, 2), "P", lambda s, b: Val(strings.resolve_uri(_s(s), str(const(b, "base"))), "string"))
_add("fn:starts-with", (2, 3), "A", _string2(strings.starts_with, "boolean"))
_add("fn:string", 1, "A", lambda v: Val(F.coalesce(_s(v), F.lit("")), "string"))
_add("fn:string-join", (1, 2), "C", lambda v, s=None: Val(strings.string_join(_atoms(v).col, str(const(s)) if s else ""), "string"))
_add("fn:string-length", 1, "A", _string1(strings.string_length, "integer"))
_add("fn:string-to-codepoints", 1, "A", lambda s: Val(strings.string_to_codepoints(_s(s)), "integer", True))
_add("fn:substring", (2, 3), "A", lambda s, a, n=None: Val(strings.substring(_s(s), a.col, n.col if n else None), "string"))
_add("fn:substring-after", (2, 3), "A", _string2(strings.substring_after, "string"))
_add("fn:substring-before", (2, 3), "A", _string2(strings.substring_before, "string"))
_add("fn:tokenize", (1, 2, 3), "A", lambda s, p=None, f=None: Val(strings.tokenize(_s(s), str(const(p)) if p else None, str(const(f)) if f else ""), "string", True))
_add("fn:translate", 3, "C", lambda s, a, b: Val(strings.translate(_s(s), str(const(a)), str(const(b))), "string"))
# numbers
_add("fn:abs", 1, "C", _number1(lambda x, k: numeric.absolute(x)))
_add("fn:ceiling", 1, "A", _number1(numeric.ceiling))
_add("fn:floor", 1, "A", _number1(numeric.floor))
_add("fn:round", (1, 2), "A", lambda v, p=None: Val(numeric.round_up(v.col, int(const(p)) if p else 0, v.kind), v.kind))
_add("fn:round-half-to-even", (1, 2), "C", lambda v, p=None: Val(numeric.round_half_even(v.col, int(const(p)) if p else 0), v.kind))
_add("fn:number", 1, "A", lambda v: Val(numeric.number(v.col), "double"))
_add("fn:format-integer", (2, 3), "P", lambda v, p, lang=None: Val(formats.format_integer(v.col, str(const(p, "picture"))), "string"))
_add("fn:format-number", (2, 3), "P", lambda v, p, f=None: Val(formats.format_number(v.col, str(const(p, "picture")), formats.DECIMAL_FORMATS[str(const(f))] if f and f.kind != "empty" else None), "string"))
for _name, _fn in {"acos": numeric.acos, "asin": numeric.asin, "atan": numeric.atan, "cos": numeric.cos, "exp": numeric.exp, "exp10": numeric.exp10, "log": numeric.log, "log10": numeric.log10, "sin": numeric.sin, "sqrt": numeric.sqrt, "tan": numeric.tan}.items():
    _add(f"math:{_name}", 1, "A" if _name.startswith("log") else "C", _math(_fn))
_add("math:atan2", 2, "C", _math(numeric.atan2))
_add("math:pow", 2, "C", _math(numeric.power))
_add("math:pi", 0, "C", lambda: Val(numeric.pi(), "double"))
# dates, times, durations
for _part, _fn in {"year": D.year, "month": D.month, "day": D.day}.items():
    _add(f"fn:{_part}-from-dateTime", 1, "C", _date(_fn))
    _add(f"fn:{_part}-from-date", 1, "C", _date(_fn))
for _part, _fn in {"hours": D.hours, "minutes": D.minutes}.items():
    _add(f"fn:{_part}-from-dateTime", 1, "C", _date(_fn))
    _add(f"fn:{_part}-from-time", 1, "C", _date(_fn))
_add("fn:seconds-from-dateTime", 1, "A", _date(D.seconds, "decimal"))
_add("fn:seconds-from-time", 1, "A", _date(D.seconds, "decimal"))
for _part in ("years", "months", "days", "hours", "minutes", "seconds"):
    _add(f"fn:{_part}-from-duration", 1, "C" if _part != "seconds" else "A", lambda v, part=_part: Val(D.of_duration(part, v.col), "decimal" if part == "seconds" else "integer"))
for _what in ("date", "dateTime", "time"):
    _add(f"fn:adjust-{_what}-to-timezone", (1, 2), "A", lambda v, z=None: Val(D.adjust_to_timezone(v.col, None if z is None or z.kind == "empty" else z.col), "zoned"))
    _add(f"fn:timezone-from-{_what}", 1, "A", lambda v: Val(D.timezone(v.col), "dayTimeDuration"))
    _add(f"fn:format-{_what}", (2, 5), "P", lambda v, p, *rest: Val(D.format_value(v.col, str(const(p, "picture"))), "string"))
_add("fn:current-date", 0, "C", lambda: Val(D.current_date(), "date"))
_add("fn:current-dateTime", 0, "C", lambda: Val(D.current_date_time(), "dateTime"))
_add("fn:current-time", 0, "C", lambda: Val(D.current_time(), "time"))
_add("fn:dateTime", 2, "A", lambda d, t: Val(D.date_time(d.col, t.col), "dateTime"))
_add("fn:implicit-timezone", 0, "D", lambda: Val(D.implicit_timezone(), "dayTimeDuration"))
_add("fn:parse-ietf-date", 1, "P", lambda s: Val(D.parse_ietf_date(_s(s)), "dateTime"))


# nodes: a row of a node table (sources.nodes) is a struct with these fields
def _part(v: Val, name: str) -> Column:
    """A field of a node, or of the context row where that is a row of a node table."""
    if v.kind not in ("row", "node", "QName", "any") or isinstance(v.dtype, T.StructType) and name not in v.dtype.names:
        raise PathTypeError(f"XPTY0004: a node is wanted, not {v.kind}")
    return F.col(f"`{v.const}{name}`") if v.kind == "row" else v.col[name]


def _field(name: str, kind: str = "string") -> Callable[..., Val]:
    return lambda v: Val(_part(v, name), kind)


_add("fn:base-uri", 1, "A", _field("doc_id"))
_add("fn:document-uri", 1, "A", _field("doc_id"))
_add("fn:generate-id", 1, "A", lambda v: Val(F.concat(F.lit("id"), _part(v, "doc_id").cast("string"), F.lit("_"), _part(v, "node_id").cast("string")), "string"))
_add("fn:has-children", 1, "A", lambda v: Val(_part(v, "size") > 0, "boolean"))
_add("fn:local-name", 1, "C", _field("local"))
_add("fn:name", 1, "A", lambda v: Val(F.concat_ws(":", F.nullif(_part(v, "prefix"), F.lit("")), _part(v, "local")), "string"))
_add("fn:namespace-uri", 1, "C", _field("ns"))
_add("fn:node-name", 1, "A", lambda v: Val(F.struct(_part(v, "ns").alias("uri"), _part(v, "local").alias("local"), _part(v, "prefix").alias("prefix")), "QName"))
_add("fn:nilled", 1, "C", lambda v: Val(F.coalesce(F.try_element_at(_part(v, "attrs"), F.lit("xsi:nil")) == "true", F.lit(False)), "boolean"))
_add("fn:in-scope-prefixes", 1, "A", lambda v: Val(F.map_keys(_part(v, "ns_in_scope")), "string", True))
_add("fn:namespace-uri-for-prefix", 2, "A", lambda p, v: Val(F.try_element_at(_part(v, "ns_in_scope"), F.coalesce(p.col, F.lit(""))), "string"))
_add("fn:QName", 2, "A", lambda u, n: Val(F.struct(u.col.alias("uri"), F.element_at(F.split(n.col, ":"), -1).alias("local"), F.when(F.contains(n.col, F.lit(":")), F.substring_index(n.col, ":", 1)).otherwise("").alias("prefix")), "QName"))
_add("fn:resolve-QName", 2, "A", lambda n, v: Val(F.struct(F.try_element_at(_part(v, "ns_in_scope"), F.when(F.contains(n.col, F.lit(":")), F.substring_index(n.col, ":", 1)).otherwise("")).alias("uri"), F.element_at(F.split(n.col, ":"), -1).alias("local"), F.when(F.contains(n.col, F.lit(":")), F.substring_index(n.col, ":", 1)).otherwise("").alias("prefix")), "QName"))
_add("fn:local-name-from-QName", 1, "C", _field("local"))
_add("fn:namespace-uri-from-QName", 1, "C", _field("uri"))
_add("fn:prefix-from-QName", 1, "C", _field("prefix"))
_add("fn:static-base-uri", 0, "D", lambda: literal("", "string"))
for _name in ("element-with-id", "id", "idref", "innermost", "outermost", "lang", "path", "root"):
    _add(f"fn:{_name}", (0, 1, 2), "R", None)  # plans over node tables: operators.axes
# documents and JSON
for _name in ("collection", "doc", "doc-available", "unparsed-text", "unparsed-text-available", "unparsed-text-lines", "uri-collection", "json-doc", "parse-xml", "parse-xml-fragment"):
    _add(f"fn:{_name}", (0, 1, 2), "D" if _name.endswith("available") else "R", None)  # sources.files and sources.nodes
_add("fn:parse-json", (1, 2), "A", lambda s, o=None: Val(C.parse_json(_s(s)), "any"))
_add("fn:json-to-xml", (1, 2), "P", lambda s, o=None: Val(C.json_to_xml(_s(s)), "string"))
_add("fn:xml-to-json", (1, 2), "P", lambda s, o=None: Val(C.xml_to_json(_s(s)), "string"))
_add("fn:serialize", (1, 2), "P", lambda v, o=None: Val(C.to_json(v.col) if v.kind in ("map", "array", "node") or v.many else _s(v), "string"))
# maps
_add("map:contains", 2, "C", _map(C.map_contains, "boolean"))
_add("map:entry", 2, "C", _map(C.map_entry, "map"))
_add("map:find", 2, "P", lambda v, k: Val(F.transform(C.map_find(C.to_json(v.col) if v.kind != "string" else v.col, str(const(k))), lambda x: F.get_json_object(x, "$")), "string", True))
_add("map:for-each", 2, "A", lambda m, f: Val(C.map_for_each(m.col, _lambda(f, Val(None, "any"), _value_kind(m))), _result(f, Val(None, "any"), _value_kind(m)).kind, True))
_add("map:get", 2, "C", _map_get)
_add("map:keys", 1, "C", _map(C.map_keys, "any", True))
_add("map:merge", (1, 2), "A", _map_merge)
_add("map:put", 3, "A", _same(C.map_put))
_add("map:remove", 2, "A", lambda m, k: replace(m, col=C.map_remove(m.col, _atoms(k).col), const=None))
_add("map:size", 1, "C", _map(C.map_size, "integer"))
# arrays
_add("array:append", 2, "C", _same(C.array_append))
_add("array:filter", 2, "C", lambda a, f: replace(a, col=C.array_filter(a.col, _lambda(f, _element(a)))))
_add("array:flatten", 1, "A", lambda a: Val(a.col, _element(a).kind, True, None, getattr(a.dtype, "elementType", None)))
_add("array:fold-left", 3, "C", lambda a, z, f: _fold(False)(_members(a), z, f))
_add("array:fold-right", 3, "A", lambda a, z, f: _fold(True)(_members(a), z, f))
_add("array:for-each", 2, "C", lambda a, f: replace(a, col=C.array_for_each(a.col, _lambda(f, _element(a))), dtype=None))
_add("array:for-each-pair", 3, "A", lambda a, b, f: replace(a, col=C.array_for_each_pair(a.col, b.col, _lambda(f, _element(a), _element(b))), dtype=None))
_add("array:get", 2, "A", _member(C.array_get))
_add("array:head", 1, "A", _member(C.array_head))
_add("array:insert-before", 3, "C", _same(C.array_insert_before))
_add("array:join", 1, "C", lambda v: Val(F.flatten(v.col) if v.many else v.col, "array", False, None, v.dtype))
_add("array:put", 3, "A", _same(C.array_put))
_add("array:remove", 2, "A", lambda a, p: replace(a, col=C.array_remove(a.col, F.transform(_atoms(p).col, lambda x: x.cast("int")))))
_add("array:reverse", 1, "C", _same(C.array_reverse))
_add("array:size", 1, "C", _map(C.array_size, "integer"))
_add("array:sort", (1, 2, 3), "C", lambda a, c=None, f=None: replace(a, col=C.array_sort(a.col, _lambda(f, _element(a)) if f else None, _result(f, _element(a)).kind if f else _element(a).kind)))
_add("array:subarray", (2, 3), "A", lambda a, s, n=None: replace(a, col=C.array_subarray(a.col, s.col.cast("int"), n.col.cast("int") if n else None)))
_add("array:tail", 1, "A", _same(C.array_tail))


def _element(a: Val) -> Val:
    from sylvan.plans.values import kind_of

    element = getattr(a.dtype, "elementType", None)
    return Val(None, kind_of(element) if element is not None else (a.name or "any"), False, None, element)


def _members(a: Val) -> Val:
    return replace(a, many=True, kind=_element(a).kind, dtype=getattr(a.dtype, "elementType", None))


def find(name: str, arity: int) -> Function:
    full = name if ":" in name else f"fn:{name}"
    found = LIBRARY.get(full)
    if found is None or arity not in found.arities:
        raise PathTypeError(f"XPST0017: no function {full}#{arity}")
    if found.build is None:
        raise PathTypeError(f"XPST0017: {full} is a plan over tables, not an expression in a row (class {found.kind})")
    return found


def reference(name: str, arity: int) -> Val:
    """A function item of a named function."""
    f = find(name, arity)
    return Val(None, "function", fn=f.build, arity=arity, name=f.name)


def register_function(name: str, arity: int, build: Callable[..., Val]) -> None:
    """A host function: ``build`` makes a Val of Vals."""
    _add(name if ":" in name else f"fn:{name}", arity, "D", build)


def define_function(name: str, parameters: list[str], body: str) -> None:
    """A user function by the text of its body; calls are inlined. Recursive ones have no plan."""
    from sylvan.plans.parser import parse
    from sylvan.plans.query import RowCompiler, Scope

    tree = parse(body)
    register_function(name, len(parameters), lambda *vs: RowCompiler().build(tree, Scope(dict(zip(parameters, vs, strict=True)))))
