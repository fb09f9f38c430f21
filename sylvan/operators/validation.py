"""Validation of tables and trees: all errors are collected, none stops the run.

Errors are rows (doc, path, code, message). Facets, nullability, assertions and
content models are conditions on a row; unique and key are counts of their
fields; keyref is an anti join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions import regex
from sylvan.operators import axes
from sylvan.plans.query import INTEGER_RANGES, XSD, castable_column, compile_row
from sylvan.plans.values import Val

@dataclass(frozen=True)
class Simple:
    """A simple type: a base type with facets, a list of one, or a union of several."""

    base: str = "xs:string"
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    enumeration: tuple = ()
    min_inclusive: object = None
    max_inclusive: object = None
    min_exclusive: object = None
    max_exclusive: object = None
    total_digits: int | None = None
    fraction_digits: int | None = None
    white_space: str = "preserve"
    item: Simple | None = None
    members: tuple[Simple, ...] = ()

    def failures(self, value: Column, typed: bool = False) -> list[tuple[str, Column]]:
        """(code, condition that the value breaks it); never true of null."""
        if self.item is not None:
            tokens = F.split(F.trim(F.regexp_replace(value, r"[ \t\r\n]+", " ")), " ")
            return [("cvc-simple-type.list", F.exists(tokens, lambda t: self.item._broken(t))), *self._sizes(F.size(tokens))]
        if self.members:
            return [("cvc-simple-type.union", reduce(lambda a, b: a & b, (m._broken(value) for m in self.members)))]
        text = value.cast("string")
        if self.white_space == "collapse":
            text = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
        elif self.white_space == "replace":
            text = F.regexp_replace(text, r"[\t\r\n]", " ")
        out: list[tuple[str, Column]] = []
        low, high = INTEGER_RANGES.get(self.base, (None, None))
        base = "xs:integer" if self.base in INTEGER_RANGES else self.base
        kind, spark, _ = XSD.get(base, XSD["xs:string"])
        if not typed and kind != "string":
            out.append(("cvc-datatype-valid.1", ~castable_column(Val(text, "string"), base)))
        number = value if typed else text.try_cast("decimal(38,10)" if kind in ("integer", "decimal") else spark)
        bounds = (("minInclusive", self.min_inclusive if self.min_inclusive is not None else low, lambda v, b: v < b), ("maxInclusive", self.max_inclusive if self.max_inclusive is not None else high, lambda v, b: v > b), ("minExclusive", self.min_exclusive, lambda v, b: v <= b), ("maxExclusive", self.max_exclusive, lambda v, b: v >= b))
        out += [(f"cvc-{name}-valid", broken(number, F.lit(bound))) for name, bound, broken in bounds if bound is not None]
        out += self._sizes(F.char_length(text))
        if self.pattern is not None:
            out.append(("cvc-pattern-valid", ~F.rlike(text, F.lit(r"\A(?:" + regex.translate(self.pattern) + r")\z"))))
        if self.enumeration:
            out.append(("cvc-enumeration-valid", ~value.isin(*self.enumeration)))
        digits = F.regexp_replace(F.regexp_replace(text, r"^[+-]?0*", ""), r"(\.\d*?)0+$", "$1")
        if self.total_digits is not None:
            out.append(("cvc-totalDigits-valid", F.char_length(F.regexp_replace(digits, r"\.", "")) > self.total_digits))
        if self.fraction_digits is not None:
            out.append(("cvc-fractionDigits-valid", F.char_length(F.regexp_extract(digits, r"\.(\d*)$", 1)) > self.fraction_digits))
        return out

    def _sizes(self, n: Column) -> list[tuple[str, Column]]:
        rules = (("length", self.length, lambda b: n != b), ("minLength", self.min_length, lambda b: n < b), ("maxLength", self.max_length, lambda b: n > b))
        return [(f"cvc-{name}-valid", test(bound)) for name, bound, test in rules if bound is not None]

    def _broken(self, value: Column) -> Column:
        tests = [F.coalesce(c, F.lit(False)) for _, c in self.failures(value)]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


@dataclass(frozen=True)
class RecordType:
    """A record: its fields' types, those that must be there, and assertions in the path language."""

    fields: dict[str, Simple]
    required: tuple[str, ...] = ()
    assertions: tuple[str, ...] = ()
    fixed: dict[str, object] = field(default_factory=dict)


def validate_records(df: DataFrame, record: RecordType, doc: list[str]) -> DataFrame:
    """(doc, path, code, message) of all rows: one pass, no shuffle."""
    checks: list[tuple[str, str, Column]] = []
    for name, simple in record.fields.items():
        typed = not isinstance(df.schema[name].dataType, T.StringType)
        checks += [(name, code, broken) for code, broken in simple.failures(F.col(name), typed)]
    checks += [(name, "cvc-complex-type.4", F.col(name).isNull()) for name in record.required]
    checks += [(name, "cvc-attribute.4", F.col(name) != F.lit(value)) for name, value in record.fixed.items()]
    checks += [("", "cvc-assertion", ~compile_row(test, df.schema)) for test in record.assertions]
    if not checks:
        return df.limit(0).select(F.lit("").alias("doc"), F.lit("").alias("path"), F.lit("").alias("code"), F.lit("").alias("message"))
    errors = F.filter(F.array(*(F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.concat_ws("=", F.lit(path), F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("message"))) for path, code, broken in checks)), lambda e: e.isNotNull())
    return df.select(F.concat_ws(",", *(F.col(c).cast("string") for c in doc)).alias("doc"), F.explode(errors).alias("e")).select("doc", "e.*")


def not_unique(df: DataFrame, fields: list[str]) -> DataFrame:
    """unique: tuples, complete ones only, that occur more than once, with their number."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fields))
    return df.where(whole).groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")


def not_key(df: DataFrame, fields: list[str]) -> DataFrame:
    """key: as unique, and rows that lack a field (n = 0)."""
    lacks = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in fields))
    return not_unique(df, fields).unionByName(df.where(lacks).select(*fields, F.lit(0).cast("long").alias("n")))


def dangling(df: DataFrame, fields: list[str], key: DataFrame, key_fields: list[str]) -> DataFrame:
    """keyref: rows whose complete tuple is in no key."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fields))
    there = key.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key_fields)))
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_k{i}") for i, c in enumerate(fields)))
    return df.where(whole).join(there, on, "left_anti")


@dataclass(frozen=True)
class Particle:
    """A content model: an element name, or a sequence, choice or all of particles, with its numbers of occurrence."""

    name: str | None = None
    kind: str = "element"
    parts: tuple[Particle, ...] = ()
    least: int = 1
    most: int | None = 1

    def pattern(self) -> str:
        """A regular expression over names, each followed by a comma."""
        if self.kind == "element":
            body = f"(?:{re.escape(self.name)},)"
        elif self.kind == "any":
            body = "(?:[^,]+,)"
        elif self.kind == "choice":
            body = "(?:" + "|".join(p.pattern() for p in self.parts) + ")"
        elif self.kind == "all":
            return "".join(f"(?=(?:[^,]+,)*?{p.pattern()}|\\z)" if p.least else "" for p in self.parts) + "(?:" + "|".join(p.pattern() for p in self.parts) + f"){{0,{len(self.parts)}}}"
        else:
            body = "(?:" + "".join(p.pattern() for p in self.parts) + ")"
        return body if (self.least, self.most) == (1, 1) else body + f"{{{self.least},{'' if self.most is None else self.most}}}"


def validate_content(nodes: DataFrame, models: dict[str, Particle]) -> DataFrame:
    """Elements of a node table whose children's names don't follow their model: (doc, path, code, message)."""
    elements = nodes.where("kind = 'element'")
    children = elements.select("doc_id", F.col("parent_id").alias("node_id"), F.struct("node_id", "local").alias("child"))
    lists = children.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["local"]), ",").alias("names"))
    rows = axes.joined(elements.where(F.col("local").isin(*models)).select("doc_id", "node_id", "local"), lists, ["doc_id", "node_id"], "left")
    text = F.when(F.col("names").isNotNull(), F.concat("names", F.lit(","))).otherwise("")
    fits = reduce(lambda a, b: a | b, ((F.col("local") == name) & F.rlike(text, F.lit(r"\A" + m.pattern() + r"\z")) for name, m in models.items()))
    return rows.where(~fits).select(F.col("doc_id").alias("doc"), F.concat("local", F.lit("#"), "node_id").alias("path"), F.lit("cvc-complex-type.2.4").alias("code"), F.coalesce("names", F.lit("")).alias("message"))


def schema_view(df: DataFrame) -> DataFrame:
    """The components of a frame's schema as rows: path, type, nullable."""

    def walk(dtype: T.DataType, path: str) -> list[tuple[str, str, bool]]:
        if isinstance(dtype, T.StructType):
            return [x for f in dtype.fields for x in ((f"{path}/{f.name}", f.dataType.simpleString(), f.nullable), *walk(f.dataType, f"{path}/{f.name}"))]
        return walk(dtype.elementType, path + "/*") if isinstance(dtype, T.ArrayType) else []

    return df.sparkSession.createDataFrame(walk(df.schema, ""), "path string, type string, nullable boolean")
