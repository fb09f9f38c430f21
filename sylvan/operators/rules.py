"""Template rules over rows: dispatch by pattern, modes, next-match, row-level try and messages.

A set of rules becomes one dispatch expression, so that every row is matched in the
scan that reads it; what a rule makes is a struct, and what several rules make for
one row (next-match) is an array of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """match: a condition on the row; make: what it becomes; higher precedence, then priority, then the later rule wins."""

    match: Column
    make: Column
    priority: float = 0.5
    precedence: int = 0
    name: str = ""


class Mode:
    """A rule set. on_no_match: deep-skip and shallow-skip drop the row, copy keeps ``default``, fail raises XTDE0555."""

    def __init__(self, *rules: Rule, on_no_match: str = "shallow-skip", default: Column | None = None):
        if on_no_match not in ("deep-skip", "shallow-skip", "text-only-copy", "shallow-copy", "deep-copy", "fail"):
            raise ValueError(f"XTSE0020: on-no-match={on_no_match}")
        ranked = sorted(enumerate(rules), key=lambda x: (x[1].precedence, x[1].priority, x[0]), reverse=True)
        self.rules, self.policy, self.default = [r for _, r in ranked], on_no_match, default

    def _otherwise(self) -> Column | None:
        if self.policy == "fail":
            return F.raise_error(F.lit("XTDE0555: no rule matches"))
        return None if self.policy.endswith("skip") else self.default

    def dispatch(self) -> Column:
        """What the best rule makes; null where the row is skipped."""
        out = None
        for r in self.rules:
            out = F.when(r.match, r.make) if out is None else out.when(r.match, r.make)
        rest = self._otherwise()
        return out if rest is None or out is None else out.otherwise(rest)

    def rule_name(self) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for r in self.rules:
            out = out.when(r.match, F.lit(r.name))
        return out

    def apply(self, df: DataFrame, name: str = "result") -> DataFrame:
        """apply-templates: rows that no rule matches are left out where they are skipped; a rule may make null."""
        if self.policy.endswith("skip"):
            df = df.where(reduce(lambda a, b: a | b, (F.coalesce(r.match, F.lit(False)) for r in self.rules), F.lit(False)))
        return df.withColumn(name, self.dispatch())

    def next_match(self, depth: int = 2) -> Column:
        """What the best ``depth`` matching rules make, best first: rules that call next-match."""
        made = F.filter(F.array(*(F.when(r.match, F.struct(r.make.alias("made"))) for r in self.rules)), lambda x: x.isNotNull())
        return F.transform(F.slice(made, 1, depth), lambda x: x["made"])


def apply_recursively(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Column, most: int) -> DataFrame:
    """Bounded recursion of a template: rows go through ``step`` until ``done``; beyond ``most`` rounds it is an error."""
    for _ in range(most):
        df = df.where(done).unionByName(step(df.where(~done)))
    return df.withColumn("_done", F.when(done, True).otherwise(F.raise_error(F.lit("XTDE0640: recursion too deep")).cast("boolean"))).where("_done").drop("_done")


def try_catch(body: Column, fallback: Column, *reads: Column) -> Column:
    """try/catch in a row: ``body`` is built of try_ functions, which are null on error. Where one of the columns that it
    ``reads`` is null, an empty result is a success and stays empty; without ``reads`` every empty result is an error."""
    if not reads:
        return F.coalesce(body, fallback)
    return F.when(body.isNull() & reduce(lambda a, b: a & b, (c.isNotNull() for c in reads)), fallback).otherwise(body)


def attempt(run: Callable[[], DataFrame], handlers: dict[str, Callable[[Exception], DataFrame]]) -> DataFrame:
    """try/catch of a plan: the result is computed once; the handler of the first code that the error names answers ("*": any)."""
    try:
        out = run()
        out.write.format("noop").mode("overwrite").save()
        return out
    except Exception as e:
        for code, handler in handlers.items():
            if code == "*" or code in str(e):
                return handler(e)
        raise


def where_populated(df: DataFrame, item: Column, fallback: Column) -> Column:
    """on-empty: the fallback where an array is empty."""
    return F.when(F.coalesce(F.size(item), F.lit(0)) > 0, item).otherwise(fallback)


def assert_(test: Column, code: str = "XTMM9001", text: str = "assertion failed") -> Column:
    """xsl:assert in a row: true, or an error."""
    return F.when(F.coalesce(test, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"{code}: {text}")))


def messages(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """Messages as metrics: how many rows meet each condition, gathered while the frame is computed."""
    seen = Observation(name)
    return df.observe(seen, *(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in counts.items())), seen


def copy_of(df: DataFrame, except_: list[str] | None = None, **changes: Column) -> DataFrame:
    """copy and copy-of: the row with some columns left out or made anew."""
    return df.drop(*(except_ or [])).withColumns(changes)


def map_of(key: Column, value: Column) -> Column:
    """xsl:map of map-entries as an aggregate; a repeated key is XTDE3365 (Spark raises)."""
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def text_of(*parts: Column, separator: str = " ") -> Column:
    """value-of: the parts that are there, joined."""
    return F.concat_ws(separator, *(p.cast("string") for p in parts))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
