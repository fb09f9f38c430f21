"""map:* and array:* functions, and JSON. Positions count from 1; those outside an array fail with FOAY0001."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan.functions import sequences


def map_contains(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def map_entry(key: Column, value: Column) -> Column:
    return F.create_map(key, value)


def map_get(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def map_keys(m: Column) -> Column:
    return F.map_keys(m)


def map_size(m: Column) -> Column:
    return F.size(F.map_keys(m))


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value))


def map_remove(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(keys, k))


def map_for_each(m: Column, action: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.map_entries(m), lambda e: action(e["key"], e["value"]))


def map_merge(*maps: Column, duplicates: str = "use-first") -> Column:
    """use-first, use-last or reject, for keys in several maps."""
    if duplicates == "reject":
        return F.map_concat(*maps)
    if duplicates not in ("use-first", "use-last", "use-any"):
        raise ValueError(f"FOJS0005: duplicates={duplicates}")
    ordered = maps if duplicates != "use-last" else maps[::-1]
    out = ordered[0]
    for more in ordered[1:]:
        out = F.map_concat(out, _without(more, out))
    return out


def _without(m: Column, held: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(held, k))


def map_find(values: Column, key: str) -> Column:
    """All values of a key at any depth of JSON text, as an array of JSON texts in document order."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def walk(v: object, out: list[str]) -> list[str]:
            if isinstance(v, dict):
                if key in v:
                    out.append(json.dumps(v[key]))
                for x in v.values():
                    walk(x, out)
            elif isinstance(v, list):
                for x in v:
                    walk(x, out)
            return out

        return texts.map(lambda t: walk(json.loads(t), []) if t is not None else [])

    return run(values)


def _at(a: Column, position: Column, top: Column, then: Column) -> Column:
    return F.when((position >= 1) & (position <= top), then).otherwise(F.raise_error(F.lit("FOAY0001: position outside the array")))


def array_get(a: Column, position: Column) -> Column:
    return _at(a, position, F.size(a), F.get(a, position - 1))


def array_head(a: Column) -> Column:
    return array_get(a, F.lit(1))


def array_tail(a: Column) -> Column:
    return F.when(F.size(a) > 0, sequences.tail(a)).otherwise(F.raise_error(F.lit("FOAY0001: the array is empty")))


def array_size(a: Column) -> Column:
    return F.size(a)


def array_append(a: Column, member: Column) -> Column:
    return F.array_append(a, member)


def array_put(a: Column, position: Column, member: Column) -> Column:
    return _at(a, position, F.size(a), F.transform(a, lambda x, i: F.when(i == position - 1, member).otherwise(x)))


def array_insert_before(a: Column, position: Column, member: Column) -> Column:
    return _at(a, position, F.size(a) + 1, F.concat(F.slice(a, F.lit(1), F.greatest(position - 1, F.lit(0))), F.array(member), F.slice(a, F.greatest(position, F.lit(1)), F.size(a))))


def array_remove(a: Column, positions: Column) -> Column:
    return F.filter(a, lambda x, i: ~F.array_contains(positions, i + 1))


def array_subarray(a: Column, start: Column, length: Column | None = None) -> Column:
    size = F.size(a) - start + 1 if length is None else length
    fine = F.when(size < 0, F.raise_error(F.lit("FOAY0002: negative length"))).otherwise(F.slice(a, F.greatest(start, F.lit(1)), F.greatest(size, F.lit(0))))
    return F.when((start >= 1) & (start + F.greatest(size, F.lit(0)) <= F.size(a) + 1), fine).otherwise(F.raise_error(F.lit("FOAY0001: outside the array")))


def array_flatten(a: Column, levels: int = 1) -> Column:
    for _ in range(levels):
        a = F.flatten(a)
    return a


def array_join(*arrays: Column) -> Column:
    return F.concat(*arrays)


array_reverse, array_for_each, array_filter = sequences.reverse, sequences.for_each, sequences.keep
array_fold_left, array_fold_right, array_for_each_pair, array_sort = sequences.fold_left, sequences.fold_right, sequences.for_each_pair, sequences.sort


def parse_json(text: Column) -> Column:
    return F.parse_json(text)


def json_get(text: Column, path: str, kind: str = "string") -> Column:
    """One value of JSON text by a path such as $.a.b[0]; absent and null are empty."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def to_json(value: Column) -> Column:
    return F.to_json(value)


def json_to_xml(text: Column) -> Column:
    """The XML vocabulary of JSON: map, array, string, number, boolean and null elements, with key attributes."""
    from xml.sax.saxutils import escape, quoteattr

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def node(v: object, key: str | None, top: bool = False) -> str:
            attrs = (' xmlns="http://www.w3.org/2005/xpath-functions"' if top else "") + (f" key={quoteattr(key)}" if key is not None else "")
            if v is None:
                return f"<null{attrs}/>"
            if isinstance(v, bool):
                return f"<boolean{attrs}>{str(v).lower()}</boolean>"
            if isinstance(v, dict):
                return f"<map{attrs}>" + "".join(node(x, k) for k, x in v.items()) + "</map>"
            if isinstance(v, list):
                return f"<array{attrs}>" + "".join(node(x, None) for x in v) + "</array>"
            return f"<string{attrs}>{escape(v)}</string>" if isinstance(v, str) else f"<number{attrs}>{v}</number>"

        def first_wins(pairs: list[tuple[str, object]]) -> dict:
            out: dict = {}
            for k, v in pairs:
                out.setdefault(k, v)
            return out

        return texts.map(lambda t: node(json.loads(t, object_pairs_hook=first_wins), None, True) if t is not None else None)

    return run(text)


def xml_to_json(text: Column) -> Column:
    """The way back from json_to_xml."""
    import xml.etree.ElementTree as ET

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def value(e: ET.Element) -> str:
            kind = e.tag.rpartition("}")[2]
            if kind == "null":
                return "null"
            if kind == "boolean":
                return "true" if (e.text or "").strip() in ("true", "1") else "false"
            if kind == "number":
                n = float(e.text or "nan")
                return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)
            if kind == "string":
                return json.dumps("".join(e.itertext()), ensure_ascii=False)
            if kind == "array":
                return "[" + ",".join(value(x) for x in e) + "]"
            if kind == "map":
                return "{" + ",".join(json.dumps(x.get("key"), ensure_ascii=False) + ":" + value(x) for x in e) + "}"
            raise ValueError(f"FOJS0006: unknown element {kind}")

        return texts.map(lambda t: value(ET.fromstring(t)) if t is not None else None)

    return run(text)
