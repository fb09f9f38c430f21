"""String, URI and collation functions. Null stands for the empty sequence: where it acts as '' it is turned into one."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan.functions import regex

#: Collations by URI, as Spark names them.
COLLATIONS = {
    "http://www.w3.org/2005/xpath-functions/collation/codepoint": "UTF8_BINARY",
    "http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive": "UTF8_LCASE",
    "http://www.w3.org/2013/collation/UCA": "UNICODE",
    "http://www.w3.org/2013/collation/UCA?strength=secondary": "UNICODE_CI",
    "http://www.w3.org/2013/collation/UCA?strength=primary": "UNICODE_CI_AI",
}
_XML_SPACE = "[ \\t\\r\\n]+"


def collation(uri: str | None) -> str:
    if uri is None:
        return "UTF8_BINARY"
    if uri not in COLLATIONS:
        raise ValueError(f"FOCH0002: unknown collation {uri}")
    return COLLATIONS[uri]


def _text(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def _collated(s: Column, uri: str | None) -> Column:
    return F.collate(_text(s), collation(uri)) if uri else _text(s)


def of_number(x: Column, kind: str) -> Column:
    """The canonical text of a number: no trailing zeros; exponents only from 1e6 and below 1e-6."""
    if kind == "integer":
        return x.cast("string")
    if kind == "decimal":
        return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = (F.abs(x) >= 1e-6) & (F.abs(x) < 1e6)
    shortest = x.cast("string")
    without = F.regexp_replace(shortest, r"\.0$", "")
    readable = F.when(F.contains(shortest, F.lit("E")), F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")).otherwise(without)
    wide = F.when(F.contains(shortest, F.lit("E")), shortest).otherwise(_scientific(x))
    return F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("INF")).when(x == float("-inf"), F.lit("-INF")).when(x == 0, F.when(shortest.startswith("-"), F.lit("-0")).otherwise(F.lit("0"))).when(small, readable).otherwise(wide)


def _scientific(x: Column) -> Column:
    """A mantissa with one digit before the point, for doubles that Spark writes without an exponent."""
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.abs(x).cast("decimal(38,10)").cast("string"), r"\.?0+$", ""), r"\.", "")
    digits = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    tail = F.substr(digits, F.lit(2))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.when(tail == "", F.lit("0")).otherwise(tail), F.lit("E"), exponent.cast("string"))


def string(x: Column, kind: str = "string") -> Column:
    if kind in ("integer", "decimal", "double"):
        return of_number(x, kind)
    if kind == "dateTime":
        return F.regexp_replace(F.regexp_replace(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return x.cast("string")


def concat(*parts: Column) -> Column:
    return F.concat(*(_text(p.cast("string")) for p in parts))


def compare(a: Column, b: Column, uri: str | None = None) -> Column:
    a2, b2 = (F.collate(a, collation(uri)), F.collate(b, collation(uri))) if uri else (a, b)
    return F.when(a2 < b2, -1).when(a2 > b2, 1).when(a2 == b2, 0)


def codepoint_equal(a: Column, b: Column) -> Column:
    return a == b


def contains(a: Column, b: Column, uri: str | None = None) -> Column:
    return F.contains(_collated(a, uri), _collated(b, uri))


def starts_with(a: Column, b: Column, uri: str | None = None) -> Column:
    return F.startswith(_collated(a, uri), _collated(b, uri))


def ends_with(a: Column, b: Column, uri: str | None = None) -> Column:
    return F.endswith(_collated(a, uri), _collated(b, uri))


def substring_before(a: Column, b: Column, uri: str | None = None) -> Column:
    at = F.instr(_collated(a, uri), _collated(b, uri))
    return F.when(at > 0, F.substr(_text(a), F.lit(1), at - 1)).otherwise(F.lit(""))


def substring_after(a: Column, b: Column, uri: str | None = None) -> Column:
    at = F.instr(_collated(a, uri), _collated(b, uri))
    return F.when(at > 0, F.substr(_text(a), at + F.char_length(_text(b)))).otherwise(F.lit(""))


def contains_token(tokens: Column, token: Column, uri: str | None = None) -> Column:
    """``tokens``: an array of strings, each of white-space separated tokens."""
    wanted = F.trim(F.regexp_replace(token, _XML_SPACE, " "))
    wanted = F.collate(wanted, collation(uri)) if uri else wanted
    return F.coalesce((wanted != "") & F.exists(tokens, lambda s: F.array_contains(F.split(F.trim(F.regexp_replace(s, _XML_SPACE, " ")), " "), wanted)), F.lit(False))


def lower_case(s: Column) -> Column:
    return F.lower(_text(s))


def upper_case(s: Column) -> Column:
    return F.upper(_text(s))


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(_text(s), _XML_SPACE, " "))


def string_length(s: Column) -> Column:
    return F.char_length(_text(s))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Positions p with round(start) <= p < round(start) + round(length), rounding halves up; NaN selects nothing."""
    first = F.floor(F.when(F.isnan(start.cast("double")), F.lit(1e9)).otherwise(F.greatest(F.least(start.cast("double"), F.lit(1e9)), F.lit(-1e9))) + 0.5)
    if length is None:
        return F.substr(_text(s), F.greatest(first, F.lit(1)).cast("int"))
    size = F.floor(F.when(F.isnan(length.cast("double")), F.lit(-1.0)).otherwise(F.greatest(F.least(length.cast("double"), F.lit(2e9)), F.lit(-1.0))) + 0.5)
    begin = F.greatest(first, F.lit(1))
    count = F.least(F.greatest(first + size - begin, F.lit(0)), F.lit(2147483647))
    return F.substr(_text(s), begin.cast("int"), count.cast("int"))


def translate(s: Column, a: str, b: str) -> Column:
    return F.translate(_text(s), a, b)


def string_join(items: Column, separator: str = "") -> Column:
    return F.coalesce(F.array_join(F.transform(items, lambda x: x.cast("string")), separator), F.lit(""))


def string_to_codepoints(s: Column) -> Column:
    return F.when(_text(s) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(s, ""), F.ascii))


def matches(s: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(_text(s), F.lit(regex.translate(pattern, flags)))


def replace(s: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(_text(s), regex.translate(pattern, flags), regex.replacement(by, flags))


def tokenize(s: Column, pattern: str | None = None, flags: str = "") -> Column:
    if pattern is None:
        text = normalize_space(s)
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
    return F.when(_text(s) == "", F.array().cast("array<string>")).otherwise(F.split(s, regex.translate(pattern, flags)))


def encode_for_uri(s: Column) -> Column:
    out = F.url_encode(_text(s))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _by_value(name: str, fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """An Arrow function over strings, '' for null; each distinct value of a batch is worked out once."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        values = values.fillna("")
        return values.map({v: fn(v) for v in values.unique()})

    def call(s: Column) -> Column:
        return run(s)

    call.__name__ = name
    return call


def iri_to_uri(s: Column) -> Column:
    return _by_value("iri_to_uri", lambda v: quote(v, safe="!#$%&'()*+,-./:;=?@[]_~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))(s)


def escape_html_uri(s: Column) -> Column:
    return _by_value("escape_html_uri", lambda v: "".join(c if " " <= c <= "~" else quote(c, safe="") for c in v))(s)


def normalize_unicode(s: Column, form: str = "NFC") -> Column:
    form = form.strip().upper()
    if form == "":
        return _text(s)
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"FOCH0003: unknown normalization form {form}")
    return _by_value("normalize_unicode", lambda v: unicodedata.normalize(form, v))(s)


def resolve_uri(relative: Column, base: str) -> Column:
    return F.when(relative.isNotNull(), _by_value("resolve_uri", lambda v: urljoin(base, v))(relative))


def codepoints_to_string(codes: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "".join(map(chr, v)) if v is not None else "")

    return run(codes)


def collation_key(s: Column, uri: str | None = None) -> Column:
    """A binary that is equal for strings equal under the collation: the code points, folded where it folds case."""
    if collation(uri) == "UTF8_BINARY":
        return F.encode(_text(s), "UTF-8")
    folded = _text(s) if collation(uri) == "UTF8_LCASE" else normalize_unicode(s, "NFKD")
    return F.encode(F.lower(folded), "UTF-8")


def analyze_string(s: Column, pattern: str, flags: str = "") -> Column:
    """array<struct<is_match, text, groups>>: the string's matching and other parts in order."""
    java = regex.translate(pattern, flags)
    text = _text(s)
    between = F.split(text, java)
    hits = F.regexp_extract_all(text, F.lit(f"({java})"), F.lit(1))
    count = _group_count(java)
    groups = [F.regexp_extract_all(text, F.lit(java), F.lit(g)) for g in range(1, count + 1)]
    none = F.array().cast("array<string>")

    def part(t: Column, i: Column) -> Column:
        plain = F.struct(F.lit(False).alias("is_match"), t.alias("text"), none.alias("groups"))
        found = F.array(*(F.get(g, i) for g in groups)) if groups else none
        hit = F.struct(F.lit(True).alias("is_match"), F.get(hits, i).alias("text"), found.alias("groups"))
        return F.array(plain, hit)

    parts = F.flatten(F.transform(between, part))
    return F.filter(parts, lambda p: p["text"].isNotNull() & (p["text"] != ""))


def _group_count(java: str) -> int:
    count, at, depth = 0, 0, 0
    while at < len(java):
        if java[at] == "\\":
            at += 1
        elif java[at] == "[":
            depth += 1
        elif java[at] == "]" and depth:
            depth -= 1
        elif java[at] == "(" and not depth and java[at + 1 : at + 2] != "?":
            count += 1
        at += 1
    return count
