"""Pictures of numbers: fn:format-integer, fn:format-number and fn:random-number-generator's streams."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def words(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + ("" if n % 10 == 0 else "-" + ONES[n % 10])
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            return words(n // size) + " " + name + ("" if not rest else (" and " if rest < 100 else " ") + words(rest))
    return str(n)


def ordinal_words(n: int) -> str:
    text = words(n)
    cut = max(text.rfind(" "), text.rfind("-")) + 1
    last = text[cut:]
    last = ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return text[:cut] + last


def _letters(n: int, first: str) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(ord(first) + k) + out
    return out


def format_integer_value(n: int, picture: str) -> str:
    form, _, modifier = picture.rpartition(";") if ";" in picture else (picture, "", "")
    ordinal = modifier.startswith("o")
    sign, m = ("-" if n < 0 else ""), abs(n)
    if form in ("a", "A"):
        return sign + (_letters(m, form) if m else "0")
    if form in ("i", "I"):
        out, rest = "", m
        if not 0 < m < 5000:
            return sign + str(m)
        for size, text in ROMAN:
            out += text * (rest // size)
            rest %= size
        return sign + (out if form == "I" else out.lower())
    if form in ("w", "W", "Ww"):
        text = ordinal_words(m) if ordinal else words(m)
        text = text.upper() if form == "W" else text.title().replace(" And ", " and ") if form == "Ww" else text
        return sign + text
    digits = [c for c in form if c.isdigit() or c == "#"]
    if not digits:
        return sign + str(m)
    zero = next((ord(c) - int(c) for c in form if c.isdigit()), ord("0"))
    text = str(m).rjust(sum(c.isdigit() for c in form), "0")
    groups = [(sum(x.isdigit() or x == "#" for x in form[i + 1 :]), c) for i, c in enumerate(form) if not (c.isdigit() or c == "#")]
    sizes = sorted(g for g, _ in groups)
    regular = bool(groups) and len({c for _, c in groups}) == 1 and all(g == sizes[0] * (k + 1) for k, g in enumerate(sizes))
    out = ""
    for i, c in enumerate(text):
        left = len(text) - i
        mark = groups[0][1] if regular and left % sizes[0] == 0 else next((x for g, x in groups if g == left), "")
        out += (mark if i else "") + chr(zero + int(c))
    if ordinal:
        out += "th" if 10 <= m % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(m % 10, "th")
    return sign + out


def format_integer(x: Column, picture: str) -> Column:
    if picture == "1" or picture == "0":
        return F.coalesce(x.cast("string"), F.lit(""))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "" if pd.isna(v) else format_integer_value(int(v), picture))

    return run(x)


DEFAULT_FORMAT = {"decimal": ".", "grouping": ",", "minus": "-", "percent": "%", "per-mille": "‰", "zero": "0", "digit": "#", "pattern": ";", "exponent": "e", "infinity": "Infinity", "NaN": "NaN"}


#: Named decimal formats, each what differs from the default.
DECIMAL_FORMATS: dict[str, dict[str, str]] = {}


def decimal_format(name: str, **symbols: str) -> None:
    """Declare a named format; two declarations of one name must agree (XTSE1290)."""
    if DECIMAL_FORMATS.get(name, symbols) != symbols:
        raise ValueError(f"XTSE1290: two decimal formats {name}")
    if unknown := set(symbols) - set(DEFAULT_FORMAT):
        raise ValueError(f"XTSE0090: unknown symbol {sorted(unknown)[0]}")
    DECIMAL_FORMATS[name] = symbols


def format_number_value(v: float | Decimal | None, picture: str, names: dict[str, str] | None = None) -> str:
    f = DEFAULT_FORMAT | (names or {})
    if v is None or v != v:
        return f["NaN"]
    positive, has, negative = picture.partition(f["pattern"])
    minus = v < 0 or str(v).startswith("-")
    part = negative if minus and has else positive
    zero, digit = f["zero"], f["digit"]
    active = {chr(ord(zero) + k) for k in range(10)} | {digit, f["decimal"], f["grouping"]}
    start = next((i for i, c in enumerate(part) if c in active), len(part))
    end = max((i for i, c in enumerate(part) if c in active), default=-1) + 1
    prefix, body, suffix = part[:start], part[start:end], part[end:]
    if minus and not has:
        prefix = f["minus"] + prefix
    if abs(v) == float("inf"):
        return prefix + f["infinity"] + suffix
    exponent_digits = 0
    if f["exponent"] in body and all(c in active for c in body.replace(f["exponent"], "", 1)):
        body, _, e = body.partition(f["exponent"])
        exponent_digits = len(e)
    number = abs(Decimal(repr(v)) if isinstance(v, float) else Decimal(v))
    if f["percent"] in prefix + suffix:
        number *= 100
    if f["per-mille"] in prefix + suffix:
        number *= 1000
    whole, _, fraction = body.partition(f["decimal"])
    is_digit = lambda c: c == digit or c in active and c not in (f["decimal"], f["grouping"])
    least_whole = sum(is_digit(c) and c != digit for c in whole)
    least, most = sum(is_digit(c) and c != digit for c in fraction), sum(is_digit(c) for c in fraction)
    power = 0
    if exponent_digits and number:
        power = number.adjusted() - max(least_whole, 1) + 1
        number = number.scaleb(-power)
    number = number.quantize(Decimal(1).scaleb(-most), ROUND_HALF_EVEN)
    w, _, fr = f"{number:f}".partition(".")
    w = w.lstrip("0").rjust(least_whole, "0")
    while len(fr) > least and fr.endswith("0"):
        fr = fr[:-1]
    if not w and not fr:
        w = "0"
    places = [sum(is_digit(c) for c in whole[i + 1 :]) for i, c in enumerate(whole) if c == f["grouping"]]
    regular = bool(places) and all(p % min(places) == 0 for p in places)
    grouped = ""
    for i, c in enumerate(w):
        left = len(w) - i
        if i and places and (left % min(places) == 0 if regular else left in places):
            grouped += f["grouping"]
        grouped += c
    out = grouped + (f["decimal"] + fr if fr else "")
    if exponent_digits:
        out += f["exponent"] + (f["minus"] if power < 0 else "") + str(abs(power)).rjust(exponent_digits, "0")
    if zero != "0":
        out = "".join(chr(ord(zero) + int(c)) if c in "0123456789" else c for c in out)
    return prefix + out + suffix


def format_number(x: Column, picture: str, names: dict[str, str] | None = None) -> Column:
    """fn:format-number; null is NaN."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format_number_value(None if v is None or v != v else v, picture, names))

    return run(x)


def random_numbers(seed: Column, how_many: int) -> Column:
    """array<double>: the first numbers of the stream of each seed, by hashing (seed, 0), (seed, 1), ..."""
    return F.transform(F.sequence(F.lit(0), F.lit(how_many - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(seed, i), 11) * F.lit(2.0**-53))
