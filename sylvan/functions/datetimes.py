"""Dates, times and durations.

A value without time zone is a DATE, TIMESTAMP_NTZ or TIME. A value with one is a
struct (value, offset_min); the implicit time zone is UTC. Durations are day-time
and year-month intervals.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

year, month, day, hours, minutes = F.year, F.month, F.dayofmonth, F.hour, F.minute


def seconds(t: Column) -> Column:
    return F.extract(F.lit("SECOND"), t)


def of_duration(part: str, d: Column) -> Column:
    """years, months (of a year-month interval), days, hours, minutes or seconds (of a day-time one); signed."""
    return F.extract(F.lit(part.upper().rstrip("S")), d)


def zoned(value: Column, offset_min: Column) -> Column:
    return F.struct(value.alias("value"), offset_min.cast("int").alias("offset_min"))


def instant(z: Column) -> Column:
    """The moment in UTC, by which zoned values compare."""
    return z["value"] - F.make_dt_interval(mins=F.coalesce(z["offset_min"], F.lit(0)))


def timezone(z: Column) -> Column:
    return F.make_dt_interval(mins=z["offset_min"])


def adjust_to_timezone(z: Column, minutes_: Column | None) -> Column:
    """The same moment in another zone; none takes the zone away; a value without zone gets it as it is."""
    if minutes_ is None:
        return F.struct(z["value"].alias("value"), F.lit(None).cast("int").alias("offset_min"))
    moved = F.when(z["offset_min"].isNull(), z["value"]).otherwise(z["value"] + F.make_dt_interval(mins=minutes_ - z["offset_min"]))
    return F.struct(moved.alias("value"), minutes_.cast("int").alias("offset_min"))


def date_time(d: Column, t: Column) -> Column:
    """fn:dateTime of a date and a time given as a day-time interval or TIME text HH:mm:ss."""
    return F.to_timestamp_ntz(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" "), t.cast("string")))


def current_date() -> Column:
    return F.current_date()


def current_date_time() -> Column:
    return F.current_timestamp()


def current_time() -> Column:
    return F.current_time()


def implicit_timezone() -> Column:
    return F.make_dt_interval(mins=F.lit(0))


def add_months(value: Column, months_: Column) -> Column:
    """dateTime plus a year-month duration: the day is clamped to the month's last."""
    return value + F.make_ym_interval(months=months_)


def subtract(a: Column, b: Column) -> Column:
    return a - b


def scale_duration(d: Column, by: Column) -> Column:
    return d * by


def divide_durations(a: Column, b: Column) -> Column:
    def micros(d: Column) -> Column:
        part = {p: F.extract(F.lit(p), d) for p in ("DAY", "HOUR", "MINUTE", "SECOND")}
        return ((part["DAY"] * 24 + part["HOUR"]) * 60 + part["MINUTE"]) * 60 + part["SECOND"]

    return micros(a).cast("decimal(38,18)") / micros(b).cast("decimal(38,18)")


#: Names in English.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_MARKER = re.compile(r"\[\[|\]\]|\[([YMDdFWwHhPmsfZzCE])([^\]]*)\]")


def format_value(value: Column, picture: str) -> Column:
    """fn:format-date, -dateTime and -time of a timestamp or date by a picture such as [Y0001]-[M01]-[D01]."""
    plain = _as_java(picture)
    if plain is not None:
        return F.date_format(value, plain)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else format_picture(pd.Timestamp(v), picture))

    return run(value.cast("timestamp_ntz"))


_JAVA = {"[Y0001]": "yyyy", "[Y]": "y", "[M01]": "MM", "[M]": "M", "[D01]": "dd", "[D]": "d", "[H01]": "HH", "[H]": "H", "[m01]": "mm", "[m]": "mm", "[s01]": "ss", "[s]": "ss"}


def _as_java(picture: str) -> str | None:
    """A picture that Spark's own formatter can do, else None."""
    out, at = [], 0
    for found in re.finditer(r"\[[^\]]*\]", picture):
        literal = picture[at : found.start()]
        if found.group() not in _JAVA or "'" in literal or "]" in literal:
            return None
        out += [f"'{literal}'" if literal else "", _JAVA[found.group()]]
        at = found.end()
    literal = picture[at:]
    return None if "'" in literal or "[" in literal or "]" in literal else "".join(out) + (f"'{literal}'" if literal else "")


def format_picture(t: pd.Timestamp, picture: str) -> str:
    from sylvan.functions.formats import format_integer_value

    def part(m: re.Match) -> str:
        if m.group() in ("[[", "]]"):
            return m.group()[0]
        kind, rest = m.group(1), m.group(2).replace(" ", "")
        form, _, width = rest.partition(",")
        least, _, most = width.partition("-")
        value = {"Y": t.year, "M": t.month, "D": t.day, "d": t.dayofyear, "W": t.isocalendar().week, "w": (t.day - 1) // 7 + 1, "H": t.hour, "h": (t.hour % 12) or 12, "m": t.minute, "s": t.second}.get(kind)
        if kind == "F" or (kind == "M" and form[:1] in ("N", "n")):
            name = DAYS[t.dayofweek] if kind == "F" else MONTHS[t.month - 1]
            if kind == "F" and form[:1] not in ("", "N", "n"):
                return str(t.dayofweek + 1)
            name = name[: int(most)] if most.isdigit() else name
            return name.upper() if form == "N" else name.lower() if form == "n" or (kind == "F" and not form) else name
        if kind == "P":
            word = "am" if t.hour < 12 else "pm"
            return word.upper() if form == "N" else word.capitalize() if form == "Nn" else word
        if kind == "f":
            digits = f"{t.microsecond:06d}"
            size = len(form) if form.isdigit() else (int(most) if most.isdigit() else 3)
            return digits[:size].ljust(size, "0")
        if kind in "Zz":
            return "+00:00" if kind == "Z" else "GMT+00:00"
        if kind == "C":
            return "ISO"
        if kind == "E":
            return "AD"
        form = form or ("01" if kind in "ms" else "1")
        form = form[:-1] + ";o" if form.endswith("o") else form
        if kind == "Y" and form.isdigit() and len(form) == 2:
            value %= 100
        text = format_integer_value(int(value), form)
        return text.rjust(int(least), "0") if least.isdigit() and form[:1].isdigit() else text

    return _MARKER.sub(part, picture)


def parse_ietf_date(text: Column) -> Column:
    """Dates such as Wed, 06 Jun 1994 07:29:35 GMT, as the moment in UTC."""
    from email.utils import parsedate_to_datetime

    @F.pandas_udf("timestamp_ntz")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> object:
            if v is None:
                return pd.NaT
            t = parsedate_to_datetime(v.strip())
            return pd.Timestamp((t - t.utcoffset()).replace(tzinfo=None) if t.tzinfo else t)

        return pd.to_datetime(values.map(one))

    return run(text)
