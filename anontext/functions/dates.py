"""Dates written in any common way, read by token classes.

A text is cut into a date, a time and an offset; the date into numbers and words. What each number means follows from
how many digits it has, where it stands and whether a month is named, so no list of formats is tried in turn. A text
with anything else in it is no date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anontext.functions.text import let

# Names that a date may hold, and words that mean nothing in it.
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
DAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")
FILLERS = ("OF", "THE", "ON")

_CLOCK = "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?(?: ?[AP][.]?M[.]?)?|[0-9]{1,2} ?[AP][.]?M[.]?"
_COMPACT = "(?<=[0-9])T(?:[0-9]{6}|[0-9]{4})"
_ZONE = "Z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?"
_WHOLE = f"^(.*?)(?:(?:(?:T| *,? *(?:AT )?)({_CLOCK})|({_COMPACT}))(?: ?({_ZONE}))?)?$"

# Two-digit years from this one on are of the last century.
PIVOT = 69


def parse_mixed_date(text: Column) -> Column:
    """TIMESTAMP_NTZ of a date in any order of year, month and day, with or without time and offset; null for anything else.

    Year-month-day, month-day-year (day first where the first number is no month), and named months in any
    order; years of four digits or two; times by 24 or 12 hours, fractions cut to microseconds. A text with an
    offset is turned to UTC; all others are taken as they stand.
    """
    return let(F.regexp_replace(F.upper(F.trim(text)), r"\s+", " "), _read)


def _read(whole: Column) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(whole, _WHOLE, group)

    clock = F.when(part(3) != "", F.regexp_replace(part(3), "^T([0-9]{2})([0-9]{2})([0-9]{0,2})$", "$1:$2:$3")).otherwise(part(2))
    parts = F.struct(F.trim(F.regexp_replace(part(1), "([0-9])(?:ST|ND|RD|TH)(?![A-Z])", "$1")).alias("date"),
                     F.rtrim(clock, F.lit(":")).alias("time"), part(4).alias("zone"))
    return let(parts, lambda p: _assemble(p["date"], p["time"], p["zone"]))


def _assemble(date: Column, time: Column, zone: Column) -> Column:
    plain = F.regexp_like(date, F.lit("^[0-9A-Z ,./-]+$"))
    day = let(F.regexp_extract_all(date, F.lit("[0-9]+|[A-Z]+"), 0), _fields)

    def made(d: Column) -> Column:
        hour, minute, second = _time(time)
        read = F.try_make_timestamp_ntz(d["y"], d["m"], d["d"], hour, minute, second)
        # Minutes ahead of UTC.
        ahead = F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (
            F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(zone, "([0-9]{2})$", 1).try_cast("int") * F.when(
                F.length(zone) > 3, 1).otherwise(0), F.lit(0)))
        return read - F.make_dt_interval(mins=F.coalesce(ahead, F.lit(0)))

    return F.when(plain, let(day, made))


def _time(time: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and second; midnight without a time, and null where an hour does not go with its half of the day."""
    half = F.regexp_extract(time, "([AP])[.]?M", 1)
    hour = F.regexp_extract(time, "^([0-9]{1,2})", 1).try_cast("int")
    hour = (F.when(time == "", 0).when(half == "", hour)
            .when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)))
    minute = F.coalesce(F.regexp_extract(time, "^[0-9]+:([0-9]{2})", 1).try_cast("int"), F.lit(0))
    second = F.regexp_extract(time, "^[0-9]+:[0-9]+:([0-9]{2}(?:[.,][0-9]{1,6})?)", 1)
    return hour, minute, F.coalesce(F.translate(second, ",", ".").try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))


def _fields(tokens: Column) -> Column:
    """STRUCT<y, m, d> of the tokens of a date, with nulls where they are none."""
    numbers = F.filter(tokens, lambda t: F.regexp_like(t, F.lit("^[0-9]")))
    names = F.filter(tokens, lambda t: ~F.regexp_like(t, F.lit("^[0-9]")) & ~t.isin(*FILLERS) & ~_is_day(t))
    return let(F.struct(numbers.alias("n"), F.transform(names, _month).alias("m")), lambda p: _assign(p["n"], p["m"]))


def _is_day(name: Column) -> Column:
    # Weekdays may be cut to three letters, or to any length above.
    return (F.length(name) >= 3) & F.exists(F.array(*(F.lit(d) for d in DAYS)), lambda d: d.startswith(name))


def _month(name: Column) -> Column:
    """Number of a month named by three letters or more; 0 for any other word."""
    listed = F.array(*(F.lit(m) for m in MONTHS))
    at = F.array_position(F.transform(listed, lambda m: m.startswith(name)), True)
    return F.when(F.length(name) >= 3, at).otherwise(0).cast("int")


def _assign(n: Column, months: Column) -> Column:
    def number(i: int) -> Column:
        return F.try_element_at(n, F.lit(i)).try_cast("int")

    def digits(i: int) -> Column:
        return F.length(F.try_element_at(n, F.lit(i)))

    def year(i: int) -> Column:
        short = number(i) + F.when(number(i) < PIVOT, 2000).otherwise(1900)
        return F.when(digits(i) == 4, number(i)).when(digits(i) == 2, short)

    def fields(y, m, d) -> Column:
        return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))

    def small(*places: int) -> Column:
        out = F.lit(True)
        for i in places:
            out = out & (digits(i) <= 2)
        return out

    none = F.lit(None)
    month = F.try_element_at(months, F.lit(1))
    named = (F.when((F.size(n) == 2) & (digits(1) == 4) & small(2), fields(number(1), month, number(2)))
             .when((F.size(n) == 2) & small(1) & digits(2).isin(2, 4), fields(year(2), month, number(1)))
             .when((F.size(n) == 1) & (digits(1) == 4), fields(number(1), month, F.lit(1))))
    first, second = number(1), number(2)
    whole = F.try_element_at(n, F.lit(1))
    numeric = (F.when((F.size(n) == 1) & (digits(1) == 8), fields(
                   *(F.substring(whole, a, b).try_cast("int") for a, b in ((1, 4), (5, 2), (7, 2)))))
               .when((F.size(n) == 3) & (digits(1) == 4) & small(2, 3), fields(first, second, number(3)))
               .when((F.size(n) == 3) & small(1, 2) & digits(3).isin(2, 4), F.when(
                   first > 12, fields(year(3), second, first)).otherwise(fields(year(3), first, second))))
    nothing = fields(none, none, none)
    return F.coalesce(F.when(F.size(months) == 0, numeric).when((F.size(months) == 1) & (month > 0), named), nothing)
