"""Dates out of printed forms, as column expressions; unknown parts are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _part(value: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit("")).try_cast("int")


def _month(value: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(value, pattern, group), 1, 3))), F.lit(0)).cast("int")


def printed_date(value: Column, least: int = 1990) -> Column:
    """struct<y, m, d> of ISO, `9 June 2026`, `June 9, 2026`, day/month/year, year-month and year.

    Two numbers that could each be the month leave the day unknown and take the second as the month; equal ones are exact.
    Years before `least` give null, as do texts without a date.
    """
    iso, dmy, mdy, num, ym, y = r"(\d{4})-(\d{2})-(\d{2})", r"(?i)\b(\d{1,2}) ([a-z]{3})[a-z]* (\d{4})", r"(?i)\b([a-z]{3})[a-z]* (\d{1,2}), (\d{4})", r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})", r"^\s*(\d{4})[-/](\d{1,2})\s*$", r"\b((?:19|20)\d{2})\b"
    first, second = _part(value, num, 1), _part(value, num, 2)
    m = F.when(second > 12, first).otherwise(second)
    d = F.when(second > 12, second).when((first > 12) | (first == second), first)
    make = lambda yy, mm, dd: F.struct(yy.alias("y"), mm.cast("int").alias("m"), dd.cast("int").alias("d"))
    none = F.lit(None).cast("int")
    found = F.when(value.rlike(iso), make(_part(value, iso, 1), _part(value, iso, 2), _part(value, iso, 3)))
    found = found.when(value.rlike(dmy) & _month(value, dmy, 2).isNotNull(), make(_part(value, dmy, 3), _month(value, dmy, 2), _part(value, dmy, 1)))
    found = found.when(value.rlike(mdy) & _month(value, mdy, 1).isNotNull(), make(_part(value, mdy, 3), _month(value, mdy, 1), _part(value, mdy, 2)))
    found = found.when(value.rlike(num), make(_part(value, num, 3), m, d)).when(value.rlike(ym), make(_part(value, ym, 1), _part(value, ym, 2), none)).when(value.rlike(y), make(_part(value, y, 1), none, none))
    return F.when(found["y"] >= least, found)


def url_date(url: Column) -> Column:
    """struct<y, m, d> from a URL's path, year/month/day before year/month; query and fragment do not count."""
    path = F.try_parse_url(url, F.lit("PATH"))
    ymd, ym = r"/((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:/|-|$)", r"/((?:19|20)\d{2})[/-](\d{1,2})(?:/|$)"
    make = lambda p, n: F.struct(_part(path, p, 1).alias("y"), _part(path, p, 2).alias("m"), (_part(path, p, 3) if n == 3 else F.lit(None).cast("int")).alias("d"))
    return F.when(path.rlike(ymd), make(ymd, 3)).when(path.rlike(ym), make(ym, 2))


def label(date: Column) -> Column:
    """Printed as far as it is known; an impossible day leaves the month."""
    text = F.format_string("%04d-%02d-%02d", date["y"], date["m"], date["d"])
    day = F.try_to_date(text)
    return F.when(date["d"].isNotNull() & day.isNotNull(), text).when(date["m"].between(1, 12), F.format_string("%04d-%02d", date["y"], date["m"])).when(date["y"].isNotNull(), F.format_string("%04d", date["y"]))


def first_trusted(candidates: Column, today: Column) -> Column:
    """Folds an array of struct<y, m, d>, most trusted first: the first one with a month that does not lie ahead picks the
    month; a later one may only add the day within that month."""
    ahead = lambda c: F.make_date(c["y"], c["m"], F.lit(1)) > today
    start = F.struct(F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("int").alias("d"))

    def step(acc: Column, c: Column) -> Column:
        usable = c["y"].isNotNull() & c["m"].between(1, 12) & ~F.coalesce(ahead(c), F.lit(False))
        add = acc["d"].isNull() & (acc["y"] == c["y"]) & (acc["m"] == c["m"]) & c["d"].isNotNull()
        return F.when(acc["y"].isNull() & usable, c).when(usable & add, c).otherwise(acc)

    return F.aggregate(candidates, start, step)


def fiscal_year(period: Column) -> Column:
    """A comparable year: `2024-25` is 2025, a single year itself, no year 0."""
    span = r"\b((?:19|20)\d{2})\s?[-/–]\s?(\d{2})\b"
    ends = (F.floor(_part(period, span, 1) / 100) * 100 + _part(period, span, 2)).cast("int")
    return F.coalesce(F.when(period.rlike(span), ends), _part(period, r"\b((?:19|20)\d{2})\b", 1), F.lit(0))
