"""Quantities, units, money and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor to the base unit and the base, by unit.
UNITS = {
    "kg": (1.0, "kg"), "g": (0.001, "kg"), "t": (1000.0, "kg"), "tonnes": (1000.0, "kg"), "tons": (1000.0, "kg"), "lb": (0.45359237, "kg"), "m": (1.0, "m"), "km": (1000.0, "m"), "cm": (0.01, "m"), "mm": (0.001, "m"),
    "ft": (0.3048, "m"), "hp": (1.0, "hp"), "kw": (1.341022, "hp"), "km/h": (1.0, "km/h"), "mph": (1.609344, "km/h"), "m/s": (3.6, "km/h"), "hours": (1.0, "h"), "percent": (1.0, "%"), "%": (1.0, "%"),
}


def to_base(value: Column, unit: Column) -> Column:
    """struct<value, unit> in the base unit; null for an unknown unit."""
    table = F.create_map(*[F.lit(x) for k, (f, b) in UNITS.items() for x in (k, f)])
    base = F.create_map(*[F.lit(x) for k, (f, b) in UNITS.items() for x in (k, b)])
    u = F.lower(F.trim(unit))
    return F.when(base[u].isNotNull(), F.struct((value * table[u]).alias("value"), base[u].alias("unit")))


def quantities(text: Column) -> Column:
    """All (number, unit) pairs of a text: array<struct<value, unit>> with commas taken out of the numbers."""
    units = "|".join(sorted((u for u in UNITS if u != "%"), key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![a-z0-9_])([0-9][0-9,]*(?:\.[0-9]+)? ?(?:{units}))(?![a-z0-9_])"), F.lit(1))
    number = lambda x: F.regexp_replace(F.regexp_extract(x, r"^([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    return F.transform(found, lambda x: F.struct(number(x).alias("value"), F.lower(F.trim(F.regexp_extract(x, r"^[0-9][0-9,]*(?:\.[0-9]+)?(.*)$", 1))).alias("unit")))


def js_round(value: Column) -> Column:
    """Halves go up, towards plus infinity."""
    return F.floor(value + 0.5)


def ranges_decide(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, parity: float = 0.03) -> Column:
    """1 where a lies above b, -1 below, 0 where the ranges meet or their nearest ends are within `parity` of their mean."""
    gap = F.when(lo_a > hi_b, lo_a - hi_b).when(lo_b > hi_a, lo_b - hi_a).otherwise(0.0)
    mean = F.when(lo_a > hi_b, F.abs(lo_a) + F.abs(hi_b)).otherwise(F.abs(hi_a) + F.abs(lo_b)) / 2
    return F.when((gap == 0) | (gap < parity * mean), 0).when(lo_a > hi_b, 1).otherwise(-1)


def shrunk_index(wins: Column, losses: Column, clamp: tuple[float, float] | None = None) -> Column:
    """50 + (100 w / n - 50) n / (n + 1) over n decided fields; null where none is decided."""
    n = wins + losses
    index = 50 + (100.0 * wins / n - 50) * n / (n + 1)
    return F.when(n > 0, F.greatest(F.least(index, F.lit(clamp[1])), F.lit(clamp[0])) if clamp else index)


def change_probability(rate: Column, days: Column) -> Column:
    """Of at least one change within `days` under a Poisson rate."""
    return 1 - F.exp(-rate * days)
