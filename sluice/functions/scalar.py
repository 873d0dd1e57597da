"""Column expressions that the operators share."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that do not change what a feature measures.
SUFFIXES = ("mean", "se", "worst", "std", "min", "max", "median")


def squeeze(c: Column) -> Column:
    """Trimmed, inner white space as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def base_name(c: Column) -> Column:
    """Lower case, without an ending such as ``_mean``."""
    return F.regexp_replace(F.lower(c), f"_({'|'.join(SUFFIXES)})$", "")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def shorten(c: Column, most: int = 20) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """Within bounds; null stays null."""
    lo, hi = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def ratio(a: Column, b: Column) -> Column:
    """a / b, with 1 for a zero divisor."""
    return a / F.when(b == 0, F.lit(1)).otherwise(b)


def variation(std: Column, mean: Column) -> Column:
    """Coefficient of variation; null for a zero mean."""
    return F.abs(std / F.nullif(mean, F.lit(0.0)))


def is_weekend(c: Column) -> Column:
    return F.weekday(c).isin(5, 6).cast("int")


def business_hours(c: Column) -> Column:
    return F.hour(c).between(9, 17).cast("int")


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value with a period."""
    angle = c * F.lit(2 * pi / period)
    return F.sin(angle), F.cos(angle)


def unix_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def seconds_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def days_since(c: Column, start: Column) -> Column:
    return F.floor((F.unix_seconds(c.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 86400)


def yeo_johnson(c: Column, power: float) -> Column:
    """The Yeo-Johnson transform with a given power."""
    up = F.log1p(c) if power == 0 else (F.pow(c + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-c) if power == 2 else -(F.pow(1 - c, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(c >= 0, up).when(c < 0, down)


def overlap(a: Column, b: Column) -> Column:
    """How many values two arrays share."""
    return F.size(F.array_intersect(a, b))
