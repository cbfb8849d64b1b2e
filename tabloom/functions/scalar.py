"""Null-safe column expressions for feature building.

A missing value compares as false in a flag and as different in an inequality,
and arithmetic on it stays missing; each function says where it departs from
plain Spark semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6  # fixed value: keeps a ratio defined where the denominator is zero


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(EPSILON))


def positive_flag(x: Column) -> Column:
    """1 where x > 0, else 0; null gives 0."""
    return F.coalesce(x > 0, F.lit(False)).cast("int")


def present_flag(x: Column) -> Column:
    return x.isNotNull().cast("int")


def equals_flag(x: Column, value: str) -> Column:
    """1 where x is the value; null gives 0."""
    return x.eqNullSafe(F.lit(value)).cast("int")


def differs_flag(x: Column, value: str) -> Column:
    """1 where x is anything but the value; null counts as different."""
    return (~x.eqNullSafe(F.lit(value))).cast("int")


def any_flag(*flags: Column) -> Column:
    """1 where any of the 0/1 flags is set."""
    return F.greatest(*flags)


def season(month: Column) -> Column:
    """Quarter of the year from 0: three months each, January first."""
    return F.floor((month - 1) / 3).cast("int")


def sum_or_zero(*parts: Column) -> Column:
    """The sum of the parts, 0 where any part is missing."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.coalesce(total, F.lit(0).cast("double"))


def at_least_zero(x: Column) -> Column:
    """Negative values become 0; null stays null (``greatest`` would skip it)."""
    return F.when(x < 0, F.lit(0)).otherwise(x)


def update_where(condition: Column, new: Column, old: Column) -> Column:
    """``new`` where the condition holds, ``old`` where it is false or unknown."""
    return F.when(condition, new).otherwise(old)


def log_target(y: Column) -> Column:
    return F.log1p(y)


def target_from_log(p: Column) -> Column:
    return F.expm1(p)
