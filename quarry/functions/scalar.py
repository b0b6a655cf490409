"""Two-valued comparisons, arithmetic that gives NULL instead of errors, and the order of NULLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same(a: Column, b: Column) -> Column:
    """a = b where NULL equals NULL."""
    return a.eqNullSafe(b)


def matches(condition: Column) -> Column:
    """A comparison whose unknown result is false, also under NOT."""
    return F.coalesce(condition, F.lit(False))


def safe_add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def safe_subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def safe_multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def safe_divide(a: Column, b: Column) -> Column:
    """True division; NULL where the divisor is zero."""
    return F.try_divide(a, b)


def ascending(column: Column) -> Column:
    """NULLs last."""
    return column.asc_nulls_last()


def descending(column: Column) -> Column:
    """NULLs first, so it is the exact reverse of :func:`ascending`."""
    return column.desc_nulls_first()
