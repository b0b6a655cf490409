"""Grouping. Partial aggregation before the shuffle is the optimiser's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group(df: DataFrame, keys: list[Column], aggregates: list[Column], order: list[str] | None = None, bare: dict[str, Column] | None = None) -> DataFrame:
    """Groups by ``keys``; ``bare`` columns take the value of the group's first row in ``order``.

    Without keys there is exactly one row. The first row is a minimum over a struct, so it aggregates partially."""
    taken = [F.min_by(value, F.struct(*order)).alias(name) for name, value in (bare or {}).items()] if order else []
    return (df.groupBy(*keys) if keys else df).agg(*taken, *aggregates)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in ``order`` of each group, with all its columns."""
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("row")).select("row.*")
