"""Sorting with NULLs last ascending and first descending, and the first rows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import ascending, descending


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """``-column`` descends. Keys need not be projected afterwards."""
    return df.orderBy(*[descending(F.col(k[1:])) if k.startswith("-") else ascending(F.col(k)) for k in keys])


def top(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows of :func:`sort`: one heap for each task and a merge. End ``keys`` in a unique one."""
    return sort(df, *keys).limit(n)
