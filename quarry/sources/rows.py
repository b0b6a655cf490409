"""Access by key."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_range(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Rows with start <= key < end; either may be open. The filter reaches the scan, which skips by min and max."""
    if start is not None:
        df = df.filter(F.col(column) >= start)
    return df if end is None else df.filter(F.col(column) < end)
