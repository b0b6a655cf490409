"""Prepared statements: SQL with ``?`` parameters, bound by Spark."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import ParseError

_SKIP = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(\?)", re.S)


def arity(sql: str) -> int:
    """How many parameters a statement has; question marks in literals, names and comments are none."""
    return sum(1 for m in _SKIP.finditer(sql) if m[1])


def bind(spark: SparkSession, sql: str, params: Sequence[Any] = (), **frames: DataFrame) -> DataFrame:
    """Runs a statement with exactly as many ``params`` as it has; ``{name}`` stands for a frame."""
    if len(params) != arity(sql):
        raise ParseError(f"the statement takes {arity(sql)} parameters, not {len(params)}")
    if not frames:
        return spark.sql(sql, args=list(params))
    names = {n: f"quarry_bound_{i}" for i, n in enumerate(frames)}
    for n, df in frames.items():
        df.createOrReplaceTempView(names[n])
    try:
        return spark.sql(re.sub(r"\{(\w+)\}", lambda m: names[m[1]], sql), args=list(params))  # analysed here, so the views can go
    finally:
        for n in names.values():
            spark.catalog.dropTempView(n)
