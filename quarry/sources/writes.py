"""Tables after a write, as plans over the table before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def after_insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows.select([F.col(f.name).cast(f.dataType) for f in df.schema.fields]))


def after_update(df: DataFrame, assignments: dict[str, str], where: str | None = None) -> DataFrame:
    """All assignments see the row as it was; types stay. A row whose condition is unknown stays."""
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    return df.select([F.when(hit, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name, metadata=f.metadata) if f.name in assignments else F.col(f"`{f.name}`") for f in df.schema.fields])


def after_delete(df: DataFrame, where: str | None = None) -> DataFrame:
    return df.filter(~F.coalesce(F.expr(where), F.lit(False))) if where else df.limit(0)
