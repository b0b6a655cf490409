"""Joins. The optimiser chooses how; a strategy can be hinted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import ParseError


def _qualified(df: DataFrame, alias: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns])


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_alias: str, right_alias: str, nulls_match: bool = True, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Joins on one pair of columns; the result's columns are ``alias.column``.

    ``nulls_match``: NULL keys meet each other, which is still a hash or merge join on the keys. Leave it off where
    keys are never NULL, so that the scan gets an IS NOT NULL filter. ``strategy``: shuffle_hash, merge, broadcast."""
    a = left if left_alias == "" else _qualified(left, left_alias)
    b = _qualified(right, right_alias)
    if strategy:
        b = b.hint(strategy)
    x, y = F.col(f"`{left_alias}.{left_key}`" if left_alias else f"`{left_key}`"), F.col(f"`{right_alias}.{right_key}`")
    return a.join(b, x.eqNullSafe(y) if nulls_match else x == y, how)


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_alias: str = "l", right_alias: str = "r") -> DataFrame:
    """Rows of equal keys. Which side is hashed, broadcast or sorted is left to sizes that adaptive execution sees: a hinted build side could not spill."""
    return equi_join(left, right, left_key, right_key, left_alias, right_alias)


def nested_loop_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_alias: str = "l", right_alias: str = "r") -> DataFrame:
    """The same rows as :func:`hash_join`. An equality is never looped over here: the optimiser picks the join."""
    return equi_join(left, right, left_key, right_key, left_alias, right_alias)


def chain(tables: dict[str, DataFrame], joins: list[tuple[str, str]], nulls_match: bool = True) -> DataFrame:
    """Joins several aliased tables by pairs of ``alias.column``; each pair must touch what is joined so far."""
    names = iter(tables)
    first = next(names)
    out, known, left = _qualified(tables[first], first), {first}, list(joins)
    while left:
        pair = next((p for p in left if (p[0].split(".")[0] in known) != (p[1].split(".")[0] in known)), None)
        if pair is None:
            raise ParseError("every join must connect one new table")
        left.remove(pair)
        old, new = pair if pair[0].split(".")[0] in known else pair[::-1]
        alias, key = new.split(".", 1)
        out = equi_join(out, tables[alias], old, key, "", alias, nulls_match)
        known.add(alias)
    return out


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its keys at or before its time (NULL: none).

    One sort of both sides together; no pairs are made. Of right rows at one time the largest values count."""
    clash = set(values) & set(left.columns)
    if clash:
        raise ParseError(f"columns on both sides: {sorted(clash)}")
    keys = [F.col(c) for c in by]
    a = left.select(*[F.col(c) for c in left.columns], F.col(left_time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__v"))
    nothing: list[Column] = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in by else F.col(c) for c in left.columns]
    b = right.select(*nothing, F.col(right_time).alias("__at"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    so_far = Window.partitionBy(*keys).orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(so_far)).filter("__side = 1")
    return both.select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])

