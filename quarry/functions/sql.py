"""SQL names of the engine's functions, as temporary SQL functions: their bodies are inlined by the optimiser."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_COSINE = f"""CASE WHEN size(a) = size(b) THEN
  CASE WHEN sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}) = 0 THEN 1D
  ELSE 1D - {_DOT.format(a='a', b='b')} / (sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')})) END END"""

FUNCTIONS = {
    "json_extract(v VARIANT, path STRING) RETURNS STRING": "CASE WHEN path LIKE '$%' THEN try_variant_get(v, path, 'string') END",
    "json_value(v VARIANT, path STRING) RETURNS VARIANT": "CASE WHEN path LIKE '$%' THEN try_variant_get(v, path, 'variant') END",
    "json_extract_long(v VARIANT, path STRING) RETURNS BIGINT": "CASE WHEN path LIKE '$%' THEN try_variant_get(v, path, 'bigint') END",
    "json_extract_double(v VARIANT, path STRING) RETURNS DOUBLE": "CASE WHEN path LIKE '$%' THEN try_variant_get(v, path, 'double') END",
    "json_extract_bool(v VARIANT, path STRING) RETURNS BOOLEAN": "CASE WHEN path LIKE '$%' THEN try_variant_get(v, path, 'boolean') END",
    "vector_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _COSINE,
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _COSINE,
    "l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) END",
}


def inlined(name: str, arguments: list[str]) -> str | None:
    """The body of a function with its arguments in place: the analyser takes no SQL function in a sort key."""
    for head, body in FUNCTIONS.items():
        if head.startswith(f"{name.lower()}("):
            kinds = dict(re.findall(r"(\w+) (VARIANT|STRING|ARRAY<DOUBLE>)", head.partition(" RETURNS")[0]))
            given = dict(zip(kinds, arguments, strict=True))
            return "(" + re.sub(r"'[^']*'|\b(?:" + "|".join(given) + r")\b", lambda m: f"CAST({given[m[0]]} AS {kinds[m[0]]})" if m[0] in given and kinds[m[0]] != "STRING" else given.get(m[0], m[0]), body) + ")"
    return None


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark``; doing it again changes nothing."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
