"""JSON paths over VARIANT columns and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _extract(value: Column, path: str, kind: str, text: bool) -> Column:
    """NULL for a path without ``$``, a missing step, or JSON null."""
    if not path.startswith("$"):
        return F.lit(None).cast(kind)
    if text:
        return F.get_json_object(value, path).try_cast(kind)
    return F.try_variant_get(value, path, kind)


def json_extract(value: Column, path: str, text: bool = True) -> Column:
    """The value at ``path`` as a string. ``text``: the column is JSON text; else VARIANT."""
    return _extract(value, path, "string", text)


def json_extract_long(value: Column, path: str, text: bool = True) -> Column:
    return _extract(value, path, "bigint", text)


def json_extract_double(value: Column, path: str, text: bool = True) -> Column:
    return _extract(value, path, "double", text)


def json_extract_bool(value: Column, path: str, text: bool = True) -> Column:
    return _extract(value, path, "boolean", text)


def json_length(value: Column) -> Column:
    """Characters of a text; elements of JSON text that is an array, keys of one that is an object."""
    return F.coalesce(F.json_array_length(value), F.size(F.json_object_keys(value)), F.char_length(value)).cast("bigint")
