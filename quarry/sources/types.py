"""Declared column types, their Spark types, and the checks on rows that are written."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import ConstraintError
from quarry.functions.vector import vector_problem

ROW_ID = "__row"


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    primary_key: bool = False
    not_null: bool = False

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @property
    def family(self) -> str:
        base = re.split(r"\W", self.type.upper())[0]
        return {"INT": "long", "INTEGER": "long", "BIGINT": "long", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "DECIMAL": "decimal", "NUMERIC": "decimal", "JSON": "json", "JSONB": "json", "VECTOR": "vector", "VECTOR_DOCUMENT": "document", "VECTOR_DOC": "document", "UNSTRUCTURED_VECTOR": "document", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}.get(base, "string")

    @property
    def spark(self) -> str:
        if self.family == "decimal":
            digits = re.search(r"\(([\d\s,]+)\)", self.type)
            return f"decimal({digits[1]})" if digits else "double"
        return {"json": "variant", "vector": "array<double>", "document": "struct<text:string,embedding:array<double>,metadata:variant>"}.get(self.family, self.family)

    def from_text(self) -> Expression:
        """The typed value of a literal's text, NULL if it cannot be one; see :func:`checked`."""
        text = F.col(f"`{self.name}`")
        if self.family == "long":
            return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), text.try_cast("boolean").try_cast("bigint"))
        if self.family == "json":
            return F.try_parse_json(text)
        if self.family == "vector":
            return F.from_json(text, "array<double>")
        if self.family == "document":
            shape = F.from_json(text, "struct<text:string,embedding:array<double>,metadata:string>")
            metadata = F.when(F.get_json_object(text, "$.metadata").isNull(), F.when(~F.array_contains(F.json_object_keys(text), "metadata"), F.parse_json(F.lit("{}")))).otherwise(F.try_parse_json(F.get_json_object(text, "$.metadata")))
            return F.when(text.isNotNull(), F.struct(shape["text"].alias("text"), shape["embedding"].alias("embedding"), metadata.alias("metadata")))
        return text if self.family == "string" else text.try_cast(self.spark)

    def problem(self, typed: Expression, given: Expression | None = None) -> Expression:
        """What is wrong with a value, NULL if nothing is."""
        checks = [F.when(typed.isNull(), f"{self.name} must not be NULL")] if self.not_null else []
        if given is not None:
            checks.append(F.when(given.isNotNull() & typed.isNull(), f"{self.name}: not a value of type {self.type}"))
        if self.family == "vector":
            checks.append(F.concat(F.lit(f"{self.name}: "), vector_problem(typed)))
        if self.family == "document":
            text = typed["text"]
            checks.append(F.when(typed.isNotNull() & (text.isNull() | (F.trim(text) == "") | (F.char_length(text) > 64_000)), f"{self.name}.text must be text"))
            checks.append(F.when(typed.isNotNull() & (typed["embedding"].isNull() | typed["metadata"].isNull()), f"{self.name} needs an embedding and an object of metadata"))
            checks.append(F.concat(F.lit(f"{self.name}.embedding: "), vector_problem(typed["embedding"])))
        return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def check_rows(df: DataFrame, columns: list[Column]) -> None:
    """One pass over rows: the first broken rule raises."""
    found = df.select(problem_of(columns).alias("problem")).filter("problem IS NOT NULL").first()
    if found:
        raise ConstraintError(found["problem"])


def measures(columns: list[Column]) -> list[Expression]:
    """Aggregates of new rows that one pass can take beside a write: how many, the greatest number, the first broken rule and the vectors' sizes."""
    out = [F.count("*").alias("n"), F.max(ROW_ID).alias("last"), F.min("__problem").alias("problem")]
    for name, size in vector_sizes(columns).items():
        out += [F.min(size).alias(f"low_{name}"), F.max(size).alias(f"high_{name}")]
    return out


def problem_of(columns: list[Column], given: dict[str, str] | None = None) -> Expression:
    """The first rule that a row breaks, NULL if none. ``given`` names the columns that hold literals' texts."""
    problems = [c.problem(F.col(f"`{c.name}`"), F.col(f"`{given[c.name]}`") if given and c.name in given else None) for c in columns]
    return F.coalesce(*problems, F.lit(None).cast("string"))


def vector_sizes(columns: list[Column]) -> dict[str, Expression]:
    vectors = {c.name: F.col(f"`{c.name}`") if c.family == "vector" else F.col(f"`{c.name}`.embedding") for c in columns if c.family in ("vector", "document")}
    return {n: F.when(v.isNotNull(), F.size(v)) for n, v in vectors.items()}


def agreed_sizes(known: dict[str, int], measured: dict[str, Any], columns: list[Column]) -> dict[str, int]:
    """The one dimension of each vector column, after rows of the ``measured`` sizes."""
    out = dict(known)
    for name in vector_sizes(columns):
        for size in (measured.get(f"low_{name}"), measured.get(f"high_{name}")):
            if size is not None and out.setdefault(name, size) != size:
                raise ConstraintError(f"{name}: vector dimension mismatch ({out[name]} and {size})")
    return out


def check_keys(new: DataFrame, old: DataFrame | None, columns: list[Column]) -> None:
    """Each key column is unique by itself, among the new rows and beside the old: old rows only meet the new keys, in one job for all columns."""
    twice = []
    for c in columns:
        if c.primary_key:
            key = F.col(f"`{c.name}`").alias("k")
            own = new.select(key).filter("k IS NOT NULL")
            met = own.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
            if old is not None:
                met = met.union(old.select(key).join(own, "k", "left_semi"))
            twice.append(met.select(F.lit(c.name).alias("name")).limit(1))
    if twice and (found := reduce(DataFrame.union, twice).first()):
        raise ConstraintError(f"duplicate primary key in {found['name']}")


def check_table(df: DataFrame, columns: list[Column]) -> None:
    """Vector columns have one dimension and keys are unique, over whole rows."""
    sizes = vector_sizes(columns)
    if sizes:
        row = df.agg(*[f(v).alias(f"{side}_{n}") for n, v in sizes.items() for side, f in (("low", F.min), ("high", F.max))]).first()
        agreed_sizes({}, row.asDict(), columns)
    check_keys(df, None, columns)
