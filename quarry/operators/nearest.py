"""Nearest neighbours: exact, and by signs of fixed hyperplanes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import ConstraintError
from quarry.functions.vector import cosine_distance, dense_vector, l2_distance, vector_literal

METRICS = {"cosine": cosine_distance, "l2": l2_distance}


def nearest(df: DataFrame, vector: list[float], k: int, column: str = "embedding", key: str = "key", metric: str = "cosine") -> DataFrame:
    """The ``k`` rows of smallest distance with that ``distance``, nearest first, ties by ``key``; NULL distances take no part."""
    scored = df.withColumn("distance", METRICS[metric](F.col(column), vector_literal(vector)))
    return scored.filter("distance IS NOT NULL").orderBy("distance", key).limit(k)


class HyperplaneIndex:
    """Signatures by the side of ``planes`` fixed hyperplanes of +-1 components.

    The signature is a column, so the index is a table like any other: it is written, partitioned and filtered by Spark."""

    def __init__(self, dimensions: int, planes: int = 8, seed: int = 17):
        if dimensions < 1 or not 1 <= planes <= 30:
            raise ConstraintError("an index needs a dimension, and 1 to 30 planes")
        self.dimensions, self.planes = dimensions, planes
        # fixed values: the sign of a component is the lowest bit of the first byte of this digest
        self.normals = [[1.0 if hashlib.sha256(f"{seed}:{p}:{d}".encode()).digest()[0] & 1 else -1.0 for d in range(dimensions)] for p in range(planes)]

    def signature(self, column: Column) -> Column:
        """Bit i is set where the product with plane i is not negative; NULL for another dimension."""
        vector = column.cast("array<double>")
        side = lambda normal: F.aggregate(F.zip_with(vector, vector_literal(normal), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) >= 0
        bits = [F.when(side(normal), 1 << i).otherwise(0) for i, normal in enumerate(self.normals)]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        return F.when(F.size(vector) == self.dimensions, total)

    def of(self, vector: list[float]) -> int:
        vector = dense_vector(vector)
        if len(vector) != self.dimensions:
            raise ConstraintError("vector dimension mismatch")
        return sum(1 << i for i, n in enumerate(self.normals) if sum(a * b for a, b in zip(n, vector, strict=True)) >= 0)

    def build(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        """``df`` with its ``signature``."""
        return df.withColumn("signature", self.signature(F.col(column)))

    def add(self, index: DataFrame, rows: DataFrame, key: str = "key", column: str = "embedding") -> DataFrame:
        """Rows of known keys are replaced."""
        return self.remove(index, rows, key).unionByName(self.build(rows, column))

    @staticmethod
    def remove(index: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        return index.join(keys.select(key), key, "left_anti")

    def _order(self, own: int) -> Iterator[int]:
        """All signatures by differing bits from ``own``, then by these bits."""
        for n in range(self.planes + 1):
            yield from (own ^ flip for flip in sorted(sum(1 << i for i in bits) for bits in combinations(range(self.planes), n)))

    def search(self, index: DataFrame, vector: list[float], limit: int = 10, probes: int = 2, exact: bool = True, column: str = "embedding", key: str = "key") -> DataFrame:
        """The ``limit`` nearest by Euclidean distance: of all rows if ``exact``, else of the buckets that are nearest in bits.

        These are the first ``probes`` and, until they hold ``limit`` rows, the next ones that have any; a job counts them
        first. With fewer rows in all buckets, all rows are searched."""
        if not exact:
            own, probed = self.of(vector), max(1, probes)
            differing = F.col("signature").bitwiseXOR(F.lit(own))
            scored = index.filter(F.col("signature").isNotNull() & l2_distance(F.col(column), vector_literal(vector)).isNotNull())
            filled = scored.groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.bit_count(differing), differing).limit(limit + probed).collect()
            chosen, found = list(islice(self._order(own), probed)), 0
            always = set(chosen)
            for bucket in filled:
                if bucket["signature"] in always or found < limit:
                    chosen.append(bucket["signature"])
                    found += bucket["n"]
            if found >= limit:
                index = index.filter(F.col("signature").isin(chosen))
        return nearest(index, vector, limit, column, key, "l2")
