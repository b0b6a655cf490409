"""Connected components of an edge table, by alternating large and small stars.

Each round is group-by-minimum and joins. A minimum is taken before the shuffle and after it, and is written, so that
the join with it stands on two plain shuffles and adaptive execution can split a vertex of any degree. No round gathers a
component. Rounds are written, so a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """Links each vertex's larger (or smaller) neighbours to the smallest of them all."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"least-{name}")
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """vertex, root (the smallest vertex that can be reached) for every vertex of ``edges`` (u, v of one ordered type)."""
    now, seen, n = scratch.keep(edges.filter(F.col("u") != F.col("v")).distinct(), "edges-0"), None, 0
    while True:
        # the edges are distinct: an exclusive or of their hashes stands for the set
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
        if state == seen or not state["n"]:
            break
        seen, n = state, n + 1
        wide = scratch.keep(_star(now, True, scratch, f"large-{n}"), f"large-{n}")
        now = scratch.keep(_star(wide, False, scratch, f"small-{n}"), f"edges-{n}")
        for name in (f"least-large-{n}", f"large-{n}", f"least-small-{n}", f"edges-{n - 1}"):
            scratch.drop(name)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
