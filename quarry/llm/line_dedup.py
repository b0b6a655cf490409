"""Cross-site boilerplate: lines that appear on many distinct sites, in DataFrame functions only.

Each distinct line hash has a HyperLogLog sketch of its sites, merged by aggregation. Where the estimate is clearly
below or above the threshold it decides; near it, the distinct sites are counted exactly. Lines that spread over so many
sites are removed from every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, text_or_empty

#: Sites on which a line is boilerplate.
SITES = 8
#: log2 of a sketch's registers, and the band around the threshold in which sites are counted exactly: over six standard errors of 1.04 / 2^(LG_K / 2).
LG_K = 12
BAND = 0.15
#: What is trimmed from a line before it is compared; a line of nothing else is not judged.
BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_key(line: Column) -> Column:
    return F.regexp_replace(line, BLANK, "")


def spread_lines(df: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 (two 64-bit hashes of a trimmed line) of each line that is on ``sites`` distinct sites or more, and its ``n_sites``: exact near the threshold, else the estimate."""
    lines = df.select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(F.transform(F.split(text_or_empty(text_col), "\n", -1), line_key))).alias("line")).filter("line <> '' AND site IS NOT NULL")
    hashed = lines.select("site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    # sketches are made before the shuffle, one for each line and task, and merged after it
    sketched = hashed.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"))
    scratch = Scratch(df.sparkSession, "lines")
    candidates = scratch.keep(sketched.filter(F.col("estimate") >= sites * (1 - band) - 0.5), "candidates")
    near = candidates.filter(F.col("estimate") <= sites * (1 + band) + 0.5)
    exact = hashed.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
    sure = candidates.filter(F.col("estimate") > sites * (1 + band) + 0.5).select("h1", "h2", F.col("estimate").alias("n_sites"))
    return scratch.keep(exact.filter(F.col("n_sites") >= sites).union(sure), "spread")


def remove_spread(df: DataFrame, spread: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with all their columns, the lines of ``spread`` removed from their texts, and ``n_removed``.

    A column of ``df`` that has this name gives way to it; no other name is in the way. Nulls, ties and repeated rows as in :func:`without_boilerplate`."""
    packed = df.select(F.struct("*").alias("row")).withColumn("text", F.col("row")[text_col].cast("string"))
    keyed = packed.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    # equal texts lose the same lines, so a text's hashes stand for it and no row needs a number
    lines = keyed.select("t1", "t2", F.explode(F.array_distinct(F.transform(F.split(text_or_empty("text"), "\n", -1), line_key))).alias("line")).filter("line <> ''")
    found = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}).join(spread.select("h1", "h2"), ["h1", "h2"], "left_semi")
    drops = found.select("t1", "t2", "line").distinct().groupBy("t1", "t2").agg(F.collect_list("line").alias("drop"))
    # written, so that the join stands on two plain shuffles and copies of one text, however many, can be split among tasks
    out = keyed.join(Scratch(df.sparkSession, "drops").keep(drops, "drops"), ["t1", "t2"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("drop"), line_key(line)))
    removed = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long")
    clean = F.when(F.col("drop").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, "\n"))
    fields = [clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c != "n_removed"]
    return out.select(F.struct(*fields, removed.alias("n_removed")).alias("out")).select("out.*")  # in a struct no name stands for another column


def without_boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """The rows of ``df`` with all their columns; lines on ``sites`` distinct sites or more are removed from every text, and counted in ``n_removed``.

    Lines end at newlines and are compared without white space at either end; blank lines are never removed.
    Null texts stay null, empty ones empty; a null site counts on no site, and its row still loses lines.
    Repeated rows stay; a line repeated in one text or site counts once. An empty table gives no rows. A column of the name
    ``n_removed`` gives way to the count."""
    return remove_spread(df, spread_lines(df, text_col, site_col, sites), text_col)
