"""Contiguous shards of near-equal bytes, cut from a global prefix sum of sizes.

Rows are range-partitioned by identifier; each partition sums its own sizes, the totals of the partitions
(one row for each partition) give every partition its start, and a row belongs to the shard in whose
equal share of all bytes its middle byte lies."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, by_range, sent, text_or_empty

OVERHEAD = 16


def _running(batches):
    """Adds the partition's number and, inside it, each row's rank and the bytes before it."""
    part, rows, size_so_far = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size) + size_so_far
        columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n, dtype=np.int64)), pa.array(ends - size)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "rank", "before"])
        rows += n
        size_so_far = int(ends[-1]) if n else size_so_far


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, shard (0 to ``shards`` - 1), slot in the shard.

    Size is the UTF-8 length of the text (null: 0) plus 16. Shards are contiguous in the order of id; a
    shard departs from an equal share by at most the size of one row at either end, so with fewer rows
    than shards, or rows larger than a share, some shards are empty. Null ids come first; rows of one id are ordered by
    size and checksum; repeated rows each keep a place. An empty table gives no rows. Other columns are
    not read."""
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text_or_empty(text_col)).cast("long") + OVERHEAD).alias("size"), F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"))
    order = ["id", "size", "text_crc32"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, size long, text_crc32 long, part int, rank long, before long"
    placed = scratch.keep(by_range(scratch.keep(rows, "sizes"), *order).sortWithinPartitions(*order).mapInArrow(_running, schema), "running")
    # one row for each partition, however many rows there are
    totals = placed.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("part").collect()
    starts = zip((r["part"] for r in totals), accumulate((r["size"] for r in totals), initial=0), accumulate((r["n"] for r in totals), initial=0), strict=False)
    starts = spark.createDataFrame(list(starts), "part int, bytes_before long, rows_before long")
    total = max(1, sum(r["size"] for r in totals))
    shard = F.expr(f"least({shards - 1}, ((2 * (before + bytes_before) + size) * {shards}L) div {2 * total}L)").cast("int")
    cut = placed.join(sent(starts, len(totals)), "part").select("id", "size", "text_crc32", (F.col("rank") + F.col("rows_before")).alias("place"), shard.alias("shard"))
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first")).collect()  # at most one row for each shard
    by_shard = spark.createDataFrame([(r["shard"], r["first"]) for r in firsts], "shard int, first long")
    return cut.join(sent(by_shard, len(firsts)), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
