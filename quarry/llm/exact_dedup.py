"""Exact duplicates by sorting content.

Normalised texts are range-partitioned at sampled splitters and sorted externally, so equal ones stand next
to each other; neighbours are compared in full. Splitters are made of a bounded prefix, a hash and the
identifier, so a group of any size spreads over as many partitions as its rows need; only runs with the
first or the last hash of a partition can go on elsewhere, and those are joined again by their whole text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Scratch, by_range, text_or_empty

SPACES = " \t\n\x0b\f\r"
PREFIX = 32


def normalised(column: str):
    return F.translate(text_or_empty(column), SPACES, "")


def _runs(batches):
    """Runs of equal neighbours in one sorted partition. Holds a few numbers for each row, and texts of a batch."""
    part, last, first_hash, last_hash = TaskContext.get().partitionId(), None, None, None
    ids, points, run_of, digests, first_text, last_text, run = [], [], [], [], {}, {}, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        text, hashes = batch.column("norm"), batch.column("hash")
        first_hash = hashes[0].as_py() if first_hash is None else first_hash
        starts = np.ones(batch.num_rows, bool)
        starts[0] = last is None or text[0].as_py() != last
        if batch.num_rows > 1:
            starts[1:] = pc.not_equal(text.slice(1), text.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(starts):
            now, key = text[int(i)].as_py(), hashes[int(i)].as_py()
            if key != last_hash:
                last_hash, last_text = key, {}
            last_text[len(digests)] = now  # of one hash there is one text, but for collisions
            if key == first_hash:
                first_text[len(digests)] = now
            digests.append(hashlib.sha256(now.encode()).hexdigest())
        run_of.append(run + np.cumsum(starts))
        run, last = int(run_of[-1][-1]), text[batch.num_rows - 1].as_py()
        ids.append(batch.column("id"))
        points.append(batch.column("points").to_numpy(zero_copy_only=False))
    if run < 0:
        return
    edge_text = first_text | last_text
    id_array, point, at = pa.chunked_array(ids).combine_chunks(), np.concatenate(points), np.concatenate(run_of)
    missing = id_array.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(id_array, 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((np.arange(len(at)), value, missing, -point, at))  # in each run: most code points, then smallest id
    first = np.concatenate([[True], at[1:] != at[:-1]])
    best, size = order[first], np.bincount(at)
    is_best, is_edge = np.zeros(len(at), bool), np.isin(at, list(edge_text))
    is_best[best] = True
    keep = id_array.take(pa.array(best[at]))
    for lo in range(0, len(at), 10_000):
        s = slice(lo, lo + 10_000)
        edge = [edge_text[a] if b and e else None for a, b, e in zip(at[s].tolist(), is_best[s].tolist(), is_edge[s].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [id_array[s], pa.array(np.full(len(at[s]), part, np.int32)), pa.array(at[s].astype(np.int32)), pa.array(is_best[s]), keep[s], pa.array(point[best[at[s]]].astype(np.int64)), pa.array(size[at[s]].astype(np.int64)), pa.array([digests[a] for a in at[s]]), pa.array(edge, pa.string())],
            names=["id", "part", "run", "best", "keep", "keep_points", "size", "text_sha256", "edge"],
        )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if they are so without the characters space and U+0009 to U+000D; null counts as empty,
    and empty texts are one group. The row with the most code points stays, then the smallest id, null ids
    last; of repeated rows that tie in both, exactly one is kept. An empty table gives no rows. Other columns are not
    read, so their names do not matter. ``id_col`` holds integers."""
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.char_length(text_or_empty(text_col)).cast("long").alias("points"), normalised(text_col).alias("norm"))
    keyed = rows.select("id", "points", "norm", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash"))
    dealt = by_range(keyed, "prefix", "hash", "id").sortWithinPartitions("prefix", "hash", "norm", "id").select("id", "points", "norm", "hash")
    runs = scratch.keep(dealt.mapInArrow(_runs, "id long, part int, run int, best boolean, keep long, keep_points long, size long, text_sha256 string, edge string"), "runs")
    edges = runs.filter(F.col("edge").isNotNull()).select("part", "run", "edge", "size", F.struct((-F.col("keep_points")).alias("less"), F.col("keep").isNull().alias("none"), F.col("keep").alias("keep"), F.col("part").alias("part"), F.col("run").alias("run")).alias("candidate"))
    whole = edges.groupBy("edge").agg(F.sum("size").alias("all_size"), F.min("candidate").alias("winner"))
    # two rows for each partition but for colliding hashes, without their texts: a written table, whose size decides whether it is sent to every task
    joined = scratch.keep(edges.join(whole, "edge").select("part", "run", "all_size", "winner"), "edges")
    wins = (F.col("winner.part") == F.col("part")) & (F.col("winner.run") == F.col("run"))
    out = runs.drop("edge").join(joined, ["part", "run"], "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("winner").isNull(), F.col("keep")).otherwise(F.col("winner.keep")).alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), (F.col("best") & F.coalesce(wins, F.lit(True))).alias("kept"), "text_sha256")


def _bests(batches):
    """Of each run of equal neighbours the row that stays in this partition; ``edge`` has the text of those that may go on elsewhere."""
    part, first_hash, held, made = TaskContext.get().partitionId(), None, None, 0

    def told(rows: pa.Table, edge: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        rows = rows.combine_chunks()
        norm = pa.array([t if e else None for t, e in zip(rows["norm"].to_pylist(), edge.tolist(), strict=True)], pa.string())
        at = pa.array(np.arange(made, made + rows.num_rows, dtype=np.int64))
        made += rows.num_rows
        columns = [rows["row"], rows["id"], rows["points"], pa.array(np.full(rows.num_rows, part, np.int32)), at, norm]
        return pa.Table.from_arrays(columns, names=["row", "id", "points", "part", "run", "edge"]).combine_chunks()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        if not rows.num_rows:
            continue
        norm, hashes = rows["norm"].combine_chunks(), rows["hash"].to_numpy()
        first_hash = hashes[0] if first_hash is None else first_hash
        starts = np.ones(rows.num_rows, bool)
        if rows.num_rows > 1:
            starts[1:] = pc.not_equal(norm.slice(1), norm.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = np.cumsum(starts)
        missing, value = rows["id"].is_null().to_numpy(), pc.fill_null(rows["id"], 0).to_numpy()
        order = np.lexsort((np.arange(len(at)), value, missing, -rows["points"].to_numpy(), at))
        best = rows.take(pa.array(order[np.concatenate([[True], at[1:] != at[:-1]])]))
        own = best["hash"].to_numpy()
        tail = own == hashes[-1]
        held = best.filter(pa.array(tail))
        if not tail.all():
            yield from told(best.filter(pa.array(~tail)), own[~tail] == first_hash).to_batches()
    if held is not None:
        yield from told(held, np.ones(held.num_rows, bool)).to_batches()


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each group of :func:`exact_groups` exactly one.

    Rows are carried through the sort, so repeated rows and null ids need no join back."""
    scratch = Scratch(df.sparkSession, "deduplicated")
    text = F.col(f"row.`{text_col}`").cast("string")
    norm = F.translate(F.coalesce(text, F.lit("")), SPACES, "")
    rows = df.select(F.struct("*").alias("row")).select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("points"), F.substring(norm, 1, PREFIX).alias("prefix"), F.xxhash64(norm).alias("hash"))
    dealt = by_range(rows, "prefix", "hash", "id").withColumn("norm", norm).sortWithinPartitions("prefix", "hash", "norm", "id").select("row", "id", "points", "hash", "norm")
    schema = T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in (("id", T.LongType()), ("points", T.LongType()), ("part", T.IntegerType()), ("run", T.LongType()), ("edge", T.StringType())))])
    best = scratch.keep(dealt.mapInArrow(_bests, schema), "best")
    edges = best.filter(F.col("edge").isNotNull()).select("edge", F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id", "part", "run").alias("candidate"))
    winners = edges.groupBy("edge").agg(F.min("candidate").alias("winner"))
    lost = scratch.keep(edges.join(winners, "edge").filter(F.col("candidate.part") * F.lit(1 << 40) + F.col("candidate.run") != F.col("winner.part") * F.lit(1 << 40) + F.col("winner.run")).select("candidate.part", "candidate.run"), "lost")
    # two rows for each partition but for colliding hashes, in a table whose size decides how it is joined
    return best.join(lost, ["part", "run"], "left_anti").select("row.*")
