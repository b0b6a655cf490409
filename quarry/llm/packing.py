"""Best-fit packing of token pieces into sequences of a fixed length, by exact complements.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers, and is made on the
driver. The longest open piece leaves a gap; an index of single lengths, of sums of pairs and of sums of triples
is asked for a combination that fills the gap exactly, and as many such sequences are made at once as the
counts allow. Where no combination fits, the largest piece that fits (the best fit) goes in and the smaller gap is
asked again. Each step uses up a length, so the plan has some thousands of entries for any number of
rows. Pieces take their places by their rank among the pieces of their length."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch
from quarry.llm.token_ids import loaded

CAPACITY = 4096
PIECES = "id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


@dataclass
class Plan:
    """For each length, intervals of ranks: those from ``first`` on go to consecutive sequences from ``sequence`` on, at ``offset``."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        key = np.array(self.length, np.int64) << 44 | np.array(self.first, np.int64)
        order = np.argsort(key)
        return key[order], np.array(self.first, np.int64)[order], np.array(self.sequence, np.int64)[order], np.array(self.offset, np.int32)[order]


class _Index:
    """Lengths in stock, and for each sum how many unordered pairs and triples of different lengths make it."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.stock = np.zeros(capacity + 1, np.int64)
        self.here = np.zeros(capacity + 1, bool)
        self.pairs, self.triples = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if n:
                rest = capacity + 1 - length
                self.triples[length:] += self.pairs[:rest].copy()  # sums of pairs without this length
                self.pairs[length:] += self.here[:rest]
                self.stock[length], self.here[length] = n, True

    def take(self, combination: tuple[int, ...], times: int) -> None:
        for length in combination:
            self.stock[length] -= times
            if not self.stock[length]:
                self.here[length] = False
                rest = len(self.here) - length
                self.pairs[length:] -= self.here[:rest]
                self.triples[length:] -= self.pairs[:rest].copy()

    def times(self, combination: tuple[int, ...]) -> int:
        return min(int(self.stock[x]) // combination.count(x) for x in set(combination))

    def pair(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of that sum that are in stock beside ``held``; the largest first."""
        low = np.flatnonzero(self.here[1 : total // 2 + 1]) + 1
        for small in low[self.here[total - low]].tolist():
            if self.times((*held, total - small, small)):
                return (total - small, small)
        return None

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        if self.here[gap] and self.times((*held, gap)):
            return (gap,)
        if (self.pairs[gap] or gap % 2 == 0 and self.here[gap // 2]) and (found := self.pair(gap, held)):
            return found
        third = np.flatnonzero(self.here[1 : gap - 1]) + 1
        rest = gap - third
        doubled = (rest % 2 == 0) & self.here[rest // 2]  # a length twice, beside the third
        if not self.triples[gap]:
            third, rest, doubled = third[doubled], rest[doubled], doubled[doubled]
        for length in third[(self.pairs[rest] > 0) | doubled][::-1].tolist():
            if self.times((*held, length)) and (found := self.pair(gap - length, (*held, length))):
                return (length, *found)
        return None

    def best(self, gap: int, held: tuple[int, ...]) -> int | None:
        fitting = np.flatnonzero(self.here[1 : gap + 1]) + 1
        return next((length for length in fitting[::-1].tolist() if self.times((*held, length))), None)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for so many pieces of each length from 1 to ``capacity``."""
    index, out, used = _Index(counts, capacity), Plan(), dict.fromkeys(counts, 0)
    longest = capacity
    while True:
        while longest and not index.here[longest]:
            longest -= 1
        if not longest:
            return out
        held: tuple[int, ...] = (longest,)
        while gap := capacity - sum(held):
            if found := index.exact(gap, held):
                held += found
                break
            if (more := index.best(gap, held)) is None:
                break
            held += (more,)
        times, offset = index.times(held), 0
        for nth, length in enumerate(held):
            out.length.append(length)
            out.first.append(used[length])
            out.sequence.append(out.sequences)
            out.offset.append(offset)
            used[length] += times
            offset += length
        out.sequences += times
        for length in set(held):
            index.take((length,), times * held.count(length))


def _cutter(definition: str, end_id: int, capacity: int):
    def cut(batches):
        ids_of, part = loaded(definition), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            names = iter(batch.column("id").to_pylist())
            for ids, counts in ids_of.many(batch.column("text"), end_id):
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for count in counts.tolist():
                    doc_id = next(names)
                    for piece, lo in enumerate(range(0, count, capacity)):
                        n = min(capacity, count - lo)
                        rows.append((doc_id, piece, lo, n, zlib.crc32(raw[4 * (at + lo) : 4 * (at + lo + n)]), part, seen[n]))
                        seen[n] += 1
                    at += count
            for lo in range(0, len(rows), 20_000):
                columns = zip(*rows[lo : lo + 20_000], strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return cut


def _placer(arrays):
    def place(batches):
        keys, first, sequence, offset = arrays.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; a null text has the end id alone. Documents of more than
    ``capacity`` ids are cut into pieces of that many, the last maybe shorter; no other is cut. Repeated
    rows and repeated or null ids each are documents of their own. Sequences are numbered from 0 and
    hold pieces without gaps from offset 0 on. An empty table gives no rows. Other columns are not
    read. The tokenizer's file is read on the driver. ``id_col`` holds integers."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.keep(docs.mapInArrow(_cutter(definition, end_id, capacity), PIECES), "pieces")
    # ranks run on from partition to partition: for each length a row for each partition
    by_part = scratch.keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    arrays = spark.sparkContext.broadcast(plan(counts, capacity).arrays())
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(arrays), "id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int")
    return placed.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
