"""Token-id files: documents in ascending order of id, in range-coded, checksummed blocks.

A file is the token stream of one range of ids, stored as Parquet rows (file, block, payload) so that Spark's
writers commit it and any store can hold it. A payload stands for itself: ``QTC2``, the counts of ids, segments
and coded bytes, the place of its first id in the file, the segments, the coded ids, and a CRC-32 of all before it. A
segment says which document the next ids belong to. Each block holds up to 2048 ids and is coded from empty tables, so
one block is read, checked and decoded without any other."""

from __future__ import annotations

import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, by_range, sent, ship
from quarry.llm.range_coder import decode, encode
from quarry.llm.token_ids import loaded

MAGIC = b"QTC2"
HEAD = struct.Struct("<4sIIIQ")
SEGMENT = np.dtype([("ordinal", "<u8"), ("id", "<i8"), ("known", "u1"), ("before", "<u8"), ("n", "<u4")])
BLOCK = 2048
#: Blocks that are coded side by side, and decoded: decoding has more steps for each id, which more blocks share.
CODED, LANES = 1024, 3072


def pack_block(ids: np.ndarray, coded: bytes, first: int, segments: np.ndarray) -> bytes:
    body = HEAD.pack(MAGIC, len(ids), len(segments), len(coded), first) + segments.tobytes() + coded
    return body + struct.pack("<I", zlib.crc32(body))


def open_block(payload: bytes) -> tuple[int, int, np.ndarray, bytes]:
    """Count of ids, place of the first, segments and coded ids. ValueError if the block is damaged."""
    if len(payload) < HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged token block: checksum")
    magic, n, segments, coded, first = HEAD.unpack_from(payload)
    at = HEAD.size + segments * SEGMENT.itemsize
    if magic != MAGIC or at + coded + 4 != len(payload):
        raise ValueError("damaged token block: header")
    return n, first, np.frombuffer(payload, SEGMENT, segments, HEAD.size), payload[at : at + coded]


def _writer(definition: str, end_id: int):
    def coded(blocks: list[tuple[np.ndarray, int, list[tuple]]], first_block: int, part: int) -> pa.RecordBatch:
        streams = encode([ids for ids, _, _ in blocks])
        payloads = [pack_block(ids, c, first, np.array(segments, SEGMENT)) for (ids, first, segments), c in zip(blocks, streams, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array(range(first_block, first_block + len(blocks)), pa.int32()), pa.array(payloads, pa.binary())], names=["file", "block", "payload"])

    def run(batches):
        ids_of, part = loaded(definition), TaskContext.get().partitionId()
        blocks: list[tuple[np.ndarray, int, list[tuple]]] = []
        rest, open_segments = np.zeros(0, ids_of.dtype), []  # of the block that is open
        done, ordinal, made = 0, 0, 0
        for batch in batches:
            names = iter(batch.column("id").to_pylist())
            for ids, counts in ids_of.many(batch.column("text"), end_id):
                filled = len(rest)
                ids = np.concatenate([rest, ids])
                at = 0  # of the block that is open, in ids
                for count in counts.tolist():
                    doc_id, before = next(names), 0
                    while before < count:
                        n = min(count - before, BLOCK - filled)
                        open_segments.append((ordinal, doc_id or 0, doc_id is not None, before, n))
                        filled, before = filled + n, before + n
                        if filled == BLOCK:
                            blocks.append((ids[at : at + BLOCK], done, open_segments))
                            at, done, filled, open_segments = at + BLOCK, done + BLOCK, 0, []
                            if len(blocks) == CODED:
                                yield coded(blocks, made, part)
                                made, blocks = made + len(blocks), []
                    ordinal += 1
                rest = ids[at:].copy()
        if len(rest):
            blocks.append((rest, done, open_segments))
        if blocks:
            yield coded(blocks, made, part)

    return run


def write_files(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Writes the token ids of all rows of ``df`` under ``path``, in ascending order of id, null ids first.

    A null text is empty; every document ends with ``end_id``. Rows of one id are ordered by their text. An empty table
    makes a folder without blocks. Other columns are not read. ``id_col`` holds integers. A vocabulary of more than
    65,536 ids is refused with a ValueError."""
    ship(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    if loaded(definition).dtype.itemsize != 2:
        raise ValueError("the coder takes ids under 65536")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = by_range(docs, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_writer(definition, end_id), "file int, block int, payload binary").write.mode("overwrite").option("compression", "none").parquet(path)


def _blocks(batches):
    """Ids of each block, LANES of them decoded at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, LANES):
            part = batch.slice(lo, LANES)
            opened = [open_block(p) for p in part.column("payload").to_pylist()]
            ids = decode([c for _, _, _, c in opened], [n for n, _, _, _ in opened])
            yield part.column("file"), opened, ids


def _segments(batches):
    for files, opened, ids in _blocks(batches):
        rows = []
        for file, (_, first, segments, _), own in zip(files.to_pylist(), opened, ids, strict=True):
            raw, at = memoryview(own.astype("<u4").tobytes()), 0
            for ordinal, doc_id, known, before, n in segments.tolist():
                rows.append((file, ordinal, doc_id if known else None, before, first + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                at += n
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "ordinal", "id", "before", "at", "n", "crc"])


def _times(matrix: list[int], register: int) -> int:
    """A CRC register through a linear map, given by what it makes of each bit."""
    out = 0
    for column in matrix:
        if register & 1:
            out ^= column
        register >>= 1
    return out


def _zeros() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes make of a register: the first from the polynomial, the others by squaring."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    out = []
    for power in range(3 + 48):
        if power >= 3:
            out.append(step)
        step = [_times(step, x) for x in step]
    return out


ZEROS = _zeros()


def crc32_joined(crc: int, other: int, length: int) -> int:
    """CRC-32 of two strings one after the other, from that of each and the ``length`` in bytes of the second."""
    for matrix in ZEROS:
        if length & 1:
            crc = _times(matrix, crc)
        length >>= 1
        if not length:
            break
    return crc ^ other


def _join_crc(batches):
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            total = None
            for p in parts:
                total = p["crc"] if total is None else crc32_joined(total, p["crc"], 4 * p["n"])
            out.append(total)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "ordinal", "id", "at", "n")), pa.array(out, pa.int64())], names=["file", "ordinal", "id", "at", "n", "crc"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.schema("file int, block int, payload binary").parquet(path)


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32, each decoded from the blocks.

    A damaged block fails the read."""
    scratch = Scratch(spark, "tokens")
    segments = scratch.keep(read_blocks(spark, path).mapInArrow(_segments, "file int, ordinal long, id long, before long, at long, n long, crc long"), "segments")
    # one row for each file
    files = segments.groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect()
    starts = spark.createDataFrame([(f["file"], s) for f, s in zip(files, accumulate((f["n"] for f in files), initial=0), strict=False)], "file int, file_start long")
    docs = segments.groupBy("file", "ordinal").agg(F.first("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.count("*").alias("count"), F.min("crc").alias("crc"), F.array_sort(F.collect_list(F.struct("before", "n", "crc"))).alias("parts"))
    docs = scratch.keep(docs.withColumn("parts", F.when(F.col("count") > 1, F.col("parts"))), "documents")
    long = docs.filter("count > 1").select("file", "ordinal", "id", "at", "n", "parts").mapInArrow(_join_crc, "file int, ordinal long, id long, at long, n long, crc long")
    whole = docs.filter("count = 1").select("file", "ordinal", "id", "at", "n", "crc").union(long)
    return whole.join(sent(starts, len(files)), "file").select(F.col("id").alias(id_col), (F.col("at") + F.col("file_start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def _ids(batches):
    for files, opened, ids in _blocks(batches):
        rows = []
        for file, (_, _, segments, _), own in zip(files.to_pylist(), opened, ids, strict=True):
            at = 0
            for ordinal, doc_id, known, before, n in segments.tolist():
                rows.append((file, ordinal, doc_id if known else None, before, own[at : at + n].astype(np.int32)))
                at += n
        a, b, c, d, e = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(list(e), pa.list_(pa.int32()))], names=["file", "ordinal", "id", "before", "ids"])


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the files: id and its ids, the end id with them."""
    parts = read_blocks(spark, path).mapInArrow(_ids, "file int, ordinal long, id long, before long, ids array<int>")
    whole = parts.groupBy("file", "ordinal").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("before", "ids"))).alias("parts"))
    return whole.select(F.col("id").alias(id_col), F.flatten("parts.ids").alias("ids"))
