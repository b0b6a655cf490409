"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into one machine: the normaliser (a leading mark, spaces to marks), a trie of pieces whose final
states write an id at a weight, and byte fallback, which writes the bytes of a character that is no piece. Composing it with
an input gives a lattice over the input's positions, and the encoding is its shortest path in the tropical semiring.

In a unigram model weights are negated scores. In a byte-pair model every piece weighs nothing, and an acceptor over
neighbours is composed: two pieces may follow each other only if merging their joined text ends in
these two, else the step weighs infinity. A text's merged pieces are exactly the path all of whose neighbours agree in that way, so one finite path is left."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Recent, ship

MARK = "▁"
#: Fixed values of the model file: types of pieces, types of models, and how much worse than the worst piece an unknown character is.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Definition:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Definition:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                out.dummy_prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("only models whose normaliser keeps characters and white space are taken")
        if any(kind == USER for _, _, kind in out.pieces):
            raise ValueError("user-defined pieces are not taken")
        return out


class Machine:
    """The compiled transducer. ``cache`` bounds the chunks whose paths are kept."""

    def __init__(self, definition: Definition, cache: int = 250_000):
        self.definition = definition
        self.text = [p for p, _, _ in definition.pieces]
        self.id = {p: i for i, (p, _, kind) in enumerate(definition.pieces) if kind == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(definition.pieces) if kind == BYTE}
        self.value = {i: b for b, i in self.byte_id.items()}
        self.unknown = next((i for i, (_, _, kind) in enumerate(definition.pieces) if kind == UNKNOWN), 0)
        self.silent = {i for i, (_, _, kind) in enumerate(definition.pieces) if kind == CONTROL}
        self.rank = {p: -definition.pieces[i][1] for p, i in self.id.items()}
        self.worst = max(self.rank.values(), default=0.0) + UNKNOWN_PENALTY
        self.is_bpe = definition.kind == BPE
        # states of the trie: a row of arcs each; a final state writes its piece
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[str | None] = [None]
        for piece in self.id:
            if not self.is_bpe or self.merged(piece) == [piece]:  # a piece that merging never makes has no path
                state = 0
                for c in piece:
                    if c not in self.arcs[state]:
                        self.arcs[state][c] = len(self.arcs)
                        self.arcs.append({})
                        self.final.append(None)
                    state = self.arcs[state][c]
                self.final[state] = piece
        # no piece goes on after a mark that follows another character, nor over characters that only stand alone
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.id)
        alone = "\n" if not any("\n" in p and len(p) > 1 for p in self.id) else ""
        self.chunk = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # two characters that no piece has side by side are never joined: a text falls apart between them
        self.beside = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self.raw = [bytes([self.value[i]]) if i in self.value else b"" if i in self.silent else None if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        self.agree = Recent(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], cache)
        self.known = Recent(self._ids, cache)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging by its definition: the best-ranked pair, the leftmost of equal ones, until no pair is a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == math.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def step(self, before: str | None, piece: str) -> float:
        """Weight of a piece after another."""
        if not self.is_bpe:
            return self.rank.get(piece, self.worst)
        return 0.0 if before is None or self.agree[before, piece] else math.inf

    def path(self, text: str) -> list[str]:
        """Pieces and lone characters on the shortest path through the lattice of ``text``."""
        n, arcs, final, step = len(text), self.arcs, self.final, self.step
        cost: list[float] = [0.0] + [math.inf] * n
        back: list[str | None] = [None] * (n + 1)
        for i in range(n):
            here = cost[i]
            if here == math.inf:
                continue
            state, j, last = 0, i, back[i]
            while j < n and (state := arcs[state].get(text[j], -1)) >= 0:
                j += 1
                # weights are not negative, so a place reached as cheaply already needs no look
                if (piece := final[state]) is not None and here < cost[j] and (now := here + step(last, piece)) < cost[j]:
                    cost[j], back[j] = now, piece
            c = text[i]
            if c not in self.id and here < cost[i + 1] and (now := here + step(last, c)) < cost[i + 1]:
                cost[i + 1], back[i + 1] = now, c
        out, i = [], n
        while i:
            out.append(back[i])
            i -= len(out[-1])
        return out[::-1]

    def _ids(self, chunk: str) -> bytes:
        cuts = [i for i, pair in enumerate(zip(chunk, chunk[1:], strict=False), 1) if pair not in self.beside] if self.is_bpe else []
        if cuts:
            return b"".join([self.known[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)])
        out: list[int] = []
        for piece in self.path(chunk):
            if piece in self.id:
                out.append(self.id[piece])
            elif self.definition.byte_fallback:
                out += [self.byte_id[b] for b in piece.encode()]
            elif not (out and out[-1] == self.unknown and not self.is_bpe):
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, "<i4")
        normal = (MARK if self.definition.dummy_prefix else "") + text.replace(" ", MARK)
        chunks = self.chunk.findall(normal) if self.splits else [normal]
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<i4")

    def decode(self, ids) -> str:
        """Text of ids; ids of control pieces write nothing, the unknown one writes U+2047 between spaces, and bytes that make no character U+FFFD each."""
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
            return text[1:] if self.definition.dummy_prefix and text.startswith(" ") and self.text[ids[0]].startswith(MARK) else text
        except (TypeError, UnicodeDecodeError):
            return self._decode_odd(ids)

    def _decode_odd(self, ids) -> str:
        """Decoding where bytes make no character or unknown pieces stand."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            if raw:
                out.append(raw.decode("utf-8", "quarry-each"))
                raw.clear()

        for i in ids:
            if (b := self.value.get(i)) is not None:
                raw.append(b)
                continue
            flush()
            out.append("" if i in self.silent else " ⁇ " if i == self.unknown else self.text[i])
        flush()
        text = "".join(out)
        if self.definition.dummy_prefix and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


def _register() -> None:
    import codecs

    codecs.register_error("quarry-each", lambda e: ("�", e.start + 1))


_register()
_LOADED: dict[int, Machine] = {}


def machine(data: bytes) -> Machine:
    key = zlib.crc32(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Machine(Definition.parse(data))
    return _LOADED[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as array<int>; null for null, empty for empty.

    All columns and repeated rows stay; a column named ``ids_col`` is replaced. Texts of any length are encoded whole. An empty table
    gives no rows. The model's file is read on the driver; one with a character map, folded space or user-defined pieces is refused with a ValueError."""
    ship(df.sparkSession)
    data = _model(model_path)
    base = df.drop(ids_col)

    def run(batches):
        own = machine(data)
        for batch in batches:
            ids = [None if t is None else own.encode(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col])

    return base.mapInArrow(run, _with(base, ids_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; null for null, empty for empty. A column named ``text_col`` is replaced, all others and repeated rows stay. An empty table gives no rows."""
    ship(df.sparkSession)
    data = _model(model_path)
    base = df.drop(text_col)

    def run(batches):
        own = machine(data)
        for batch in batches:
            texts = [None if i is None else own.decode(i) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return base.mapInArrow(run, _with(base, text_col, T.StringType()))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def summaries(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and whether decoding gives the text again.

    Null texts count as empty. Encoding and decoding run in one worker, with one machine. Other columns are not read."""
    ship(df.sparkSession)
    data = _model(model_path)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        own = machine(data)
        for batch in batches:
            n, crcs, same = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text or "")
                n.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
                same.append(own.decode(ids.tolist()) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names=["id", "n_ids", "ids_crc32", "round_trip"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
