"""Token ids of whole texts, by the tokenizers library.

For a vocabulary whose pre-tokenizer drops white space, no token and no normalisation step reaches across
ASCII white space, so a text's ids are those of its space-separated chunks one after another. Chunks recur: those of
some megabytes of texts are told apart by a hash table in Arrow, each distinct one is looked up in a bounded table or goes to the
library once, and ids are put together by index. The ids are the library's own. For any other vocabulary whole texts go to
the library."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: The normaliser and the pattern under which chunks are independent of each other.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The least byte that begins a character from U+0300 on; below it composition changes nothing and lower-casing ASCII first is safe.
BEYOND = 0xCC
#: Marks that may end a chunk, and characters before them that the pattern always parts from them and that lower-casing leaves alone.
MARKS, BEFORE = '!"#$%&()*+,-./:;=>?@[\\]^`{|}~', r"[a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}]$"
#: Bytes of texts whose chunks are told apart at once. A longer text is taken alone, and whole.
PART_BYTES = 16 << 20


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose ``sizes`` add up to ``most``, or a single larger row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - stops + lengths).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def _strings(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Kept:
    """What ``make`` gives for each of some keys, kept. Two generations of about ``limit`` entries bound it; what is used stays."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.now, self.old = make, limit, {}, {}

    def all(self, keys: list) -> list[bytes]:
        if len(self.now) >= self.limit:
            self.now, self.old = {}, self.now
        out = list(map(self.now.get, keys))
        for i in [i for i, value in enumerate(out) if value is None]:
            key = keys[i]
            if (value := self.now.get(key)) is None and (value := self.old.get(key)) is None:
                value = self.make(key)
            out[i] = self.now[key] = value
        return out


class _Table:
    """Ids of words, kept in Arrow, so that known words never become Python strings. Beyond ``limit`` words those stay that came since the last time."""

    def __init__(self, make, dtype: np.dtype, limit: int):
        self.make, self.limit = make, limit
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, dtype)
        self.lengths, self.used = np.zeros(0, np.int64), np.zeros(0, bool)

    def _keep(self, these: np.ndarray) -> None:
        starts = np.cumsum(self.lengths) - self.lengths
        self.words, self.ids = self.words.take(pa.array(these)), self.ids[spread(starts[these], self.lengths[these])]
        self.lengths = self.lengths[these]
        self.used = np.zeros(len(these), bool)

    def all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the table, and where those of each word, all different, start and how many they are."""
        if len(self.words) >= self.limit:
            self._keep(np.flatnonzero(self.used))
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        if len(new):
            at[at < 0] = len(self.words) + np.arange(len(new))
            made = list(map(self.make, _strings(new)))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), self.ids.dtype)])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int64, len(made))])
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
        self.used[at] = True
        return self.ids, (np.cumsum(self.lengths) - self.lengths)[at], self.lengths[at]


class TokenIds:
    """Ids of texts, of numpy type ``dtype``; built from the text of a tokenizer file."""

    def __init__(self, definition: str, cache: int = 500_000):
        self.library = Tokenizer.from_str(definition)
        told = json.loads(definition)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        steps = (told.get("normalizer") or {}).get("normalizers", [])
        split = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = [x["type"] for x in steps] == NORMALISERS and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern", {}).get("Regex") == SPLIT and not any(x["content"].split() != [x["content"]] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"])
        #: The library matches these before it lowers; texts that hold one in any case keep their letters.
        self.added = [x["content"].lower() for x in told["added_tokens"]]
        self.letters = _byte_letters()
        self.model = self.library.model
        self.lower, self.raw = _Table(self._simple, self.dtype, cache), _Kept(self._whole, cache // 8)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _whole(self, chunk: str) -> bytes:
        return self._pack(self.library.encode(chunk, add_special_tokens=False).ids)

    def _simple(self, chunk: str) -> list[int]:
        """A chunk of characters below U+0300 with its ASCII letters lowered."""
        if chunk.isalpha() and chunk == chunk.lower():
            letters = chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode()))
            return [t.id for t in self.model.tokenize(letters)]
        return self.library.encode(chunk, add_special_tokens=False).ids

    def _apart(self, text: str) -> np.ndarray:
        """A text by itself, with its own letters."""
        # as bytes are split: at ASCII white space alone
        chunks = [c.decode() for c in text.encode().split()] if self.by_chunk else [text]
        return np.frombuffer(b"".join(self.raw.all(chunks)), self.dtype)

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts whose ASCII letters are lowered."""
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        each = chunks.dictionary
        stems = pc.ascii_rtrim(each, characters=MARKS)
        heads = pc.if_else(pc.match_substring_regex(stems, BEFORE), stems, each)
        marked = np.flatnonzero(pc.not_equal(heads, each).to_numpy(zero_copy_only=False))
        ends: dict[str, int] = {"": 0}
        tail = np.zeros(len(each), np.int64)
        tail[marked] = [ends.setdefault(c[len(h) :], len(ends)) for c, h in zip(_strings(each.take(pa.array(marked))), _strings(heads.take(pa.array(marked))), strict=True)]
        heads = heads.dictionary_encode()
        ids, starts, lengths = self.lower.all(heads.dictionary)
        known = self.raw.all(list(ends))
        more = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        starts, lengths = np.concatenate([starts, len(ids) + np.cumsum(more) - more]), np.concatenate([lengths, more])
        ids = np.concatenate([ids, np.frombuffer(b"".join(known), self.dtype)])
        runs = np.column_stack([heads.indices.to_numpy(), tail + len(heads.dictionary)]).ravel()
        ids = ids[spread(starts[runs], lengths[runs])]
        lengths = lengths[runs].reshape(-1, 2).sum(1)
        at = chunks.indices.to_numpy()
        taken = lengths[at]
        stops = np.concatenate([[0], np.cumsum(taken)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids[spread((np.cumsum(lengths) - lengths)[at], taken)], np.diff(stops)

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart = np.full(len(texts), not self.by_chunk)
        lowered = texts
        if self.by_chunk:
            lowered = pc.ascii_lower(texts)
            # what all added tokens begin with is looked for in every text, each of them only where that is
            near = np.flatnonzero(pc.match_substring(lowered, commonprefix(self.added)).to_numpy(zero_copy_only=False)) if self.added else []
            for token in self.added if len(near) else []:
                apart[near] |= pc.match_substring(lowered.take(pa.array(near)), token).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            low = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
            high = np.flatnonzero(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : low + (ends[-1] if len(ends) else 0)] >= BEYOND)
            apart[np.searchsorted(ends, high, side="right")] = True
        if not apart.any():
            return self._chunked(lowered)
        ids, counts = self._chunked(lowered.filter(pa.array(~apart)))
        plain, own = iter(np.split(ids, np.cumsum(counts)[:-1])), iter(texts.filter(pa.array(apart)).to_pylist())
        each = [self._apart(next(own)) if a else next(plain) for a in apart.tolist()]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def many(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, in their order, all their ids and how many each has. Null is empty; ``end`` follows each text, if given."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        for lo, hi in parts(pc.binary_length(texts).to_numpy(zero_copy_only=False), PART_BYTES):
            ids, counts = self._part(texts.slice(lo, hi - lo))
            if end is not None:
                closed, stops = np.empty(len(ids) + len(counts), self.dtype), np.cumsum(counts + 1) - 1
                inside = np.ones(len(closed), bool)
                inside[stops] = False
                closed[stops], closed[inside] = end, ids
                ids, counts = closed, counts + 1
            yield ids, counts

    def __call__(self, text: str) -> list[int]:
        return [i for ids, _ in self.many(pa.array([text])) for i in ids.tolist()]


_LOADED: dict[int, TokenIds] = {}


def loaded(definition: str) -> TokenIds:
    """One instance for each worker process and definition."""
    key = hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TokenIds(definition)
    return _LOADED[key]
