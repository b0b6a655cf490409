"""Near-duplicates by SimHash, compared bit-sliced.

Distinct fingerprints meet in buckets of two equal quarters: with at most two differing bits, two of the
four quarters are equal, so six tables of buckets miss no link. In a bucket, fingerprints are stored
vertically, 64 of them in a word of each bit plane; a query runs down the planes and adds its differences to
carry-save counters, 64 distances at once, and blocks all of whose distances exceed the radius are abandoned.
A bucket gives a star for each of its components, not its pairs. A bucket over ``bucket_limit`` is dealt once
more by two equal bytes of the half that is not fixed yet, which again misses no link and leaves 65,536 fingerprints at most.

Near copies by the Jaccard similarity of shingle sets (:func:`representatives`) take the same comparison, on fingerprints of 256 bits
within groups that MinHash bands connect; what lies within its wide radius is then counted on the sets themselves."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Scratch, by_hash
from quarry.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
BUCKET_LIMIT = 16_384
#: The pairs of 16-bit quarters that make a bucket's key.
TABLES = [(a, b) for a in range(4) for b in range(a + 1, 4)]
CHUNK = 1 << 16


def _hashes(text: bytes, shingle: int):
    """Hashes of a whole text's shingles, some at a time: A-Z lowered, words between ASCII white space, shingles with repeats, XXH64."""
    words = text.lower().split()
    if not words:
        return
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + CHUNK], stops[lo : lo + CHUNK], strict=True)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: a bit is set if it is in over half of the hashes. No word: 0."""
    total, n = np.zeros(64, np.int64), 0
    for h in _hashes(text, shingle):
        total, n = total + _bit_counts(h), n + len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return run


# --- bit-sliced comparison ---

ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Of fingerprints (n, width) the planes (64 width, words): bit j of word w of plane i is bit i of fingerprint 64 w + j. Missing ones are 0."""
    padded = np.zeros((-(-len(prints) // 64) * 64, prints.shape[1]), np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), 8 * prints.shape[1]), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For block k, the lanes among ``lanes[k]`` whose distance to ``queries[k]`` is ``radius`` at most, as bits. ``planes``: (bits, blocks)."""
    width, last = (radius + 1).bit_length(), len(planes) - 1
    live, planes_now, q, valid = np.arange(len(queries)), planes, queries, lanes
    counters, over = [np.zeros(len(queries), np.uint64) for _ in range(width)], np.zeros(len(queries), np.uint64)
    out = np.zeros(len(queries), np.uint64)
    for i in range(last + 1):
        carry = planes_now[i] ^ (np.uint64(0) - (q[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)))
        for k in range(width):
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        over |= carry
        if i % 8 == 7:
            near = valid & ~(over | _exceeds(counters, radius))
            if i == last:
                out[live] = near
            elif (going := near != 0).mean() < 0.7:
                live, planes_now, q, valid, over = live[going], planes_now[:, going], q[going], valid[going], over[going]
                counters = [c[going] for c in counters]
                if not len(live):
                    break
    return out


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is over ``radius``."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def _near_in_small(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For buckets of up to 64, a block each and all at once: near[p, b] has the lanes of bucket b that are within the radius of its lane p, as bits."""
    n, most = len(starts), int(sizes.max())
    padded = np.zeros((n, 64, prints.shape[1]), np.uint64)
    row, lane = np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[row, lane] = prints[np.repeat(starts, sizes) + lane]
    planes = bit_planes(padded.reshape(n * 64, -1))
    lanes = ONES >> (np.uint64(64) - sizes.astype(np.uint64))
    near = np.zeros((most, n), np.uint64)
    for p in range(most):
        has = np.flatnonzero(sizes > p)
        near[p, has] = within(planes[:, has], padded[has, p], lanes[has], radius)
    return near


def _small(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Position of each fingerprint's root in buckets of up to 64."""
    near = _near_in_small(prints, starts, sizes, radius)
    most, row, lane = len(near), np.repeat(np.arange(len(starts)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    while True:  # widen each lane's set by those of its members until none grows
        before = near.copy()
        for p in range(most):
            for q in range(p):
                met = np.uint64(0) - (near[p] >> np.uint64(q) & np.uint64(1))
                both = near[p] | near[q]
                near[p] = np.where(met, both, near[p])
                near[q] = np.where(met, both, near[q])
        if (before == near).all():
            break
    lowest = near & (np.uint64(0) - near)
    first = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
    return starts[row] + first[lane, row]


def _large(prints: np.ndarray, radius: int) -> np.ndarray:
    """Position of each fingerprint's root in one bucket: the least that links lead to. Each block of 64 is compared with itself and all later ones."""
    root = np.arange(len(prints))
    for q, found in _near_in_large(prints, radius):
        roots = np.unique(root[np.append(found, q)])
        if len(roots) > 1:
            root[np.isin(root, roots[1:])] = roots[0]
    return root


def _near_in_large(prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one bucket each position that has later ones within the radius, and these."""
    n, planes = len(prints), bit_planes(prints)
    valid = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    for lo in range(0, n, 64):
        rest, queries = planes[:, lo // 64 :], prints[lo : lo + 64]
        words = rest.shape[1]
        near = within(np.tile(rest, len(queries)), np.repeat(queries, words, axis=0), np.tile(valid[lo // 64 :], len(queries)), radius)
        hits = np.unpackbits(near.view(np.uint8).reshape(len(queries), 8 * words), axis=1, bitorder="little")
        for q in np.flatnonzero(hits.sum(1, dtype=np.int64) > 1).tolist():
            found = np.flatnonzero(hits[q, q + 1 :])
            if len(found):
                yield lo + q, found + (lo + q + 1)


def _alike_in_size(sizes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Buckets of two to 64 fingerprints, those of like sizes together."""
    at_once = max(64, 4096 // width)  # a bucket takes 64 x 64 bytes for each word while it is turned into planes
    for low, high in ((2, 4), (5, 16), (17, 64)):
        these = np.flatnonzero((sizes >= low) & (sizes <= high))
        for lo in range(0, len(these), at_once):
            yield these[lo : lo + at_once]


def _prints(column: pa.Array) -> np.ndarray:
    """Fingerprints as (n, 1) words."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(column), -1)


def _column(prints: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(prints).view(np.int64).ravel())


def _stars(radius: int):
    """Sorted rows of (key, fp) -> for each fingerprint that is linked in its bucket, the root there."""

    def roots(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        root = np.arange(len(key))
        for pick in _alike_in_size(sizes, prints.shape[1]):
            at = np.repeat(starts[pick] - np.cumsum(sizes[pick]) + sizes[pick], sizes[pick]) + np.arange(sizes[pick].sum())
            root[at] = _small(prints, starts[pick], sizes[pick], radius)
        for k in np.flatnonzero(sizes > 64):
            s = slice(starts[k], starts[k] + sizes[k])
            root[s] = starts[k] + _large(prints[s], radius)
        linked = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([_column(prints[linked]), _column(prints[root[linked]])], names=["u", "v"])

    def run(batches):
        key, fp = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            own = _prints(batch.column("fp"))
            fp = own if fp is None else np.concatenate([fp, own])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if whole:
                yield roots(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield roots(key, fp)

    return run


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) that connect every two fingerprints of column ``fp`` that differ in at most ``radius`` (2 or less) bits."""
    quarter = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(quarter(a), 16)).bitwiseOR(quarter(b)) for t, (a, b) in enumerate(TABLES)])
    placed = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = scratch.keep(placed.join(sizes, "key"), "met")
    # the two quarters that a table does not fix, as one number, and of it two bytes of four
    others = F.array(*[F.shiftleft(quarter(c), 16).bitwiseOR(quarter(d)) for c, d in ([q for q in range(4) if q not in ab] for ab in TABLES)])
    loose = F.element_at(others, F.shiftright("key", 32).cast("int") + 1)
    byte = lambda i: F.shiftright("loose", 8 * i).bitwiseAND(F.lit(0xFF))
    again = F.array(*[F.lit(1 << 60).bitwiseOR(F.shiftleft(F.col("key") * len(TABLES) + t, 16)).bitwiseOR(F.shiftleft(byte(a), 8)).bitwiseOR(byte(b)) for t, (a, b) in enumerate(TABLES)])
    hot = met.filter(F.col("n") > bucket_limit).withColumn("loose", loose).select(F.explode(again).alias("key"), "fp")
    buckets = met.filter(F.col("n") <= bucket_limit).select("key", "fp").union(hot)
    return by_hash(buckets, "key").sortWithinPartitions("key", "fp").mapInArrow(_stars(radius), "u long, v long")


# --- similarity of 0.8 and more: bands of MinHash values make groups, bit-sliced fingerprints are compared in them, the shingle sets decide ---

WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Least values in a band, and bands. Two sets of similarity s share no band with a chance of (1 - s^7)^48, whatever the number of texts: 1.3e-5 at 0.8.
BAND, TABLES_OF_BANDS = 7, 48
#: 64-bit words of a set's fingerprint, and the bits that may differ. Two sets of similarity 0.8 differ in a bit with a chance of 0.15, very small ones of up
#: to 0.19: in 39 to 48 of 256 bits, with a deviation of 6. Over 80 are five deviations away, and unrelated sets at 128 stay six below.
WIDE, WIDE_RADIUS = 4, 80
#: Shingles in a part of a group of candidates: two parts are compared at once, in a task's memory.
PART_SHINGLES = 1 << 20
#: A group of more sets than this is dealt into parts as well, up to so many, so that no task has it alone.
SPLIT_SETS, SPLIT_PARTS = 512, 8


def shingle_set(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, shingle)]))


@lru_cache(4)
def _functions(n: int) -> list[np.ndarray]:
    rng = np.random.default_rng(SEED)
    return [rng.integers(0, 1 << 32, (n, 1), np.uint32), *(rng.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))]


def band_keys(hashes: np.ndarray, tables: int = TABLES_OF_BANDS) -> np.ndarray:
    """A key for each band: the least values of the set under ``BAND`` functions of its own, hashed. No shingle: no key."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    flips, first, second = _functions(BAND * tables)
    low, least = hashes.astype(np.uint32), np.full(BAND * tables, 0xFFFF_FFFF, np.uint32)
    for lo in range(0, len(low), 512):
        x = low[lo : lo + 512] ^ flips
        x *= first
        x ^= x >> np.uint32(15)
        x *= second
        np.minimum(least, x.min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), t) for t, band in enumerate(least.reshape(tables, BAND))], np.uint64).view(np.int64)


def _ratio(similarity: float) -> tuple[int, int]:
    return Fraction(str(similarity)).as_integer_ratio()


def wide_fingerprint(hashes: np.ndarray, width: int = WIDE) -> np.ndarray:
    """SimHash of a set in ``width`` words: the first from the hashes themselves, each other from a mix of them."""
    out, h = np.zeros(width, np.uint64), hashes
    for k in range(width):
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(h), CHUNK):
            counts += _bit_counts(h[lo : lo + CHUNK])
        out[k] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E37_79B9_7F4A_7C15)
        h ^= h >> np.uint64(29)
    return out


def _near_sets(prints: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of buckets that stand one after another, positions that have later ones of their bucket within the radius, and these."""
    starts = np.cumsum(sizes) - sizes
    for pick in _alike_in_size(sizes, prints.shape[1]):
        near = _near_in_small(prints, starts[pick], sizes[pick], radius)
        for p, lanes in enumerate(near):
            lanes = lanes >> np.uint64(p) & (ONES - np.uint64(1))
            for b in np.flatnonzero(lanes).tolist():
                at = int(starts[pick[b]]) + p
                yield at, at + np.flatnonzero(np.unpackbits(lanes[b : b + 1].view(np.uint8), bitorder="little"))
    for b in np.flatnonzero(sizes > 64).tolist():
        for q, found in _near_in_large(prints[starts[b] : starts[b] + sizes[b]], radius):
            yield int(starts[b]) + q, int(starts[b]) + found


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY, sizes: np.ndarray | None = None, radius: int = WIDE_RADIUS) -> np.ndarray:
    """For each set the position of the first of its component, where sets of Jaccard ``similarity`` or more are linked within a bucket of ``sizes`` (without: all are one).

    Fingerprints within ``radius`` are found bit-sliced, and those pairs are counted on the sets whose components are still two, so a large group of copies is not counted pair by pair."""
    num, den = _ratio(similarity)
    root, size = np.arange(len(sets)), np.array([len(x) for x in sets], np.int64)
    prints = np.stack([wide_fingerprint(x) for x in sets])
    for q, found in _near_sets(prints, np.array([len(sets)]) if sizes is None else sizes, radius):
        met = found[(root[found] != root[q]) & (den * size[found] >= num * size[q]) & (den * size[q] >= num * size[found])]
        for y in met.tolist():
            if root[y] == root[q]:
                continue
            few, many = sorted((sets[q], sets[y]), key=len)
            both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
            if den * both >= num * int(size[q] + size[y] - both):
                low, high = sorted((int(root[q]), int(root[y])))
                root[root == high] = low
    return root


#: Sets that are compared at once at most, but for those of one larger tile.
SETS_AT_ONCE = 4096


def _alike_in_tiles(similarity: float):
    """Rows of (tile, fp, text), sorted by tile -> for each text that is linked in its tile, the fp that stands for its component there."""

    def edges(prints: list[bytes], sets: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        root = alike(sets, similarity, np.array(sizes)) if sets else np.zeros(0, np.int64)
        linked = np.flatnonzero(root != np.arange(len(sets))).tolist()
        return pa.RecordBatch.from_arrays([pa.array([prints[i] for i in linked], pa.binary()), pa.array([prints[root[i]] for i in linked], pa.binary())], names=["u", "v"])

    def run(batches):
        now, prints, sets, sizes, held = None, [], [], [], 0
        for batch in batches:
            for tile, fp, text in zip(batch.column("tile").to_pylist(), batch.column("fp").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if tile != now:
                    if len(sets) >= SETS_AT_ONCE or held >= PART_SHINGLES:
                        yield edges(prints, sets, sizes)
                        prints, sets, sizes, held = [], [], [], 0
                    now = tile
                    sizes.append(0)
                prints.append(bytes(fp))
                sets.append(shingle_set(text.as_py() or b""))
                sizes[-1] += 1
                held += len(sets[-1])
        yield edges(prints, sets, sizes)
        pa.default_memory_pool().release_unused()

    return run


def _set_links(rows: DataFrame, text_col: str, scratch: Scratch, similarity: float, bucket_limit: int) -> DataFrame:
    """Edges between fingerprints of sets, of rows (row, fp, size, bands), that connect all that are similar and share a band.

    Sets that bands connect form a group, and each of a group's texts is read once for each tile. A group of more
    sets than ``bucket_limit`` or SPLIT_SETS, or of very many shingles, is dealt into parts, and every two parts meet in a tile of their own."""
    short = F.xxhash64("fp")  # where two sets share it, groups are only larger
    placed = rows.select(short.alias("u"), F.explode("bands").alias("key"))
    met = placed.groupBy("key").agg(F.min("u").alias("v"), F.max("u").alias("w")).filter("v < w").select("key", "v")
    groups = scratch.keep(components(placed.join(met, "key").select("u", "v"), scratch), "groups")
    # texts are many at any size that matters: a merge from the start, which sorts and spills, and not by what one run happens to find
    texts = rows.select("fp", "size", F.col("row")[text_col].cast("string").alias("text")).withColumn("vertex", short).join(groups.hint("merge"), "vertex")
    members = scratch.keep(texts.select("root", "fp", "size", "text").dropDuplicates(["fp"]), "members")
    parts = F.greatest(F.ceil(F.count("*") / bucket_limit), F.ceil(F.sum("size") / PART_SHINGLES), F.least(F.lit(SPLIT_PARTS), F.ceil(F.count("*") / SPLIT_SETS))).cast("int")
    parted = members.select("root", "fp", "text").join(members.groupBy("root").agg(parts.alias("parts")), "root")
    parted = parted.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    # two parts or more: their own tiles are left out, every other tile compares a part within itself as well
    dealt = parted.filter("own != other OR parts = 1").select(F.concat_ws(":", F.col("root"), F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "fp", "text")
    return by_hash(dealt, "tile").sortWithinPartitions("tile", "fp").mapInArrow(_alike_in_tiles(similarity), "u binary, v binary")


def _named(prints: DataFrame, scratch: Scratch, link) -> DataFrame:
    """fp and the first row of its component: ``first`` holds whether it has no id, its id and its fp. Of rows (id, fp); ``link`` gives the edges between distinct fingerprints."""
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("fp"))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    rooted = components(link(distinct), scratch)
    labelled = distinct.join(rooted.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # written, so that the join stands on two plain shuffles and a root of very many fingerprints can be split
    least = scratch.keep(labelled.groupBy("root").agg(F.min("first").alias("least")), "least")
    return scratch.keep(labelled.join(least, "root").select("fp", F.col("least").alias("first")), "named")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row for each row of ``df``: id, fingerprint (16 lowercase hex digits), component_id.

    Rows are linked if their fingerprints differ in at most two bits; component_id is the smallest id that
    links lead to, a row's own included, and null only if the whole component has null ids. Null and empty
    texts, and those of white space, have fingerprint zero and are linked like any other. Repeated rows each have
    a row. An empty table gives no rows. Texts of any length are read whole. Other columns are not read. ``id_col`` holds integers."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = scratch.keep(docs.mapInArrow(_fingerprints(shingle), "id long, fp long"), "prints")
    named = _named(prints, scratch, lambda distinct: links(distinct, scratch, bucket_limit=bucket_limit))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def _with_sets(id_at: str, text_at: str, tables: int):
    def run(batches):
        for batch in (whole.slice(lo, 1024) for whole in batches for lo in range(0, whole.num_rows, 1024)):  # small ones are small in the JVM too
            row = batch.column("row")
            texts = row.field(text_at).cast(pa.string()).cast(pa.binary())
            prints, sizes, bands = [], [], []
            for x in texts:
                hashes = shingle_set(x.as_py() or b"")
                prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes, tables))
            yield pa.RecordBatch.from_arrays([row, row.field(id_at).cast(pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["row", "id", "fp", "size", "bands"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tables: int = TABLES_OF_BANDS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each group of near copies that of the smallest id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more, counted
    on the sets. Those are compared that ``tables`` bands of MinHash values connect: two at the similarity s that
    nothing else connects are missed with a chance of (1 - s^7)^tables, at any number of rows.
    Null and empty texts are alike. Null ids come last, and of them the smallest fingerprint stays. Rows that share
    both id and fingerprint with the one that stays are the same document twice and stay with it."""
    scratch = Scratch(df.sparkSession, "representatives")
    packed = df.select(F.struct("*").alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("id", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = scratch.keep(packed.mapInArrow(_with_sets(id_col, text_col, tables), schema), "rows")
    named = _named(rows.select("id", "fp"), scratch, lambda distinct: _set_links(rows, text_col, scratch, similarity, bucket_limit))
    stay = named.filter(F.col("fp") == F.col("first.fp")).select(F.col("first.id").alias("stay_id"), F.col("fp").alias("stay_fp"))
    return rows.join(stay.hint("merge"), (F.col("fp") == F.col("stay_fp")) & F.col("id").eqNullSafe(F.col("stay_id")), "left_semi").select("row.*")
