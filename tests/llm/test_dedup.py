import hashlib
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.common import Scratch
from quarry.llm.components import components
from quarry.llm.exact_dedup import deduplicated, exact_groups
from tests.llm.conftest import documents


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups_against_brute_force(docs):
    groups = {}
    for i, t in documents():
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    got = exact_groups(docs).collect()
    assert len(got) == len(documents())
    want = sorted((str(i), str(min(groups[norm(t)])[3]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in documents())
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept is False or r.doc_id == r.keep_id for r in got)


def test_exact_groups_spread_over_partitions(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('t', id % 500) END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_groups(df.repartition(5)).toPandas()
        kept = deduplicated(df.repartition(5)).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same = got[got.doc_id % 3 == 0]
    assert (same.group_size == len(same)).all() and (same.keep_id == 0).all() and same.kept.sum() == 1
    assert got.kept.sum() == 501 and sorted(kept.doc_id) == sorted(got[got.kept].doc_id)


def test_deduplicated_keeps_every_column_once(docs):
    got = deduplicated(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len({norm(r.text) for r in rows}) == len(rows) == len({norm(t) for _, t in documents()})


def test_empty(empty):
    assert exact_groups(empty).count() == 0 and deduplicated(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_roots(prints, radius=2):
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= radius if prints.ndim == 2 else np.bitwise_count(prints[:, None] ^ prints[None]) <= radius
    root = np.arange(len(prints))
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 3])
def test_simhash_against_brute_force(docs, limit):
    rows = documents()
    prints = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    root = brute_roots(prints)
    least = {r: min((i for (i, _), x in zip(rows, root, strict=True) if x == r and i is not None), default=None) for r in set(root.tolist())}
    want = sorted((str(i), f"{int(p):016x}", str(least[int(r)])) for (i, _), p, r in zip(rows, prints, root, strict=True))
    got = simhash.near_duplicates(docs, bucket_limit=limit).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("width", [1, 4])
def test_bit_sliced_roots(width):
    rng = np.random.default_rng(1)
    for n in (2, 5, 20, 64, 65, 300):
        for flips in (1, 2, 4):
            p = rng.integers(0, 2**63, (max(1, n // 9), width), dtype=np.uint64)[rng.integers(0, max(1, n // 9), n)]
            for _ in range(flips):
                p[:, 0] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
            p = np.unique(p, axis=0)
            want = brute_roots(p)
            assert (simhash._large(p, 2) == want).all()
            if len(p) <= 64:
                assert (simhash._small(p, np.array([0]), np.array([len(p)]), 2) == want).all()


def chains(n, rng, width=1):
    """n chains of four, neighbours two bits apart and chains far from each other, so that ends sort before what links them."""
    out = []
    for head in rng.integers(0, 2**63, (n, width), dtype=np.uint64):
        bits = rng.permutation(64)[:6].reshape(3, 2)
        for k in range(4):
            fp = head.copy()
            for b in bits[:k].ravel():
                fp[0] ^= np.uint64(1 << int(b))
            out.append(fp)
    return np.array(sorted(map(tuple, out)), np.uint64)


@pytest.mark.parametrize("width", [1, 4, 8])
@pytest.mark.parametrize("n", [40, 100, 300])
def test_chains_in_one_bucket_stay_whole(n, width):
    p = chains(n, np.random.default_rng(n), width)
    want = brute_roots(p)
    assert len(set(want.tolist())) == n and (simhash._large(p, 2) == want).all()


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 50])
def test_links_of_hot_buckets_are_whole(spark, limit):
    """Chains of which all share two quarters, so that one bucket holds them; above the limit it is dealt again by bytes."""
    rng = np.random.default_rng(8)
    low = np.unique(chains(100, rng).ravel() & np.uint64(0xFFFF_FFFF))
    prints = low | np.uint64(0x8123_4567 << 32)
    want = brute_roots(prints)
    distinct = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    scratch = Scratch(spark, "test")
    rooted = {r.vertex: r.root for r in components(simhash.links(distinct, scratch, bucket_limit=limit), scratch).collect()}
    fps = prints.view(np.int64).tolist()
    groups = {}
    for fp, root in zip(fps, want.tolist(), strict=True):
        groups.setdefault(root, []).append(fp)
    assert all(len({rooted.get(fp, fp) for fp in members}) == 1 for members in groups.values())
    assert len({rooted.get(fp, fp) for fp in fps}) == len(groups)


def test_representatives_take_near_copies_and_leave_the_rest(spark):
    rng = np.random.default_rng(2)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts, of = [], []
    for g in range(60):
        own = rng.choice(vocabulary, 200)
        for c in range(1 + g % 4):
            copy = own.copy()
            if c:
                copy[rng.integers(0, 200, 2)] = "changed"  # similarity of about 0.9
            texts.append(" ".join(copy))
            of.append(g)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    kept = sorted(r.doc_id for r in simhash.representatives(df).select("doc_id").collect())
    firsts = [of.index(g) for g in range(60)]
    assert set(firsts) <= set(kept)
    assert len(kept) - 60 <= 0.03 * (len(texts) - 60)
    tiled = sorted(r.doc_id for r in simhash.representatives(df, bucket_limit=2).select("doc_id").collect())
    assert tiled == kept


def test_representatives_with_odd_rows(docs):
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()


def pairs_of(shared_by, rng):
    """Two texts for each (shingles of each, shingles of each that the other lacks)."""
    texts = []
    for n, own in shared_by:
        w = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        texts += [" ".join(w), " ".join(w[: n + 4 - own] + [f"v{x}" for x in rng.integers(0, 10**9, own)])]
    return texts


def plain_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_candidates_meet_at_the_same_rate_at_every_size():
    rng = np.random.default_rng(3)
    for n, own in ((9, 1), (90, 10), (900, 100)):  # exactly 0.8
        met = []
        for _ in range(150):
            x = rng.integers(0, 2**64, n + own, dtype=np.uint64)
            a, b = simhash.band_keys(np.sort(x[:n])), simhash.band_keys(np.sort(np.delete(x, slice(0, own))))
            met.append(int((a == b).sum()))
        # a band holds with 0.8^7: all 150 pairs meet in some of 48, and the rate is the one that the docstring's law takes
        assert min(met) >= 1 and abs(np.mean(met) / simhash.TABLES_OF_BANDS - 0.8**simhash.BAND) < 0.02


def test_all_pairs_at_the_threshold_are_found(spark):
    texts = pairs_of([(90, 10)] * 200 + [(9, 1)] * 100, np.random.default_rng(4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df).select("doc_id").collect()) == list(range(0, len(texts), 2))


def test_pairs_below_the_threshold_stay(spark):
    below = [(90, 11)] * 100 + [(6, 1)] * 100 + [(8, 1)] * 100 + [(90, 14)] * 50  # 0.782, 0.714, 0.778, 0.731
    texts = pairs_of(below, np.random.default_rng(5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.representatives(df).count() == len(texts)


def test_alike_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sets = []
        for _ in range(rng.integers(1, 6)):
            base = rng.integers(0, 200, rng.integers(1, 60)).astype(np.uint64)
            for _ in range(rng.integers(1, 12)):
                copy = base.copy()
                copy[rng.integers(0, len(copy), len(copy) // int(rng.integers(3, 15)))] = rng.integers(0, 400)
                sets.append(np.unique(copy))
        sets = [s * np.uint64(0x9E37_79B9_7F4A_7C15) for s in sets]  # hashes, as the sets hold them
        sets = [np.sort(s) for s in sets]
        near = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
        root = np.arange(len(sets))
        while (new := np.array([root[row].min() for row in near])).tolist() != root.tolist():
            root = new
        assert simhash.alike(sets).tolist() == root.tolist()
        twice = simhash.alike(sets + sets, sizes=np.array([len(sets)] * 2)).tolist()
        assert twice == [*root.tolist(), *(root + len(sets)).tolist()]


def test_a_large_bucket_of_sets_against_brute_force():
    rng = np.random.default_rng(9)
    sets = []
    for n in (30, 100, 400):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for _ in range(60):
            copy = base.copy()
            copy[rng.integers(0, n, int(rng.integers(0, n // 6)))] = rng.integers(0, 2**64, dtype=np.uint64)
            sets.append(np.unique(copy))
    near = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    root = np.arange(len(sets))
    while (new := np.array([root[row].min() for row in near])).tolist() != root.tolist():
        root = new
    assert simhash.alike(sets).tolist() == root.tolist()
