import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as hs
from tokenizers import Tokenizer

from quarry.llm import packing, pieces, range_coder, token_files, token_ids
from quarry.llm.range_coder import decode, encode
from quarry.llm.token_ids import TokenIds
from tests.llm.conftest import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = TokenIds(open(PATH, encoding="utf-8").read(), cache=500)
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)
MACHINE = pieces.Machine(pieces.Definition.parse(open(MODEL, "rb").read()), cache=2000)
ODD = "aAbBeEtTzZéÉßIıİſΣσς̱̈Hh<>|endoftx 1²½٣_'’\"!,.\n\t\x0b\x1c\x85\xa0漢字한글ȀʰJ̌▁"


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(hs.text(hs.one_of(hs.sampled_from(ODD), hs.characters(blacklist_categories=["Cs"])), max_size=40))
def test_token_ids_are_the_librarys(text):
    assert OWN(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|>, B", "X<|startofTEXT|>y <|endoftext|> z", "É<|Endoftext|>", "<|ENDOFTEXT|> 漢字"])
def test_added_tokens_match_their_own_case_alone(text):
    assert OWN(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = TokenIds(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not own.by_chunk
    for text in ("Hello  world, it's", " a\n b", ""):
        assert own(text) == library.encode(text, add_special_tokens=False).ids


def test_packing_places_every_id_once(docs):
    got = packing.pack(docs, PATH, capacity=64).toPandas()
    want = []
    for i, t in documents():
        ids = ids_of(t)
        want += [(str(i), p, lo, len(own := ids[lo : lo + 64]), zlib.crc32(np.array(own, "<u4").tobytes())) for p, lo in enumerate(range(0, len(ids), 64))]
    ids = [None if x != x else int(x) for x in got.doc_id.tolist()]
    assert sorted(zip(map(str, ids), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 64
    total = got.length.sum()
    assert got.sequence_id.nunique() <= -(-total // 64) + 2


def best_possible(lengths, capacity):
    """Fewest sequences, by trying all."""
    lengths = sorted(lengths, reverse=True)

    def fits(bins, rest):
        if not rest:
            return True
        seen = set()
        for i, b in enumerate(bins):
            if b + rest[0] <= capacity and b not in seen:
                seen.add(b)
                if fits([*bins[:i], b + rest[0], *bins[i + 1 :]], rest[1:]):
                    return True
        return False

    return next(n for n in range(len(lengths) + 1) if fits([0] * n, lengths))


def test_plan_is_whole_and_close_to_the_best():
    rng, over = random.Random(3), 0
    for _ in range(150):
        capacity = rng.choice([7, 12, 20])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan(counts, capacity)
        keys, first, sequence, offset = plan.arrays() if lengths else ([],) * 4
        filled = {}
        for n, c in counts.items():
            for rank in range(c):
                at = np.searchsorted(keys, (n << 44) | rank, side="right") - 1
                filled.setdefault(int(sequence[at] + rank - first[at]), []).append((int(offset[at]), n))
        for s in filled.values():
            s.sort()
            assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= capacity
        assert len(filled) == plan.sequences
        over += plan.sequences - best_possible(lengths, capacity)
    assert over <= 8


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, top, n) for top in (1, 2, 20, 49408, 65536) for n in (0, 1, 7, 300)]
    blocks.append(np.tile(np.arange(50), 30))
    coded = encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode(coded, [len(b) for b in blocks]), strict=True))
    assert (decode([coded[-1]], [1500])[0] == blocks[-1]).all()  # alone as among others
    assert len(coded[-1]) < 1500 / 4


def test_crc32_joined():
    for _ in range(100):
        a, b = os.urandom(random.randint(0, 30)), os.urandom(random.randint(0, 3000))
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_files(docs, path, PATH)
    index = token_files.read_index(spark, path).toPandas().sort_values("start")
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert index.start.tolist() == [0, *index.n_tokens.cumsum()[:-1]]
    got = [(None if i != i else int(i), n, c) for i, n, c in zip(index.doc_id, index.n_tokens, index.ids_crc32, strict=True)]
    want = [(i, len(ids := ids_of(t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows]
    assert [g[0] for g in got] == [w[0] for w in want] and sorted(map(str, got)) == sorted(map(str, want))
    whole = {r.doc_id: r.ids for r in token_files.read_ids(spark, path).collect()}
    assert whole[304] == ids_of(dict(documents())[304]) and whole[301] == [1]
    token_files.write_files(empty, str(tmp_path / "none"), PATH)
    assert token_files.read_index(spark, str(tmp_path / "none")).count() == 0


def test_a_damaged_block_is_refused():
    ids = np.arange(10)
    block = bytearray(token_files.pack_block(ids, encode([ids])[0], 0, np.array([(0, 5, 1, 0, 10)], token_files.SEGMENT)))
    assert token_files.open_block(bytes(block))[0] == 10
    block[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.open_block(bytes(block))


@settings(max_examples=300, deadline=None)
@given(hs.text(hs.one_of(hs.sampled_from(ODD + "   thernin"), hs.characters(blacklist_categories=["Cs"], blacklist_characters="\0")), max_size=30))
def test_pieces_are_the_librarys(text):
    ids = MACHINE.encode(text).tolist()
    assert ids == PIECES.encode(text) and MACHINE.decode(ids) == PIECES.decode(ids)


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.integers(0, 31999), max_size=12))
def test_decoding_any_ids(ids):
    assert MACHINE.decode(ids) == PIECES.decode(ids)


def test_tropical_shortest_path_of_a_unigram_model():
    rng = random.Random(4)
    own = [(p, -rng.random() * 5, pieces.NORMAL) for p in ("▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb")]
    machine = pieces.Machine(pieces.Definition([("<unk>", 0.0, pieces.UNKNOWN), *own], pieces.UNIGRAM, False))
    cost = {p: -s for p, s, _ in own}

    def least(text):
        return 0 if not text else min((cost.get(text[:n], machine.worst if n == 1 else float("inf")) + least(text[n:]) for n in range(1, min(3, len(text)) + 1)), default=float("inf"))

    for _ in range(200):
        text = "▁" + "".join(rng.choice("abx") for _ in range(rng.randint(0, 8)))
        path = machine.path(text)
        assert "".join(path) == text and sum(cost.get(p, machine.worst) for p in path) == pytest.approx(least(text))


def test_encode_and_decode_frames(docs, empty):
    out = pieces.decode(pieces.encode(docs.select("doc_id", "text", "row"), MODEL), MODEL).collect()
    assert len(out) == len(documents())
    for r in out:
        assert r.ids == (None if r.text is None else PIECES.encode(r.text)) and r.decoded == r.text and r.row == "clash"
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0


def test_summaries_are_the_librarys(spark, docs, empty):
    rows = documents()
    got = sorted((str(r.doc_id), r.n_ids, r.ids_crc32, r.round_trip) for r in pieces.summaries(docs, MODEL).collect())
    want = []
    for i, t in rows:
        ids = PIECES.encode(t or "")
        want.append((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), PIECES.decode(ids) == (t or "")))
    assert got == sorted(want) and pieces.summaries(empty, MODEL).count() == 0


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, PATH).count() == 0


def test_many_texts_at_once_are_the_librarys():
    """Parts of several texts, those that go apart among them, nulls and a text larger than a part."""
    rng = random.Random(4)
    letters = "abcdeäéABC ,.!'<\n1²漢"
    texts = [None, "", "<|EndOfText|> x", "x " * 50_000 + "é,"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    kept = token_ids.PART_BYTES
    token_ids.PART_BYTES = 2000
    try:
        ids, counts = zip(*OWN.many(pa.array(texts), 1), strict=True)
    finally:
        token_ids.PART_BYTES = kept
    want = [ids_of(t) for t in texts]
    assert np.concatenate(counts).tolist() == list(map(len, want)) and np.concatenate(ids).tolist() == [i for w in want for i in w]


def test_coded_ids_take_few_bits():
    """About the entropy of the ids, and 16 bits for each that is new in its block; what repeats costs next to nothing."""
    rng = np.random.default_rng(3)
    bits = lambda blocks: sum(map(len, encode(blocks))) * 8 / sum(map(len, blocks))
    for blocks in ([np.minimum(rng.zipf(1.3, 2048), 49407) for _ in range(8)], [rng.integers(0, 200, 2048) for _ in range(8)]):
        counts = np.bincount(np.concatenate(blocks))
        share = counts[counts > 0] / counts.sum()
        new = np.mean([len(np.unique(b)) for b in blocks]) / 2048
        assert bits(blocks) < -(share * np.log2(share)).sum() + 16 * new + 0.7
    assert bits([np.tile(rng.integers(0, 50000, 64), 32) for _ in range(8)]) < 1.5


def test_what_followed_is_told_as_slot_by_slot():
    """Looked up for whole blocks at once, the slots hold what a walk over the ids leaves in them."""
    rng = np.random.default_rng(5)
    ids, slots = rng.integers(0, 4, (5, 400), np.uint16), rng.integers(0, 9, (5, 400), np.uint16)
    ids[0], slots[1] = 0, 7
    guess, sure = range_coder._followed(ids, slots)
    for block in range(5):
        held = {}
        for t, (i, slot) in enumerate(zip(ids[block].tolist(), slots[block].tolist(), strict=True)):
            last, often = held.get(slot, (0, 0))
            assert (guess[block, t], sure[block, t]) == (last, often)
            held[slot] = (i, min(often + 1, 3) if i == last else 0)


def test_words_of_the_table_keep_their_ids():
    """Over the limit some words go and are made again; a word that is known is not."""
    made = []
    table = token_ids._Table(lambda word: made.append(word) or [ord(c) for c in word], np.dtype("<u2"), 6)
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(0, 5))})
        ids, starts, lengths = table.all(pa.array(words, pa.string()))
        assert ["".join(map(chr, ids[s : s + n])) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)] == words
        before = len(made)
        table.all(pa.array(words[:1], pa.string()))
        assert len(made) == before and len(table.words) <= 6 + 5
