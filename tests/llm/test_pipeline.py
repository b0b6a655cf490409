import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import __spark_entry__
from quarry.llm import quality
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_dedup import norm, plain_shingles
from tests.llm.test_scans import all_spans

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def masked(text):
    out, at = "", 0
    for start, _, _, end in all_spans(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def plain_pipeline(rows, model):
    """The first four stages by loops over rows (doc_id, text): what each keeps."""
    rows = [r for r in rows if model.score(np.array([quality.features((r[1] or "").encode())]))[0] >= 0.7]
    yield rows
    best = {}
    for i, t in rows:
        key = norm(t)
        if key not in best or (-len(t or ""), i) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = (i, t)
    rows = sorted(best.values())
    yield rows
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    yield rows
    yield [(i, None if t is None else masked(t)) for i, t in rows]


def test_stages_against_loops(spark):
    rng = random.Random(21)
    base = [words(rng, rng.randint(8, 80)) for _ in range(60)]
    texts = base + [t + " " for t in base[:20]] + [t.replace(" ", "  ", 1) for t in base[:10]] + [" ".join(t.split()[:-1] + ["other"]) for t in base[20:50]] + [t + " password=abcdefghijklmnop" for t in base[50:]] + [None, "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_pipeline(list(enumerate(texts)), model), strict=False):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == SCHEMA.names, name
        assert sorted((r.doc_id, str(r.text)) for r in docs.collect()) == sorted((i, str(t)) for i, t in want), name
        assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = {(r.doc_id, zlib.crc32(np.array([*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in docs.collect()}
    assert {(p.doc_id, p.ids_crc32) for p in pieces} == want and len(pieces) == len(want) > 20


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)], [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], [(7, "x " * 60_000)]])
def test_stages_take_odd_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None, "clash", "clash", 1) for i, t in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() <= max(len(rows), 40), name


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] <= counts[5]
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
