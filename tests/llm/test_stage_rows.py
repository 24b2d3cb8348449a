"""Whole rows of the pipeline's stages against plain Python: near-dedup, substring dedup and encoding."""

import random

import pytest
import sentencepiece

import corpus_pipeline as cp
from velotrace.llm import op4_pieces

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base, passage = words(150), words(40)
    near = [*base[:70], "changed", *base[71:]]
    texts = [base, words(80) + passage, base, near, words(30) + passage + words(30), [f"q{k % 2}" for k in range(24)], [f"r{k % 7}" for k in range(29)], words(60), words(19)]
    return [(k, " ".join(t), "en", "ab"[k % 2], len(" ".join(t))) for k, t in enumerate(texts, 5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def plain(df):
    assert df.columns == COLS
    return sorted(map(tuple, df.collect()))


def test_near_dedup_rows(spark, rows):
    sets = {r[0]: set(zip(*[r[1].split()[k:] for k in range(5)])) for r in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    want = [r for r in rows if least[r[0]] == r[0]]
    assert len(want) == len(rows) - 2
    assert plain(cp.near_dedup(spark, frame(spark, rows), "")) == want


def test_substring_dedup_rows(spark, rows):
    first, want = {}, []
    for i, text, *_ in rows:
        w = text.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, text, lang, source, _ in rows:
        w = text.split()
        gone = {k + j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for j in range(20)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, text, lang, source, len(text)))
    assert sum(a != b for a, b in zip(rows, want)) == 5
    assert plain(cp.substring_dedup(spark, frame(spark, rows), "")) == want


def test_encoding_rows(spark, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=op4_pieces.model_path())
    got = cp.encoding(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = [(r[0], lib.encode(r[1], add_eos=True)) for r in rows]
    assert sorted((r.doc_id, r.ids, r.decoded) for r in got.collect()) == [(i, ids, lib.decode(ids)) for i, ids in want]
