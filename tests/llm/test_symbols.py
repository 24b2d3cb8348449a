"""Recompression: equal windows share the symbol that stands for them, and repeats are found through symbols and settled on words."""

import random

import numpy as np
import pyarrow as pa

from velotrace.llm import op6_repeats as R
from velotrace.llm.common import U, chunks, spans, word_hashes


def placed(texts):
    _, data, offs = next(chunks(pa.array(texts), 1 << 40))
    starts, ends, wfirst = spans(data, offs)
    doc, at, key, _ = R.places(word_hashes(data, starts, ends), wfirst)
    return doc, at - wfirst[doc], key


def test_equal_windows_have_one_symbol():
    rng = random.Random(1)
    for size in (3, 30, 3000):
        words = lambda n: [f"w{rng.randrange(size)}" for _ in range(n)]  # noqa: E731, B023
        same = [words(25) for _ in range(40)]
        texts = [words(rng.randrange(9)) + p + words(rng.randrange(9)) for p in same * 3]
        doc, at, key = placed([" ".join(t) for t in texts])
        seen = {}
        for d, a, k in zip(doc.tolist(), at.tolist(), key.tolist()):
            assert seen.setdefault(tuple(texts[d][a : a + 20]), k) == k


def test_names_stand_for_words():
    rng = random.Random(2)
    words = [f"w{rng.randrange(40)}" for _ in range(3000)]
    _, data, offs = next(chunks(pa.array([" ".join(words)])))
    starts, ends, wfirst = spans(data, offs)
    lo, hi, size, name = R.symbols(word_hashes(data, starts, ends), wfirst)
    assert set(size.tolist()) >= {1, 2, 3, 4}
    assert ((hi - lo) >= size + 2).all()
    text = {}
    for low, high, n, x in zip(lo.tolist(), hi.tolist(), size.tolist(), name.tolist()):
        hold = {tuple(words[k : k + n]) for k in range(low + 1, high - n)}
        text[x] = text[x] & hold if x in text else hold
    assert all(text.values())


def test_without_symbols_no_repeats(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    docs = spark.createDataFrame([(i, " ".join(f"x{i}.{k}" for k in range(30 + i)) + " " + passage) for i in range(2)], "doc_id long, text string").repartition(2)
    assert [r.n_removed for r in R.remove_repeats(docs).orderBy("doc_id").collect()] == [0, 60]
    h = np.arange(100).astype(U)
    monkeypatch.setattr(R, "symbols", lambda h, w: (np.arange(len(h)) - 1, np.arange(len(h)) + 2, np.ones(len(h), int), np.arange(len(h)).astype(U) << U(20)))
    assert len(set(R.places(h, np.array([0, 50, 100]))[2].tolist())) > 31


def test_same_hash_other_words(monkeypatch):
    monkeypatch.setattr(R, "gram_hashes", lambda h, k, seed=0: np.zeros(max(len(h) - k + 1, 0), U))
    rows = [(7, d, 0, 3, " ".join([str(w)] + [f"a{k}" for k in range(21)]).encode() + b" ") for d, w in ((1, "x"), (2, "y"), (3, "x"))] + [(9, 4, 5, 2, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key", "doc", "start", "n", "words"])
    # every window hashes alike: only words decide; the first of all is compared
    got = {(d, s, n) for b in R._settle([batch.slice(k, 1) for k in range(4)]) for d, s, n in zip(*(c.to_pylist() for c in b.columns))}
    assert (4, 5, 2) in got and (3, 0, 1) in got and not any(d == 2 and s == 0 for d, s, _ in got)
