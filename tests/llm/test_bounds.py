"""Bounds on what is held at once, and brute-force forms of language features and decoding; long template lists."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velotrace.llm import common, op9_language, op10_license


def test_training_rows_are_bounded(spark, monkeypatch):
    rows = [(5, f"text number {k % 40} of one id", "en") for k in range(3000)] + [(None, f"ohne nummer {k}", "de") for k in range(30)] + [(k, f"mot {k}", "fr") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = op9_language.fit
    monkeypatch.setattr(op9_language, "fit", lambda x, y, langs, **k: seen.append((x.shape, np.bincount(y).tolist(), langs)) or real(x, y, langs, **k))
    one = op9_language.train(docs, F.lit(True), per_lang=10)
    assert seen[0] == ((30, op9_language.DIM), [10, 10, 10], ["de", "en", "fr"])
    two = op9_language.train(docs.repartition(7), F.lit(True), per_lang=10)
    assert np.array_equal(one["w"], two["w"])
    op9_language.train(docs, F.lit(True), per_lang=100)
    assert seen[2][1] == [30, 40, 20]  # equal rows count once


def test_features_and_decoding_by_brute_force():
    texts = ["Hello, World", "", "Été À la 12 3", "x", "naïve cafés 日本"] * 60
    got = np.concatenate([x for _, x in op9_language.feature_slices(pa.array(texts))])
    assert max(len(x) for _, x in op9_language.feature_slices(pa.array(texts))) <= op9_language.SLICE and len(got) == len(texts)
    for text, row in list(zip(texts, got))[:5]:
        b, last = [], 0
        for c in text.encode():
            low = c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else c if c >= 128 else 32
            b.append(low + 32 if last == 0xC3 and 0x80 <= c <= 0x9E else low)
            last = c
        counts = [0.0] * op9_language.DIM
        for k in (2, 3):
            for i in range(len(b) - k + 1):
                code = 0
                for x in b[i : i + k]:
                    code = code << 8 | x
                counts[((code + k * 77777777) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        want = [math.sqrt(c) for c in counts]
        norm = math.sqrt(sum(counts)) or 1.0
        assert np.allclose(row, [w / norm for w in want], atol=1e-6)
    rng = np.random.default_rng(4)
    for n in (2, 4, 7):
        code = op9_language.codewords(n)
        bit = rng.random(code.shape[1])
        model = {"bit": bit / bit.sum(), "code": code}
        margins = rng.normal(size=(50, code.shape[1])) * 3
        margins[0] = 0  # a tie: the first language
        best, score, unsure = op9_language.decode(margins, model)
        for z, k, s, u in zip(margins, best, score, unsure):
            loss = [sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(model["bit"], word, z)) for word in code]
            assert k == min(range(n), key=lambda i: (round(loss[i], 9), i))
            want = 1 / sum(math.exp(-4 * (x - loss[k])) for x in loss)
            assert abs(s - want) < 1e-7 and u == (want < op9_language.AMBIGUOUS)


def test_fit_by_plain_steps():
    rng = np.random.default_rng(5)
    y = np.array([0] * 30 + [1] * 20 + [2] * 10)
    x = np.abs(rng.normal(size=(60, 12))).astype(np.float32) + np.eye(3, 12)[y].astype(np.float32) * 3
    got = op9_language.fit(x, y, ["a", "b", "c"], rounds=5, rate=0.5)
    code = op9_language.codewords(3)
    w = [[0.0] * code.shape[1] for _ in range(13)]
    v = [[0.0] * code.shape[1] for _ in range(13)]
    x1 = [[*map(float, r), 1.0] for r in x]
    for _ in range(5):
        grad = [[1e-5 * w[i][b] for b in range(code.shape[1])] for i in range(13)]
        for r, k in zip(x1, y.tolist()):
            for b in range(code.shape[1]):
                z = sum(p * w[i][b] for i, p in enumerate(r)) * code[k][b]
                pull = code[k][b] / (3 * [30, 20, 10][k]) / (1 + math.exp(z))
                for i, p in enumerate(r):
                    grad[i][b] -= p * pull
        for i in range(13):
            for b in range(code.shape[1]):
                v[i][b] = 0.9 * v[i][b] - 0.5 * grad[i][b]
                w[i][b] += v[i][b]
    assert np.allclose(got["w"], w, atol=1e-4)


def test_long_template_lists_take_several_scans(spark, monkeypatch):
    rng = random.Random(6)
    templates = {f"t{k}": " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for k in range(5)}
    rows = [(k, f"before it {t} and after it") for k, t in enumerate(templates.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(k, f"t{k}") for k in range(5)}
    assert {(r.doc_id, r.license) for r in op10_license.scan(docs, templates).collect()} == want
    monkeypatch.setattr(op10_license, "MAX_SHINGLES", 250)
    assert {(r.doc_id, r.license) for r in op10_license.scan(docs, templates).collect()} == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 1, 2, [3])], "doc_id long, text string, grams int, one int, known array<int>")
    assert [tuple(r)[:2] for r in op10_license.scan(docs).collect()] == [(1, "MIT")]


def test_shared_folder_is_named_or_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Session:
        conf, sparkContext = Conf(), Context()

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        Context.master = master
        with pytest.raises(ValueError):
            common.shared_dir(Session())
    Context.master = "local[2]"
    assert common.shared_dir(Session()) == common.shared_dir(Session())
