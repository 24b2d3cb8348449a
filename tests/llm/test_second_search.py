"""Near-dedup moves and searches only what can still make a link, and finds the same links."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from velotrace.llm import op1_neardup


def random_texts(n, words=60):
    rng = np.random.default_rng(13)
    return [" ".join(f"w{x}" for x in rng.integers(0, 10**6, words)) for _ in range(n)]


def test_texts_without_candidates_are_not_moved(spark, monkeypatch):
    texts = random_texts(400)
    near = [t + " tail" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    moved, real = [], op1_neardup.packed
    monkeypatch.setattr(op1_neardup, "packed", lambda df, col: moved.append(df.count()) or real(df, col))
    out, _ = op1_neardup.near_duplicates(docs)
    assert {r.doc_id: r.class_id for r in out.collect()} == {k: k if k < 400 else k - 400 for k in range(405)}
    assert sum(moved) <= 20


def test_among_keeps_all_that_are_needed(spark, monkeypatch):
    text = spark.range(-3000, 3000).select("id", F.col("id").cast("string").alias("text"))
    need = spark.range(-3000, 3000, 7).select("id")
    for marks in (1 << 25, 1 << 15):
        monkeypatch.setattr(op1_neardup, "MARKS", marks)
        got = {r.id for r in op1_neardup._among(text, need).collect()}
        assert set(range(-3000, 3000, 7)) <= got and len(got) < 2000
    assert op1_neardup._among(text, need.limit(0)).count() == 0


def test_second_search_leaves_out_hashes_of_one_class(spark, monkeypatch):
    # four minimum hashes: 7 has one class, 8 a large class and two other nodes, 9 two classes of which only the larger asks, 10 two classes where none asks
    low = {i: 7 + (i - 1) // 40 for i in range(1, 161)}
    cls = {i: 1 if i < 41 else 41 if i < 79 else i if i < 81 else 81 if i < 110 else 110 if i < 121 else 121 + i % 2 for i in low}
    rows = [(i, 50, 0, i, low[i], bytearray(128)) for i in low]
    nodes = spark.createDataFrame(rows, "id long, n long, sim_a long, sim_b long, x long, odd binary").withColumn("low", F.array("x")).drop("x")
    classes = spark.createDataFrame([(i, c) for i, c in cls.items() if i != c], "id long, component long")
    ask = spark.createDataFrame([(i,) for i in low if i < 110], "id long")
    want = {(a, b) for a, b in itertools.combinations(range(41, 121), 2) if low[a] == low[b] and cls[a] != cls[b]}
    for cap in (op1_neardup.CAP, 4):  # in one block, and in many, between which one side alone queries
        monkeypatch.setattr(op1_neardup, "CAP", cap)
        found = op1_neardup.candidates(nodes, classes, None, ask)
        assert {r.low for r in found.rows.select("low").distinct().collect()} == {8, 9}
        got = {(r.a, r.b) for r in found.filter("a != b").collect()}
        assert got <= want and (got == want if cap > 4 else {p for p in want if p[0] < 110 and p[1] < 110} <= got)


def test_ones_of_long_runs():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64) | np.uint64(1)
    begin = np.array([0, 1, 255, 256, 766, 1021])
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
    assert (op1_neardup._ones(x, begin) == np.add.reduceat(bits, begin, axis=0, dtype=np.int64)).all()
