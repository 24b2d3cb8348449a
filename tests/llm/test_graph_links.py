"""The graph's own links, and that its beam reaches all points within the radius."""

import numpy as np
import pyarrow as pa

from velotrace.llm import op1_neardup
from velotrace.llm.graphs import SmallWorld


def near_points(n):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (1, 2), dtype=np.uint64)
    return np.repeat(base, n, 0) ^ (np.uint64(1) << rng.integers(0, 63, (n, 2), dtype=np.uint64))


def test_beam_widens_to_all_points():
    points = near_points(200)
    q, _, _ = SmallWorld(points).within(points, 40)
    assert len(q) >= 0.9 * 200 * 200


def test_graph_makes_links(monkeypatch):
    n, points = 30, near_points(30)
    t = pa.table({"id": np.arange(n), "n": np.full(n, 9), "low": np.zeros(n, int), "cls": np.arange(n), "role": np.full(n, 2), "ask": np.ones(n, bool), "sim_a": points[:, 0].view(np.int64), "sim_b": points[:, 1].view(np.int64)})
    links = lambda: {(a, b) for a, b in zip(*op1_neardup._search(None)(t).select(["a", "b"]).to_pydict().values()) if a != b}
    whole = links()
    assert whole == {(a, b) for b in range(n) for a in range(b)}
    monkeypatch.setattr(op1_neardup, "exact_within", lambda *_: (np.zeros(0, int),) * 3)
    assert len(links()) >= 0.9 * len(whole)


def test_without_the_graph_no_links(monkeypatch):
    n, points = 30, near_points(30)
    t = pa.table({"id": np.arange(n), "n": np.full(n, 9), "low": np.zeros(n, int), "cls": np.arange(n), "role": np.full(n, 2), "ask": np.ones(n, bool), "sim_a": points[:, 0].view(np.int64), "sim_b": points[:, 1].view(np.int64)})
    row = op1_neardup._search(None)(t).to_pydict()
    assert row["truth"][-1] == 29 and row["found"][-1] >= 0.9 * 29  # id 0 is audited against the others
    monkeypatch.setattr(SmallWorld, "within", lambda *_: (np.zeros(0, int),) * 3)
    row = op1_neardup._search(None)(t).to_pydict()
    assert row["a"] == [0] and (row["truth"], row["found"]) == ([29], [0])


def test_two_texts_of_one_document(spark):
    words = lambda s: " ".join(f"{s}{k}" for k in range(40))
    rows = [(1, words("a")), (2, words("b")), (2, words("a")), (3, words("b"))]
    for order in (rows, rows[::-1]):
        out, _ = op1_neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"))
        assert {(r.doc_id, r.class_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}
    near = words("b") + " tail"
    rows = [(1, words("a")), (2, words("a")), (2, near), (3, words("b"))]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame([(*r, "x", "y") for r in order], "doc_id long, text string, component string, id string")
        out, _ = op1_neardup.near_duplicates(frame)
        assert {(r.doc_id, r.class_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}
