"""Near-dedup where very many documents share a minimum hash: work between unlike ones is left out, links are not."""

import itertools

import numpy as np
import pyarrow as pa

from velotrace.llm import op1_neardup


def shingle_sets(texts):
    words = [t.split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]


def similar(u, v):
    return len(u & v) >= 0.8 * len(u | v)


def template_texts(n=240):
    rng = np.random.default_rng(5)
    base = [f"word{k}" for k in range(300)]
    out = []
    for k in range(n):
        at = set(rng.choice(300, rng.integers(1, 24), replace=False).tolist())
        out.append(" ".join(f"own{k}x{i}" if i in at else w for i, w in enumerate(base)))
    return out


def test_unlike_copies_of_a_template_are_no_candidates():
    texts = template_texts()
    n = len(texts)
    (prints,) = op1_neardup._fingerprints([pa.record_batch({"id": pa.array(range(1, n + 1)), "text": pa.array(texts)})])
    t = pa.table({c: prints.column(c) for c in ("id", "n", "sim_a", "sim_b", "odd")} | {"low": np.zeros(n, int), "cls": np.arange(n), "role": np.full(n, 2), "ask": np.ones(n, bool)})
    got = {(a, b) for a, b in zip(*op1_neardup._search(None)(t).select(["a", "b"]).to_pydict().values()) if a != b}
    sets = shingle_sets(texts)
    want = {(a + 1, b + 1) for a, b in itertools.combinations(range(n), 2) if similar(sets[a], sets[b])}
    assert 500 < len(want) < n * (n - 1) / 4
    assert want <= got  # the graph finds all in so small a shard
    assert len(got) < 1.3 * len(want)


def test_parities_never_part_similar_sets():
    rng = np.random.default_rng(7)
    for size in (1, 4, 5, 9, 60, 700, 5000):
        base = [f"w{k}" for k in range(size + 4)]
        texts = [" ".join(base[: len(base) - cut]) + tail for cut in range(0, size // 10 + 1, max(1, size // 60)) for tail in ("", " z", "".join(f" {x}" for x in rng.integers(0, 99, max(1, size // 12))))]
        (p,) = op1_neardup._fingerprints([pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})])
        odd = np.frombuffer(b"".join(p.column("odd").to_pylist()), np.uint64).reshape(len(texts), -1)
        sets = shingle_sets(texts)
        pairs = [(a, b) for a, b in itertools.product(range(len(texts)), repeat=2) if similar(sets[a], sets[b])]
        a, b = np.array(pairs).T
        assert op1_neardup._may_be_similar(odd, p.column("n").to_numpy(), a, b).all()


def test_classes_of_size_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = []
    for family in range(40):
        size = int(rng.integers(12, 160))
        base = ["all", "of", "them", "begin", "with", "the", "same", "words"] + [f"f{family}w{k}" for k in range(size)]
        texts += [" ".join(base + [f"t{k}" for k in range(int(more * len(base)))]) for more in (0, 0.08, 0.17, 0.22, 0.3)]
    sets = shingle_sets(texts)
    least = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]):
            x, y = sorted((least[a], least[b]))
            least = [x if c == y else c for c in least]
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(op1_neardup, "CAP", 4)
    out, audit = op1_neardup.near_duplicates(docs)
    assert {r.doc_id: r.class_id for r in out.collect()} == {k + 1: c + 1 for k, c in enumerate(least)}
    assert len(set(least)) < len(texts) / 2


def test_near_dedup_stage_compares_few_pairs(spark, monkeypatch):
    import corpus_pipeline

    texts = template_texts(120)
    sets, least = shingle_sets(texts), list(range(len(texts)))
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(sets[a], sets[b])]
    for a, b in links:
        x, y = sorted((least[a], least[b]))
        least = [x if c == y else c for c in least]
    compared, real = [], op1_neardup.verified
    monkeypatch.setattr(op1_neardup, "verified", lambda text, pairs: compared.append(pairs.count()) or real(text, pairs))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(least)
    assert sum(compared) < 2 * len(links)
