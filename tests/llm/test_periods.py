"""Short periodic passages, whose equal windows share their place, against the window rule in plain Python."""

import hashlib

from velotrace.llm import op6_repeats


def test_periodic_passages(spark):
    rows = []
    for period in range(2, 13):
        for length in range(20 + period, 37):
            for lead in (0, 1, 6, 11):  # moves the passage within its document and all later ones within the chunk
                n = len(rows)
                rows.append((n, " ".join([f"a{n}.{k}" for k in range(lead)] + [f"p{n}.{k % period}" for k in range(length)])))
    first, want = {}, {}
    for i, text in rows:
        w = text.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, text in rows:
        w = text.split()
        gone = {k + j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for j in range(20)}
        want[i] = (len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert all(n for n, _ in want.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op6_repeats.remove_repeats(docs).collect()}
    missed = [i for i in want if got[i] != want[i]]
    assert not missed, (len(missed), len(want))
