"""Brute force, round trips and edge cases of the corpus operators on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from velotrace.llm import op1_neardup, op2_html, op3_media, op4_pieces, op5_urls, op6_repeats, op7_mix, op8_quality, op9_language, op10_license, queries
from velotrace.llm.graphs import SmallWorld, components, exact_within

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeats, a very long text, and columns with names that operators use inside."""
    rng = random.Random(4)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n", None, "b", 3), (7, "one two", "en", "b", 7), (8, "one two", "fr", None, 7),
        (9, words(rng, 30) + " " + passage + " " + words(rng, 30), "fr", "a", 1), (10, words(rng, 44) + " " + passage, "fr", "c", 1), (11, "same " * 200, "en", "c", 1), (12, words(rng, 30_000, 10**6), "en", "a", 1),
        (13, "\u65e5\u672c \ud55c \U0001f600 e\u0301" * 40, None, "a", 1), (14, "a b c d e f g " * 30, "fr", "a", 1), (None, base, "en", "a", 1), (7, "one two", "en", "b", 7), (15, "x" * 5000, "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, 9, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SF), duck(SF).execute(queries.SQL[name]).df())


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_near_duplicates_by_brute_force(spark, odd, none):
    more = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    for docs in (odd.select("doc_id", "text").unionByName(more),):
        out, audit = op1_neardup.near_duplicates(docs)
        got = {r.doc_id: r.class_id for r in out.collect()}
        sets = collections.defaultdict(list)
        for r in docs.collect():
            w = WORD.findall(r.text or "")
            sets[r.doc_id].append(frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        sets.pop(None, None)
        parent = {i: i for i in sets}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        ids = sorted(sets)
        for i in ids:
            for j in ids:
                if i < j and any(a and b and len(a & b) >= 0.8 * len(a | b) for a in sets[i] for b in sets[j]):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        assert {i: got[i] for i in ids} == {i: root(i) for i in ids}
        row = audit.first()
        assert row.found >= 0.9 * row.truth
    assert op1_neardup.near_duplicates(none)[0].count() == 0


def test_small_world_recall():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (150, 2), dtype=np.uint64)
    points = np.repeat(base, 4, 0) ^ (np.uint64(1) << rng.integers(0, 63, (600, 2), dtype=np.uint64))
    q, p, _ = SmallWorld(points).within(points, 12)
    eq, ep, _ = exact_within(points, points, 12)
    truth = set(zip(eq.tolist(), ep.tolist()))
    assert len(truth & set(zip(q.tolist(), p.tolist()))) >= 0.9 * len(truth)


def test_components(spark):
    e = [(i, i + 1) for i in range(9)] + [(100, 101), (101, 99), (7, 7)]
    got = dict(components(spark.createDataFrame(e, "a long, b long")).select("id", "component").collect())
    assert got == {i: 0 for i in range(10)} | {99: 99, 100: 99, 101: 99}


def test_html():
    page = "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>Cookies!</div><main><h1>Head &amp; line</h1><p>First  part<br>of it.<p>Second <b>bold</b> &eacute;.</p><form>Name<input></form></main><div class='comments'><p>I like it. It is a long comment of a reader.</p></div><aside>More</aside><script>var a='<p>no</p>'</script><footer>&copy;</footer>"
    assert op2_html.main_text(page) == "Head & line\n\nFirst part of it.\n\nSecond bold \u00e9."
    assert op2_html.main_text(None) == op2_html.main_text("") == op2_html.main_text("<nav>x</nav>") == ""
    assert op2_html.main_text("<p>" + "A long sentence of plain words. " * 9 + "</p>").startswith("A long")


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 7)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        pairs = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i)]
        flow = op2_html.Flow(n)
        for i, c in enumerate(cost):
            flow.edge(*((n, i) if c > 0 else (i, n + 1)), abs(c))
        for i, j, w in pairs:
            flow.edge(i, j, w, w)
        price = lambda yes: sum(c for c, y in zip(cost, yes) if c > 0 and not y) - sum(c for c, y in zip(cost, yes) if c < 0 and y) + sum(w for i, j, w in pairs if yes[i] != yes[j])  # noqa: E731, B023
        best = min(price([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert abs(price(flow.source_side(n, n + 1)[:n]) - best) < 1e-6


def test_media(odd, none):
    got = op3_media.media_column(odd, tensors_too=True).collect()
    texts = odd.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for t, g in zip(texts, got):
        b = (t.text or "").encode()
        pad = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(b), len(pad), hashlib.sha256(pad).hexdigest())
        assert len(g.rgb) == g.height * g.width * 3 and g.media_bytes == len(g.media)
    assert len({(g.payload_sha256, g.media_sha256, g.feature) for g in got}) == len({g.payload_sha256 for g in got})
    assert op3_media.media_column(none).count() == 0


def test_media_decoders_agree():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8) for n in (1, 6, 13)] + [rng.integers(-2, 3, 640).astype(np.int8).view(np.uint8), np.zeros(64, np.uint8)]
    files = op3_media.encode(payloads, [len(p) for p in payloads])
    for f, fast, p in zip(files, op3_media.coefficients(files), payloads):
        assert op3_media.payload(fast) == p.tobytes()
        slow = op3_media.parse(f)
        for x in slow.parts:
            x["coef"] = np.zeros((x["cols"] * x["rows"], 64), np.int64)
        for s in slow.scans:
            op3_media._by_block(slow, s, f)
        assert all((a["coef"] == b["coef"]).all() for a, b in zip(slow.parts, fast.parts))
    c = np.zeros((1, 64), np.int64)
    c[0, 0] = 80
    assert (np.floor((c.astype(float) @ op3_media.BASIS) / 8192 + 0.5) == 10).all()


def test_pieces(odd, none):
    enc, lib = op4_pieces.load(op4_pieces.model_path())
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\u2581abcde\u00e9thE\u65e5\U0001f600.,\t#1") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [" " * 70 + "x", "the" * 500]
    for t, want in zip(texts, lib.encode(texts, add_eos=True)):
        assert enc.encode(t)[0] == want
    got = op4_pieces.encode_decode(odd, op4_pieces.model_path()).collect()
    for r, g in zip(odd.collect(), got):
        ids = lib.encode(r.text or "", add_eos=True)
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert op4_pieces.encode_decode(none, op4_pieces.model_path()).count() == 0


def test_urls(spark):
    urls = [None, "x", "http://Example.ORG/en/12?q", "http://a.b.example.org/es/", "http://example.org", "http://notexample.org/es/1", "http://x.com/de/#f", "ftp://y://z.com/fr/", "http://x.com/fr/", "http://x.com/fr/", "http://.../"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in op5_urls.judge(df).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"), ("a.b.example.org", "/es/", "example.org/es/", "block"), ("example.org", "", None, "allow"), ("notexample.org", "/es/1", "org/", "allow"),
        ("x.com", "/de/", "com/de/", "block"), ("y:", "//z.com/fr/", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("...", "/", None, "allow"),
    ]
    assert op5_urls.judge(df, rules=()).count() == len(urls) and op5_urls.judge(df.limit(0)).count() == 0


def test_repeats(odd, none):
    rows = odd.collect()
    first, want = {}, {}
    docs = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
    for r in docs:
        w = WORD.findall(r.text or "")
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (r.doc_id, i))
    for r in docs:
        w = WORD.findall(r.text or "")
        gone = {i + j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (r.doc_id, i) for j in range(20)}
        want[r.doc_id] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_repeats.remove_repeats(odd).collect()}
    assert got.pop(None)[1] == 0 and got == want
    assert want[2][1] == 120 and want[10][1] == 60 and want[11][1] == 199
    text = op6_repeats.remove_repeats(odd, outputs="text")
    assert text.columns == odd.columns and by_id(text)[2].text == "" and by_id(text)[4].text is None
    assert op6_repeats.remove_repeats(none).count() == 0


def test_mix(spark, odd, none):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = op7_mix.mix_sources(docs).collect()
        assert all(r.taken <= 2 * r.size for r in got) and len(got) == docs.count()
        total = sum(r.size for r in got)
        targets = {r.source: (r.target, r.source_size) for r in got}
        assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-3 and all(t <= 2 * s + 1e-6 for t, s in targets.values())
        biggest = max(r.size for r in got)
        for s, (t, _) in targets.items():
            assert abs(sum(r.taken for r in got if r.source == s) - t) <= 2 * biggest
        assert sorted(map(str, got)) == sorted(map(str, op7_mix.mix_sources(docs).collect()))
        assert op7_mix.mixed_rows(docs).count() == sum(r.copies for r in got)
    assert op7_mix.mix_sources(none).count() == 0 and op7_mix.mixed_rows(none).columns == none.columns


def test_quality(spark, odd, none):
    got = op8_quality.judge(odd).collect()
    want = collections.Counter()
    for r in odd.collect():
        w = WORD.findall(r.text or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        want[(r.doc_id, len(w), sum(map(len, w)), len(rep))] += 1
    assert collections.Counter((g.doc_id, g.n_words, g.word_chars, g.n_repeat_words) for g in got) == want
    assert not any(g.kept for g in got if g.n_words < 50)
    assert op8_quality.judge(none).count() == 0 and op8_quality.keep_rows(none).columns == none.columns
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = op8_quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("NOT base_failed")
    clean = kept.filter("quality = 1")
    assert clean.filter("kept").count() >= 0.99 * clean.count()
    assert kept.filter("quality = 0 AND kept").count() <= 0.3 * kept.filter("quality = 0").count()


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = op9_language.identify(docs, held, per_lang=60).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    for r in op9_language.identify(odd).collect():
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6)) and 0 <= r.score <= 1
    assert {r.lang_pred for r in op9_language.identify(odd, F.lit(True)).collect()} == {"und"} and op9_language.identify(none).count() == 0
    for n in (1, 2, 4, 7):
        code = op9_language.codewords(n)
        assert len({tuple(c) for c in code}) == n


def test_license(spark, odd, none):
    rng = random.Random(5)
    long = op10_license.TEMPLATES["MIT-text"].split()
    edited = long[:20] + ["THING"] + long[21:]
    rows = [(1, words(rng, 50) + " " + op10_license.TEMPLATES["MIT"] + " " + words(rng, 50)), (2, words(rng, 37) + " " + " ".join(edited) + " " + words(rng, 400)), (3, " ".join(long[:20])), (1, None), (4, None)]
    got = sorted((r.doc_id, r.license) for r in op10_license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT"), (2, "MIT-text")]
    assert op10_license.scan(odd).count() == 0 and op10_license.scan(none).count() == 0 and op10_license.scan(odd, templates={}).count() == 0
