"""Main text: the cut against the classifier alone on labelled pages, wrappers, and odd tables."""

import pytest

from velotrace.llm import op2_html as H
from velotrace.llm import op2_layouts

TEXT = "<h1>A title</h1><p>The first sentence of it. And another one.</p>"
WANT = "A title\n\nThe first sentence of it. And another one."


def test_the_cut_mends_labels():
    model = H.fitted()
    right_sign = right_cut = flips = mended = 0
    for seed in range(10_000, 10_200):
        html, content = op2_layouts.page(seed)
        found = H.blocks(html)
        for b, cut in zip(found, H.label(found, model)):
            sign, want = H.score(b, model[0]) >= 0, b.text in content
            flips += sign != cut
            mended += sign != cut and cut == want
            right_sign += sign == want
            right_cut += cut == want
    assert flips >= 20 and mended >= 0.6 * flips and right_cut > right_sign


def test_a_short_paragraph_between_long_ones():
    long = "<p>" + "A sentence of several plain words, and some more. " * 6 + "</p>"
    page = f"<body><div class='menu'><a href=x>Home</a></div><div class=c7>{long}<p>No, not that.</p>{long}</div><div class=c6>No, not that?</div>"
    found = H.blocks(page)
    model = H.fitted()
    k = [b.text for b in found].index("No, not that.")
    assert H.score(found[k], model[0]) < 0 and H.label(found, model) == [False, True, True, True, False]


@pytest.mark.parametrize("wrapper", ["page with-sidebar", "post has-comments", "sidebar-left", "layout menu-open", "comments-on"])
def test_wrappers_do_not_condemn(wrapper):
    for name in ("article", "main"):
        page = f"<body><div class='{wrapper}'><{name}>{TEXT}</{name}><div class='comments'><p>What a reader says about it.</p></div></div></body>"
        assert H.main_text(page) == WANT


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>Number {k} of many sentences here.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", TEXT), (1, "u", TEXT), (None, None, None), (3, "u", ""), (4, None, "<p"), (5, "u", "</div></p>&amp;<<b>" + "<div>" * 3000), (6, "u", "<article>" + TEXT), (7, "u", long)]
    df = spark.createDataFrame([(*r, "extra", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    twice = df.select("*", df.html.alias("url2")).toDF("page_id", "url", "html", "text", "n_chars", "url")  # the first of a repeated name counts
    for frame in (df, twice):
        out = H.extract(frame)
        assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
        got = out.collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        by = {r.page_id: r.text for r in got}
        assert by[6] == WANT and by[None] == by[3] == by[4] == "" and by[7].count("\n\n") == 19_999
        assert sum(r.page_id == 1 for r in got) == 2 and len({r.text for r in got if r.page_id == 1}) == 1
    assert H.extract(df.limit(0)).count() == 0


def test_query_returns_the_article_of_each_page(spark):
    import html
    import re

    sf = "/root/testdata/sf0.001"
    space = lambda x: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", "\n")))).strip()
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op2_html(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id].html, re.S).group(1)
        assert r.text == "\n\n".join(x for x in map(space, re.split(r"</?(?:p|h1)>", article)) if x)
