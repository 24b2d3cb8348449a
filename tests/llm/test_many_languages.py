"""More languages than any fixed number of classes."""

import random

from pyspark.sql import functions as F

from velotrace.llm import op9_language


def test_all_languages_are_learned(spark):
    rng = random.Random(9)
    rows = []
    for k in range(70):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        for _ in range(4):
            rows.append((len(rows), " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(60)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op9_language.identify(docs, F.col("doc_id") % 4 == 3).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got} == {lang for *_, lang in rows}
    wrong = [r.doc_id for r in got if r.lang_pred != r.lang]
    assert not wrong, (len(wrong), len(got))
    model = op9_language.train(docs, F.lit(True), rows_most=70)
    assert len(model["langs"]) == 70
