"""The stages against plain Python."""

import corpus_pipeline as cp
from velotrace.llm import op1_neardup, op7_mix, op8_quality
from velotrace.llm.common import work_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    passed = work_table(cp.quality(spark, docs, SF), "q")
    assert {r.doc_id for r in passed.collect()} == {r.doc_id for r in op8_quality.judge(docs).filter("kept").collect()} and passed.columns == cols
    one = work_table(cp.near_dedup(spark, passed, SF), "n")
    classes = {r.class_id for r in op1_neardup.near_duplicates(passed)[0].collect()}
    assert {r.doc_id for r in one.collect()} == classes and one.columns == cols
    cut = work_table(cp.substring_dedup(spark, one, SF), "s")
    assert cut.count() == one.count() and cut.columns == cols and all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = work_table(cp.mixing(spark, cut, SF), "m")
    assert mixed.count() == sum(r.copies for r in op7_mix.mix_sources(cut).collect()) and mixed.columns == cols
    out = cp.encoding(spark, mixed, SF)
    assert out.count() == mixed.count()
    full = cp.run(spark, SF)
    assert sorted(map(str, full.collect())) == sorted(map(str, out.collect()))
