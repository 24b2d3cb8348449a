"""From raw documents to token ids: quality rules, near-dedup, substring dedup, source mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.llm import op1_neardup, op4_pieces, op6_repeats, op7_mix, op8_quality
from velotrace.llm.common import release, table, work_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts have no words and go; rows of one id are judged one by one."""
    return op8_quality.keep_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id, with all rows of that id; rows without an id stay."""
    return op1_neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; texts lose the words of 20-word windows that an earlier place holds, and n_chars counts what is left. Null texts stay null."""
    out = op6_repeats.remove_repeats(docs, outputs="text")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times. Rows without words are not taken."""
    return op7_mix.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each row; a null text counts as empty and has the end id alone."""
    return op4_pieces.encode_decode(docs, op4_pieces.model_path(), outputs="ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encoding", encoding)]
#: Near-dedup can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work_table(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)  # the source table has no work folder and stays
    return STAGES[-1][1](spark, docs, sf_dir)
