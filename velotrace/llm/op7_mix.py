"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources share `share` times all words by their weights; none gets more than `most` times its own words, and what is over goes to the others
by weight (water filling, by running sums over the sources). Sampling: each document of a source is expected target / source size times; these
expectations are summed along the source, one random offset is added, and a document is taken once for each integer that its step crosses. The order
along a source is by size class (an eighth of a binary order) and then random, so that the words taken follow the target closely.

Distribution: the running sum has two levels. Rows are counted per (source, size class, 256th of the hash range), the counts are summed in order, and
only the ranks within one such cell are found by a window. So a source with a third of all rows spreads over thousands of cells.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, the last; ties in the order fall to doc_id and
size; repeated rows are sampled one by one; an empty table gives none; extra columns are ignored; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, keep_columns, table, work_table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Fewer sources than this: their table is broadcast.
BROADCAST_SOURCES = 10_000


def _cell(size: Column) -> Column:
    bits = F.length(F.bin(size))
    return bits * 8 + F.expr("cast(shiftright(size, greatest(length(bin(size)) - 3, 0)) as int)")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """missing, src, source_size, target and offset of each source; sized has missing, src, size."""
    one = F.lit(1)
    src = sized.groupBy("missing", "src").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(Window.partitionBy(one).orderBy("missing", "src")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    up = Window.partitionBy(one).orderBy(F.col("limit") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(one)) * F.lit(float(share))
    src = src.withColumn("level", (total - before) / left)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    src = src.withColumn("level", F.first(fits, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    src = src.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix "), F.col("missing").cast("string"), F.col("src"))), 1, 8), 16, 10).cast("double")
    return src.select("missing", "src", "source_size", "target", (draw / F.lit(4294967296.0)).alias("offset"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """Per row: id, source, size, source_size, target, copies, taken; with carry also row, a struct of all columns of docs."""
    row = [F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if carry else []
    sized = (docs if carry else keep_columns(docs, id_col, text_col, source_col)).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(source_col).isNull().cast("int").alias("missing"), F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row,
    )
    base = work_table(sized.drop("row"), "mix-sizes")
    src = work_table(targets(base, weights, share, most), "mix-targets")
    key = ["missing", "src", "cell", "part"]

    def keyed(d: DataFrame) -> DataFrame:
        return d.withColumn("draw", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("cell", _cell(F.col("size"))).withColumn("part", F.substring("draw", 1, 2))

    cells = keyed(base).filter("size > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("missing", "src").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    tie = [F.xxhash64("row")] if carry else []  # rows of one id and size: which text is taken doesn't change by run
    rows = keyed(sized if carry else base).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("draw", "id", "size", *tie)))
    rows = rows.join(cells, key, "left")
    few = src.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(src) if few else src, ["missing", "src"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.coalesce(F.col("ahead"), F.lit(0)) + F.col("place")
    steps = F.floor(at * rate + F.col("offset")) - F.floor((at - 1) * rate + F.col("offset"))
    copies = F.when(F.col("size") > 0, F.least(steps, F.lit(int(most)))).otherwise(F.lit(0)).cast("long")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as it is taken."""
    taken = mix_sources(docs, carry=True, **options).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH base AS (SELECT doc_id, (source IS NULL)::INT AS missing, coalesce(source, '') AS src,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
r AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS cell FROM base),
s0 AS (SELECT missing, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY missing, src) AS rank FROM base GROUP BY missing, src),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
lv AS (SELECT arg_min(level, lim / weight) AS level FROM s2 WHERE level <= lim / weight),
s AS (SELECT missing, src, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(lim, coalesce((SELECT level FROM lv) * weight, lim)) END::DOUBLE AS target,
  ('0x' || substr(md5('mix ' || missing::VARCHAR || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM s2),
p AS (SELECT r.*, row_number() OVER (PARTITION BY missing, src ORDER BY cell, draw, doc_id, size) AS pos FROM r WHERE size > 0
  UNION ALL SELECT r.*, 0 FROM r WHERE size = 0),
c AS (SELECT p.*, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS rate, s.off
  FROM p JOIN s ON p.missing = s.missing AND p.src = s.src)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN least(floor(pos * rate + off) - floor((pos - 1) * rate + off), 2) ELSE 0 END * size)::BIGINT AS taken FROM c
"""
