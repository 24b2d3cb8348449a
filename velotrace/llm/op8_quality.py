"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of a document, of character classes and of the language's common words, are held against those of all documents of its language by
the Jensen-Shannon distance. A document that is far from its language in either is rejected. Histograms of short documents are noise: the word
histogram counts only from `min_words` words on, and the base rules reject documents of under 50 words.

Common words: the most frequent words of two to four code points. Null languages form one language of their own. The references count all documents
with at least 50 words and give each document the weight of its length, so that a repeated short document can't shift them.

Defined results: null and empty texts have no words and fail the base rules; ties among common words fall to the smaller word; repeated rows give
equal rows; an empty table gives none; extra columns are ignored; texts of any length are read whole (time n log n in the words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, keep_columns, table, work_table

COMMON = 12
#: Each limit is a floor plus an allowance that falls with the root of the words, up to a cap: short documents scatter more.
CHAR_LIMIT, WORD_LIMIT, MIN_WORDS = (0.20, 1.0, 0.31), (0.10, 2.2, 0.27), 100
MIN_BASE, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Character classes that are counted; the last class is all other characters of words, mostly lower-case letters.
CLASSES = (("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"), ("mark", r"[.,;:!?'\x22()-]"), ("symbol", r"[#*$%&|<>]"))
#: The broadcast of the references holds at most so many languages.
BROADCAST_LANGS = 2_000


def repeated_words(words: str) -> Column:
    """How many words lie in three-word windows that the array column holds at least twice."""
    grams = f"transform(arrays_zip(slice({words}, 1, size({words}) - 2), slice({words}, 2, size({words}) - 2), slice({words}, 3, size({words}) - 2)), g -> xxhash64(g.`0`, g.`1`, g.`2`))"
    return F.expr(f"CASE WHEN size({words}) < 4 THEN array() ELSE {grams} END")


def with_base(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carry: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if carry else []
    d = (docs if carry else keep_columns(docs, id_col, text_col, lang_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"), *row)
    kept = ["row"] if carry else []
    d = d.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("grams", repeated_words("words"))
    sorted_ = F.expr("CASE WHEN size(grams) = size(array_distinct(grams)) THEN cast(array() AS array<struct<g:bigint,i:int>>) ELSE array_sort(transform(grams, (g, i) -> struct(g AS g, i AS i))) END")
    d = d.withColumn("order", sorted_)
    twice = F.expr("array_sort(transform(filter(order, (e, j) -> e.g <=> get(order, j - 1).g OR e.g <=> get(order, j + 1).g), e -> e.i))")
    d = d.withColumn("at", twice)
    covered = F.expr("aggregate(transform(at, (p, j) -> least(3, coalesce(get(at, j + 1) - p, 3))), 0, (s, x) -> s + x)")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = d.withColumn("lines", lines)
    counts = [F.regexp_count("text", F.lit(p)).cast("long").alias(f"c_{n}") for n, p in CLASSES]
    return d.select(
        "id", *kept, "lang", "words", F.size("words").cast("long").alias("n_words"), (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), *counts,
    )


def _jsd(p: str, q: str) -> str:
    """Jensen-Shannon distance (root of the divergence in bits) of two arrays of shares; 0 where one is missing."""
    term = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (h.p + h.q)) ELSE 0D END"
    return f"sqrt(greatest(0D, aggregate(transform(zip_with({p}, {q}, (p, q) -> struct(p AS p, q AS q)), h -> ({term.format(x='h.p')} + {term.format(x='h.q')}) / 2), 0D, (s, x) -> s + x)))"


def references(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common: int = COMMON) -> DataFrame:
    """Per language: its common words, and the shares of the character classes and of those words over all its documents."""
    d = keep_columns(docs, text_col, lang_col).select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("n", F.regexp_count("text", F.lit(WORD))).filter(F.col("n") >= MIN_BASE)
    chars = d.groupBy("lang").agg(
        F.sum("n").alias("words"), F.sum(F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).alias("chars"), *[F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in CLASSES]
    )
    words = d.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).filter(F.length("w").between(2, 4)).groupBy("lang", "w").count()
    top = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))).filter(F.col("rank") <= common)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "count"))).alias("top"))
    share = [F.col(n) / F.col("chars") for n, _ in CLASSES]
    rest = F.col("chars") - sum((F.col(n) for n, _ in CLASSES[1:]), F.col(CLASSES[0][0]))
    out = chars.join(top, "lang", "left").select(
        "lang", F.array(*share, rest / F.col("chars")).alias("ref_chars"), F.expr("transform(top, t -> t.w)").alias("common"),
        F.expr("concat(transform(top, t -> t.count / words), array((words - aggregate(top, 0L, (s, t) -> s + t.count)) / words))").alias("ref_words"),
    )
    return out


def _limit(limit: tuple[float, float, float]) -> Column:
    floor, slope, cap = (F.lit(float(x)) for x in limit)
    return F.least(cap, floor + slope / F.sqrt(F.greatest("n_words", F.lit(1))))


def keep_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass, with all their columns; decided row by row, without a join."""
    # a generator, not a filter: Catalyst would copy the whole condition, with all it counts, below the counting
    passed = judge(docs, carry=True, **options).select(F.expr("inline(CASE WHEN kept THEN array(row) ELSE array() END)"))
    return passed.toDF(*docs.columns)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False, char_limit=CHAR_LIMIT, word_limit=WORD_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: id, the base counts, base_failed, the two distances and kept."""
    ref = work_table(references(docs, id_col, text_col, lang_col), "quality-references")
    few = ref.count() <= BROADCAST_LANGS
    d = with_base(docs, id_col, text_col, lang_col, carry)
    d = d.join(F.broadcast(ref) if few else ref, "lang", "left")
    rest = F.col("word_chars") - sum((F.col(f"c_{n}") for n, _ in CLASSES[1:]), F.col(f"c_{CLASSES[0][0]}"))
    d = d.withColumn("p_chars", F.array(*[F.try_divide(F.col(f"c_{n}"), F.col("word_chars")) for n, _ in CLASSES], F.try_divide(rest, F.col("word_chars"))))
    d = d.withColumn("counts", F.expr("transform(common, c -> size(words) - size(array_remove(words, c)))"))
    d = d.withColumn("p_words", F.expr("transform(concat(counts, array(n_words - aggregate(counts, 0L, (s, x) -> s + x))), x -> try_divide(x, n_words))"))
    d = d.withColumn("js_char", F.round(F.expr(_jsd("p_chars", "ref_chars")), 9)).withColumn("js_word", F.round(F.expr(_jsd("p_words", "ref_words")), 9))
    failed = (F.col("n_words") < MIN_BASE) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    near = (F.coalesce("js_char", F.lit(0.0)) <= _limit(char_limit)) & ((F.col("n_words") < min_words) | (F.coalesce("js_word", F.lit(0.0)) <= _limit(word_limit)))
    # a generator stands between the columns and any later filter, which Catalyst would otherwise copy, with all it counts, below the counting
    return d.select(F.inline(F.array(F.struct(
        F.col("id").alias(id_col), *(["row"] if carry else []), "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"),
        F.when(F.col("n_words") >= MIN_BASE, F.col("js_char")).alias("js_char"), F.when(F.col("n_words") >= min_words, F.col("js_word")).alias("js_word"),
    ))))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_SQL_JSD = "sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ((CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END) + (CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0 END)) / 2))))"
_SQL_LIMIT = "least({2}, {0} + {1}::DOUBLE / sqrt(greatest(n_words, 1)))"
OP8_SQL = (
    r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (SELECT k, doc_id, lang, words, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda w: length(w)))::BIGINT AS chars,
  len(regexp_extract_all(text, '\p{Lu}')) AS u, len(regexp_extract_all(text, '\p{Nd}')) AS n, len(regexp_extract_all(text, '[.,;:!?''"()-]')) AS m, len(regexp_extract_all(text, '[#*$%&|<>]')) AS s,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS hash_text FROM (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM b WHERE len(words) >= 3)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, hash_text) AS c FROM g),
cov AS (SELECT k, count(DISTINCT j)::BIGINT AS covered FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY k),
lg AS (SELECT lang, sum(n_words) AS words, sum(chars) AS chars, sum(u) AS u, sum(n) AS n, sum(m) AS m, sum(s) AS s FROM b WHERE n_words >= 50 GROUP BY lang),
wc AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(words) AS w FROM b WHERE n_words >= 50) WHERE length(w) BETWEEN 2 AND 4 GROUP BY lang, w),
tp AS (SELECT lang, list(w ORDER BY rk) AS common, list(c ORDER BY rk) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS rk FROM wc) WHERE rk <= 12 GROUP BY lang),
ref AS (SELECT lang, [u / chars, n / chars, m / chars, s / chars, (chars - u - n - m - s) / chars] AS rc, common,
  list_concat(list_transform(cs, lambda c: c / words), [(words - list_sum(cs)) / words]) AS rw FROM lg LEFT JOIN tp USING (lang)),
h AS (SELECT b.*, rc, rw, [u / chars, n / chars, m / chars, s / chars, (chars - u - n - m - s) / chars] AS pc,
  list_transform(common, lambda c: len(list_filter(words, lambda w: w = c))) AS cnt FROM b LEFT JOIN ref USING (lang)),
j AS (SELECT *, list_transform(list_concat(cnt, [n_words - list_sum(cnt)]), lambda x: x / n_words) AS pw FROM h),
z AS (SELECT *, round("""
    + _SQL_JSD.format(p="pc", q="rc")
    + ", 9) AS jc, round("
    + _SQL_JSD.format(p="pw", q="rw")
    + """, 9) AS jw FROM j)
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, s::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
 (n_words < 50 OR 100 * coalesce(covered, 0) > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * coalesce(covered, 0) > 50 * n_words) AND coalesce(jc, 0) <= """
    + _SQL_LIMIT.format(*CHAR_LIMIT)
    + f" AND (n_words < {MIN_WORDS} OR coalesce(jw, 0) <= {_SQL_LIMIT.format(*WORD_LIMIT)}) AS kept, CASE WHEN n_words >= 50 THEN jc END AS js_char, CASE WHEN n_words >= {MIN_WORDS} THEN jw END AS js_word FROM z LEFT JOIN cov USING (k)"
)
