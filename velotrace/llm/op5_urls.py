"""URL filters: every URL's host-suffix and path-prefix expressions meet the rules on short digest prefixes.

Only expressions that some rule could equal are made: suffixes with as many labels, and path prefixes with as many code points, as a rule has. They
join the rules on the first 8 hex digits of their SHA-256; the full digest then confirms a match, and the longest rule wins (the longer host first
where two are of one length). URLs that no rule fits are allowed.

Defined results: a null URL, or one without "://", has empty host and path and is allowed; ties can't differ in verdict unless two equal rules do,
then block wins; repeated rows stay; an empty table gives none; an empty rule list allows all; extra columns are ignored. Distinct (host, path) pairs
are judged once, so that a URL that holds a third of all rows is expanded once per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_columns, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A rule list of at most so many rules is broadcast; longer ones are shuffled.
BROADCAST_RULES = 50_000
SALTS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row."""
    spark = pages.sparkSession
    rows = [(v, h, p) for v, h, p in rules]
    rule = spark.createDataFrame(rows or [("allow", "", "")], "verdict string, r_host string, r_path string")
    rule = rule.filter(F.lit(bool(rows))).groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    rule = rule.select("*", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256).alias("r_digest"))
    rule = rule.select(F.substring("r_digest", 1, 8).alias("short"), "r_digest", "r_host", "r_path", "verdict")
    labels, lengths = sorted({h.count(".") + 1 for _, h, _ in rows}), sorted({len(p) for _, _, p in rows})
    host, path = host_and_path(F.col(url_col))
    base = keep_columns(pages, id_col, url_col).select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rows:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = base.select("host", "path").distinct()
    dots = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    hosts = F.array_compact(F.array(*[F.when(dots >= n, F.substring_index("host", ".", -n)) for n in labels]))
    tails = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    expr = urls.select("host", "path", F.explode(hosts).alias("suffix"), tails.alias("tails")).select("host", "path", "suffix", F.explode("tails").alias("prefix"))
    expr = expr.select("host", "path", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    rule = F.broadcast(rule) if len(rows) <= BROADCAST_RULES else rule
    hit = expr.join(rule, "short").filter(F.col("digest") == F.col("r_digest"))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_digest")
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), order).alias("best"))
    # one row per URL on this side: it is repeated for each salt, so that a hot URL's rows spread
    best = best.select("host", "path", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    out = salted.join(best, ["host", "path", "salt"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
OP5_SQL = (
    """WITH u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, """
    + "CASE "
    + " ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))))
    + " END AS rule, CASE "
    + " ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{v}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))))
    + " ELSE 'allow' END AS verdict FROM h"
)
