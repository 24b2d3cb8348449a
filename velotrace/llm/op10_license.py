"""License scans by MinHash bands over overlapping text windows, in DataFrame operations only.

Words are runs of letters and digits, lower-cased; shingles are five words. Templates are sorted into classes of up to 1, 2, 4, 8, ... shingles. For
each class a text is read in windows of the class size and a quarter more, at steps of that quarter, so that any passage of a template's length lies
within one. BANDS one-row MinHash bands of a window meet those of the templates. A window has less than 2.5 times the shingles of a template, so one that
holds four fifths of them has a similarity of 0.8 / 2.7 or more with it, and the bands miss it with a probability of at most (1 - 0.8 / 2.7) ** BANDS,
8e-7; a whole template has 1 / 2.5, and is missed with 1e-9. Exact shingle containment then verifies each pair.

Windows without any shingle of a template can't match and make no bands. Defined results: null, empty and shorter texts than five words match nothing;
each document has at most one row per template, with its best window (the first on ties); a repeated doc_id counts as one document; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_columns, table

BANDS, WORDS, CONTAINED = 40, 5, 0.8
#: Templates of at most so many shingles are scanned at once, or else one; that bounds what each task holds. Longer lists take several scans.
MAX_SHINGLES = 200_000
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause-text": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors \"as is\" and any express "
    "or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any "
    "direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused "
    "and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, "
    "direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with "
    "the use or performance of this software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def _shingled(df: DataFrame, text: str) -> DataFrame:
    """Adds words and shingles (hashes, in order)."""
    df = df.withColumn("words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    parts = ", ".join(f"slice(words, {j}, size(words) - {WORDS - 1})" for j in range(1, WORDS + 1))
    hashed = ", ".join(f"g.`{j}`" for j in range(WORDS))
    return df.withColumn("grams", F.expr(f"CASE WHEN size(words) < {WORDS} THEN cast(array() AS array<bigint>) ELSE transform(arrays_zip({parts}), g -> xxhash64({hashed})) END"))


def _bands(grams: str) -> str:
    return f"transform(sequence(1, {BANDS}), b -> array_min(transform({grams}, x -> xxhash64(x, b))))"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, license, containment, start (the window's first word), one for each document and template that it holds."""
    groups: list[dict[str, str]] = [{}]
    size = 0
    for name, text in templates.items():
        words = len(text) // 2 + 1  # no fewer than its shingles
        if groups[-1] and size + words > MAX_SHINGLES:
            groups.append({})
            size = 0
        groups[-1][name] = text
        size += words
    return reduce(DataFrame.unionByName, [_scan(docs, g, contained, id_col, text_col) for g in groups])


def _scan(docs: DataFrame, templates: dict[str, str], contained: float, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    t = _shingled(spark.createDataFrame([(k, v) for k, v in templates.items()] or [("", "")], "license string, t_text string"), "t_text")
    t = t.select("license", F.array_distinct("grams").alias("t_grams")).filter(F.size("t_grams") > 0)
    t = t.withColumn("class", F.expr("cast(ceil(log2(size(t_grams)) - 1e-9) as int)")).withColumn("lows", F.expr(_bands("t_grams")))
    facts = t.agg(F.collect_set("class"), F.array_distinct(F.flatten(F.collect_list("t_grams"))), F.array_distinct(F.flatten(F.collect_list("lows")))).first()
    classes, grams, lows = sorted(facts[0] or [0]), facts[1] or [], facts[2] or []
    # a small table rather than a literal: every task reads one array
    known = F.broadcast(spark.createDataFrame([(1, grams, lows)], "one int, known array<bigint>, t_lows array<bigint>"))
    d = _shingled(keep_columns(docs, id_col, text_col), text_col).select(F.col(id_col).alias("_id"), "grams")
    d = d.withColumn("one", F.lit(1)).join(known, "one").filter(F.expr("arrays_overlap(grams, known)"))  # one row on this side
    step = "greatest(1, cast(shiftleft(1, class) / 4 as int))"
    d = d.select("_id", "grams", "known", "t_lows", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    d = d.withColumn("step", F.expr(step)).withColumn("span", F.expr("shiftleft(1, class) + step"))
    d = d.withColumn("start", F.explode(F.expr("sequence(0, size(grams) - 1, step)"))).withColumn("window", F.expr("slice(grams, start + 1, span)"))
    d = d.filter(F.expr("arrays_overlap(window, known)")).select("_id", "class", "start", "window", "t_lows")
    # only bands whose minimum some template has leave their window
    some = F.expr(f"filter(transform({_bands('window')}, (x, i) -> struct(i AS band, x AS low)), s -> array_contains(t_lows, s.low))")
    b = d.select("_id", "class", "start", "window", F.inline(some))
    tb = t.select("license", "class", "t_grams", F.posexplode("lows").alias("band", "low"))
    hit = b.join(F.broadcast(tb), ["class", "band", "low"])
    hit = hit.withColumn("containment", F.size(F.array_intersect("window", "t_grams")) / F.size("t_grams")).filter(F.col("containment") >= contained)
    best = F.max_by(F.struct("containment", "start"), F.struct("containment", -F.col("start")))
    out = hit.groupBy("_id", "license").agg(best.alias("best"))
    return out.select(F.col("_id").alias(id_col), "license", F.col("best.containment").alias("containment"), F.col("best.start").cast("long").alias("start"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
OP10_SQL = rf"""
WITH t0 AS (SELECT license, list_filter(regexp_split_to_array(lower(txt), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM (VALUES {_VALUES}) v(license, txt)),
tg AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t0 WHERE len(w) >= 5)),
tn AS (SELECT license, count(*) AS k, greatest(1, (1 << ceil(log2(count(*)) - 1e-9)::INT) // 4) AS step, (1 << ceil(log2(count(*)) - 1e-9)::INT) AS cls FROM tg GROUP BY license),
d0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d0 WHERE len(w) >= 5)),
m AS (SELECT doc_id, license, g, p, k, step, cls + step AS span FROM dg JOIN tg USING (g) JOIN tn USING (license)),
s AS (SELECT doc_id, license, g, k, unnest(range(greatest(0, ceil((p - span + 1) / step)::BIGINT), p // step + 1)) * step AS start FROM m),
c AS (SELECT doc_id, license, start, count(DISTINCT g) / any_value(k) AS containment FROM s GROUP BY doc_id, license, start),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS n FROM c WHERE containment >= {CONTAINED})
SELECT doc_id, license, containment, start FROM r WHERE n = 1
"""
