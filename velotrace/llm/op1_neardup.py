"""SimHash near-dedup over navigable small-world graphs.

1. Each text becomes a 128-bit SimHash, minimum hashes and a digest of its set of five-word shingles. Equal sets are one node.
2. Nodes are sharded by their minimum hashes, in TABLES tables: texts of similarity 0.8 share a shard in each with a probability of 0.8, so all but
   1 in 15,000 pairs share one. Nodes that share no minimum hash with any other need no search. Large shards are split into classes of size and these
   into blocks: the queries of each block are sent to all blocks of their class and of the next, as sets of similarity 0.8 are never further apart.
3. In a shard, every node queries the graph with a beam that doubles while all it holds is within the radius. What the graph returns are the candidates,
   there is no other way to become one. Pairs that meet in several tables are searched as often, in other graphs. The nodes whose id is divisible by AUDIT
   are also compared with all points of their shard: that audits the recall. Where it is below RECALL, the search starts anew with a wider beam.
4. Candidates that share the minimum hash, and whose sizes and parities allow it, are verified on whole shingle sets. Parities tell which of ODD bins hold an
   odd number of shingles; two sets differ in at least as many shingles as in parities, so no link is lost. Texts travel once per group of candidates, not per pair,
   and hardly any without candidates. A node with over NEAREST candidates sends its nearest first; once the classes of the first pass are known, the rest between
   different classes follow, all of them: under a minimum hash with one class there are none.
5. Verified links are joined to classes of nodes, and rows find their node's class.

Defined results: the class id is the least doc_id of the class; null texts and texts without words are alone; texts of one to four words have their
whole word sequence as the one shingle; rows of one doc_id are one document, linked by what any of its texts is linked by; rows with null doc_id have a
null class; an empty table gives none; extra columns are ignored. graph_recall is the audited recall of one search (1 where no pair was audited).
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, chunks, constants, distinct, gram_hashes, keep_columns, mix, packed, release, spans, split_join, starts_of, table, unpacked, word_hashes, work_table
from .graphs import SmallWorld, components, exact_within

log = logging.getLogger(__name__)
SHINGLE, SIMILAR, TABLES, RADIUS = 5, 0.8, 6, 40
CAP, NEAREST, GROUP = 1024, 32, 400
BEAM, AUDIT, RECALL = 16, 100, 0.9
ODD, MARKS = 1024, 1 << 25
_MIN, _BITS = constants(21, 8), constants(22, 4)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles, by document; a short text is one shingle."""
    starts, ends, wfirst = spans(data, offs)
    h = word_hashes(data, starts, ends)
    doc, at = starts_of(wfirst, SHINGLE)
    g = gram_hashes(h, SHINGLE)[at] if len(at) else np.zeros(0, U)
    n = np.diff(wfirst)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = []
        for d in short.tolist():
            x = U(n[d])
            for w in h[wfirst[d] : wfirst[d + 1]]:
                with np.errstate(over="ignore"):
                    x = mix(np.array([x * U(0x9E3779B97F4A7C15) + w]))[0]
            own.append(x)
        doc, g = np.concatenate([doc, short]), np.concatenate([g, np.array(own, U)])
        order = np.argsort(doc, kind="stable")
        doc, g = doc[order], g[order]
    return doc, g


def _fingerprints(batches):
    for batch in batches:
        for row, data, offs in chunks(batch.column(1)):
            n = len(offs) - 1
            doc, g = shingles(data, offs)
            x = distinct(doc.astype(U) << U(48) | g >> U(16))  # a chunk has at most 65,535 documents
            doc = (x >> U(48)).astype(np.int64)
            x = mix(x & U((1 << 48) - 1))
            if not len(doc):
                continue
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            ids = doc[begin]
            with np.errstate(over="ignore"):
                a, b = np.add.reduceat(mix(x ^ _BITS[2]), begin), np.bitwise_xor.reduceat(mix(x ^ _BITS[3]), begin)
                low = np.stack([np.minimum.reduceat(x * m, begin) for m in _MIN[:TABLES]], 1)
            size = np.diff(np.append(begin, len(x)))
            odd = np.zeros(len(ids) * (ODD // 64), U)
            np.bitwise_xor.at(odd, (np.repeat(np.arange(len(ids)), size) * ODD + (x >> U(54)).astype(np.int64)) >> 6, U(1) << (x >> U(54) & U(63)))
            half = []
            for k in range(2):
                ones = np.concatenate([_ones(mix(x[lo:hi] ^ _BITS[k]), begin[i:j] - lo) for i, j, lo, hi in _slices(begin, len(x))])
                half.append(np.packbits(2 * ones > size[:, None], axis=1).view(U).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row + ids)), pa.array(size), *(pa.array(v.view(np.int64)) for v in (a, b, *half)), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * TABLES), pa.array(low.ravel().view(np.int64))), pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(ODD // 8)), pa.py_buffer(odd)])],
                ["id", "n", "set_a", "set_b", "sim_a", "sim_b", "low", "odd"],
            )


def _slices(begin: np.ndarray, total: int, rows: int = 1 << 15):
    """Runs of whole documents of about so many shingles: (first, last document, first, last shingle)."""
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + rows)))
        yield i, j, int(begin[i]), int(begin[j]) if j < len(begin) else total
        i = j


def _ones(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, per run of x: bytes are added eight at a time, in parts of 255 values, where no sum overflows its byte."""
    size = np.diff(np.append(begin, len(x)))
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    step = np.arange(int(parts.sum())) - np.repeat(first, parts)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).view(U)
    sums = np.add.reduceat(bits, np.repeat(begin, parts) + 255 * step, axis=0).view(np.uint8)
    return np.add.reduceat(sums, first, axis=0, dtype=np.int32)


def _may_be_similar(odd: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Whether the parities of the sets a and b allow a similarity of SIMILAR: false only where the sets differ in too many shingles."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), block):
        i, j = a[lo : lo + block], b[lo : lo + block]
        out[lo : lo + block] = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= (n[i] + n[j]) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-6
    return out


def _hits(ids: np.ndarray, sim: np.ndarray, points: np.ndarray, query: np.ndarray, beam: int):
    """(query, point, distance) that a graph of the points returns, and the audit: pairs of queries with an id divisible by AUDIT and any point, and how many of them the graph found."""
    if not len(query) or not len(points):
        return *(np.zeros(0, int),) * 3, 0, 0
    qi, pi, dist = SmallWorld(sim[points]).within(sim[query], RADIUS, beam)
    asked = np.flatnonzero(ids[query] % AUDIT == 0)
    eq, ep, _ = exact_within(sim[points], sim[query[asked]], RADIUS)
    real = ids[query[asked[eq]]] != ids[points[ep]]
    truth = (asked[eq] * len(points) + ep)[real]
    return query[qi], points[pi], dist, len(truth), int(np.isin(truth, qi * len(points) + pi).sum())


def _search(limit: int | None, beam: int = BEAM):
    def work(t: pa.Table) -> pa.Table:
        get = lambda c: t.column(c).to_numpy()
        ids, n, low, cls, role = get("id"), get("n"), get("low"), get("cls"), get("role")
        sim = np.stack([get("sim_a").view(U), get("sim_b").view(U)], 1)
        main = get("main") if "main" in t.column_names else np.zeros(len(ids), bool)
        graph, query = np.flatnonzero(role != 1), np.flatnonzero((role != 0) & get("ask"))
        # of two nodes of different classes one is outside of its hash's main class, and that one searches for the other
        ways = [(graph, query[~main[query]]), (query[main[query]], graph[~main[graph]])]
        a, b, dist, truth, found = zip(*[_hits(ids, sim, points[np.argsort(ids[points], kind="stable")], asked, beam) for points, asked in ways])
        a, b, dist, audit = np.concatenate(a), np.concatenate(b), np.concatenate(dist), (sum(truth), sum(found))
        fit = (low[a] == low[b]) & (ids[a] != ids[b]) & (cls[a] != cls[b]) & (np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b]) - 1e-9)
        a, b, dist = a[fit], b[fit], dist[fit]
        if "odd" in t.column_names:
            fit = _may_be_similar(np.frombuffer(b"".join(t.column("odd").to_pylist()), U).reshape(-1, ODD // 64), n, a, b)
            a, b, dist = a[fit], b[fit], dist[fit]
        more = np.zeros(len(a), bool)
        if limit is not None and len(a):
            order = np.lexsort((ids[b], dist, a))
            a, b = a[order], b[order]
            first = np.searchsorted(a, a)
            keep = np.arange(len(a)) - first < limit
            more = np.zeros(int(keep.sum()), bool)
            more[np.isin(a[keep], a[~keep])] = True
            a, b = a[keep], b[keep]
        k = len(a) + 1
        return pa.table({
            "a": pa.array(np.append(np.minimum(ids[a], ids[b]), 0)), "b": pa.array(np.append(np.maximum(ids[a], ids[b]), 0)), "more": pa.array(np.append(more, False)),
            "truth": pa.array(np.append(np.zeros(k - 1, np.int64), audit[0])), "found": pa.array(np.append(np.zeros(k - 1, np.int64), audit[1])),
        })

    return work


def candidates(nodes: DataFrame, classes: DataFrame | None, limit: int | None, ask: DataFrame | None = None, beam: int = BEAM) -> DataFrame:
    """Without classes all nodes query. With them, pairs of one class are left out. Rows a, b, more, and in rows with a = b = 0 the audit of a shard: audited pairs within the radius, and how many of them the graph found.
    nodes has a row a node with its minimum hashes, or the rows of an earlier call, which are all that can meet. Reads a work table, to be released by the name of what is returned; its rows are in `rows`."""
    rows = nodes.select("id", "n", "sim_a", "sim_b", "odd", *(["t", "low"] if "t" in nodes.columns else [F.posexplode("low").alias("t", "low")]))
    if classes is None:
        rows = rows.withColumn("cls", F.col("id"))
    else:
        rows = rows.join(classes, "id", "left").withColumn("cls", F.coalesce("component", "id")).drop("component")
    if ask is None:
        rows = rows.withColumn("ask", F.lit(True))
    else:
        rows = rows.join(ask.select("id", F.lit(True).alias("ask")), "id", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    if classes is None:
        shared = rows.groupBy("t", "low").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    else:
        # under a minimum hash of one class, or where none asks, there is nothing to find; main is the class with most nodes
        shared = rows.groupBy("t", "low", "cls").agg(F.count(F.lit(1)).alias("times"), F.max("ask").alias("some")).groupBy("t", "low")
        shared = shared.agg(F.sum("times").alias("times"), F.max(F.struct("times", "cls")).alias("main"), F.count(F.lit(1)).alias("classes"), F.max("some").alias("some"))
        shared = shared.filter("classes > 1 AND some").select("t", "low", "times", F.col("main.cls").alias("main"))
    total = shared.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-total // (TABLES * CAP)))
    shared = shared.withColumn("shard", F.pmod(F.xxhash64("low"), F.lit(shards)).cast("int"))
    sizes = shared.groupBy("t", "shard").agg((F.sum("times") > 2 * CAP).alias("large"))
    shared = shared.join(sizes, ["t", "shard"])
    rows = split_join(rows, shared, ["t", "low"], "times", "id", total)
    rows = rows.withColumn("main", F.lit(False) if classes is None else F.col("cls") == F.col("main"))
    # sets of similarity SIMILAR lie in the same class or in neighbours, whatever the logarithm's last bit
    rows = work_table(rows.withColumn("g", F.when(F.col("large"), F.floor(F.log("n") / F.lit(-1.001 * math.log(SIMILAR)))).otherwise(0).cast("int")), "shard-rows")
    classes_of = rows.filter("large").groupBy("t", "shard", "g").agg((F.floor((F.count(F.lit(1)) - 1) / F.lit(2 * CAP)) + 1).cast("int").alias("blocks"))
    classes_of = classes_of.groupBy("t", "shard").agg(F.map_from_entries(F.collect_list(F.struct("g", "blocks"))).alias("blocks"))
    cells = rows.join(classes_of, ["t", "shard"], "left")
    blocks = lambda step: F.coalesce(F.try_element_at("blocks", F.col("g") + step), F.lit(0 if step else 1))
    cells = cells.withColumn("own", blocks(0)).withColumn("below", blocks(-1)).withColumn("above", blocks(1)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    # a cell is block j of the graph class and block i of the query class; role 0: graph, 1: query, 2: both
    cell = lambda first, last, what: f"CASE WHEN {first} <= {last} THEN transform(sequence({first}, {last}), k -> named_struct({what})) ELSE array() END"
    ways = [
        cell("block", "own - 1", "'gg', g, 'gq', g, 'i', k, 'j', block, 'role', if(k = block, 2, 0)"),
        cell("0", "block - 1", "'gg', g, 'gq', g, 'i', block, 'j', k, 'role', 1"),
        cell("0", "below - 1", "'gg', g, 'gq', g - 1, 'i', k, 'j', block, 'role', 0"),
        cell("0", "above - 1", "'gg', g + 1, 'gq', g, 'i', block, 'j', k, 'role', 1"),
    ]
    key = ["t", "shard", "gg", "gq", "i", "j"]
    every = cells.withColumn("cell", F.explode(F.expr(f"concat({', '.join(ways)})"))).select("t", "shard", "cell.*", "id", "n", "sim_a", "sim_b", "odd", "low", "cls", "ask", "main")
    # a number of its own: small in bytes, long in work, so not to be coalesced
    every = every.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    out = every.groupBy(*key).applyInArrow(_search(limit, beam), "a long, b long, more boolean, truth long, found long")
    out.work_path, out.rows = rows.work_path, rows
    return out


def _similar(u: np.ndarray, v: np.ndarray) -> bool:
    if len(u) > len(v):
        u, v = v, u
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    same = int((v[at] == u).sum())
    return same >= SIMILAR * (len(u) + len(v) - same) - 1e-9


def _verify(texts: pa.Table, edges: pa.Table) -> pa.Table:
    sets: dict[int, list[np.ndarray]] = {}  # rows of one id are one document: any of its texts may make the link
    if texts.num_rows:
        texts = texts.combine_chunks()
        ids = texts.column("id").to_numpy().tolist()
        for part in texts.column("text").chunks:
            for row, data, offs in chunks(unpacked(part)):
                doc, g = shingles(data, offs)
                cut = np.searchsorted(doc, np.arange(len(offs)))
                for k in range(len(offs) - 1):
                    own, new = sets.setdefault(ids[row + k], []), distinct(g[cut[k] : cut[k + 1]])
                    if len(new) and not any(np.array_equal(x, new) for x in own):
                        own.append(new)
    a, b = edges.column("a").to_numpy(), edges.column("b").to_numpy()
    good = np.array([any(_similar(u, v) for u in sets[x] for v in sets[y]) for x, y in zip(a.tolist(), b.tolist())], bool)
    return pa.table({"a": a[good], "b": b[good]})


def _among(text: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of text whose id is in need, and some others: those whose hash falls on a bit that an id in need has set. Spares most texts the way to a join that drops them.
    The bits are MARKS (4 MB) at any size of the tables; the more ids there are, the more others stay."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    group, bit = F.floor(mark / 32768).cast("int").alias("map"), (mark % 32768).alias("bit")
    maps = need.select(group, bit).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = text.select("*", group, bit).join(F.broadcast(maps), "map")
    return out.filter("shiftright(conv(hex(substring(bits, int(bit div 8) + 1, 1)), 16, 10)::int, int(bit % 8)) % 2 = 1").select(*text.columns)


def verified(text: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a similarity of at least SIMILAR; text has id, text."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    comp = components(pairs)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = comp.count()
    buckets = max(1, -(-total // GROUP))
    part = lambda c: F.pmod(F.xxhash64(F.lit(5), c), F.col("parts")).cast("int")
    size = size.select("component", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int").alias("bucket"), F.floor((F.col("size") - 1) / F.lit(2 * GROUP) + 1).cast("int").alias("parts"))
    e = pairs.join(comp.withColumnRenamed("id", "a"), "a").join(size, "component").withColumn("x", part("a")).withColumn("y", part("b"))
    e = e.select("bucket", F.when(F.col("parts") > 1, F.col("component")).otherwise(F.lit(-1)).alias("c"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b")
    e = work_table(e, "edges-by-cell")
    # a text goes where it has an edge: to no more cells than its candidates are
    key = ["bucket", "c", "i", "j"]
    need = e.select(*key, F.explode(F.array("a", "b")).alias("id")).distinct()
    # never broadcast: with more documents it would be the other join
    t = packed(_among(text, need), "text").join(need.hint("merge"), "id").select(*key, "id", "text")
    e2 = e.select(*[F.col(k).alias(f"e_{k}") for k in key], "a", "b")  # other names: both sides come from one table
    links = work_table(t.groupBy(*key).cogroup(e2.groupBy(*[f"e_{k}" for k in key])).applyInArrow(_verify, "a long, b long"), "links")
    release(comp, e)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, class_id, graph_recall) of each row, and the audit: audited pairs within the radius and how many of them the graphs found, over all shards."""
    spark = docs.sparkSession
    kept = keep_columns(docs, id_col, text_col)
    text = kept.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = work_table(text.mapInArrow(_fingerprints, "id long, n long, set_a long, set_b long, sim_a long, sim_b long, low array<bigint>, odd binary"), "fingerprints")
    key = ["set_a", "set_b", "n"]
    sets = prints.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sim_a").alias("sim_a"), F.first("sim_b").alias("sim_b"), F.first("low").alias("low"), F.first("odd").alias("odd"))
    sets = work_table(sets, "shingle-sets")
    total = prints.count()
    nodes = sets.select(F.col("rep").alias("id"), "n", "sim_a", "sim_b", "low", "odd")
    beam = BEAM
    while True:
        found = candidates(nodes, None, NEAREST, beam=beam)
        first = work_table(found, "candidates")
        seen = first.filter("a = 0 AND b = 0").agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("truth"), F.coalesce(F.sum("found"), F.lit(0)).alias("found")).first()
        log.warning("graph recall with beams from %d: %d of %d audited pairs within the radius", beam, seen.found, seen.truth)
        if seen.found >= RECALL * seen.truth or beam >= 2 * CAP:
            break
        release(first, found)
        beam *= 4
    pairs = work_table(first.filter("a != b").select("a", "b").distinct(), "pairs")
    links = all_links = verified(text, pairs)
    more = rest = None
    ask = first.filter("more").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ask.limit(1).count():
        classes = components(links)
        again = candidates(found.rows, classes, None, ask, beam)
        rest = work_table(again.filter("a != b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        release(again)
        more = verified(text, rest)
        all_links = links.unionByName(more)
        release(classes)
    release(found)
    # a document of several texts joins their sets
    several = prints.groupBy("id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).filter("x != y").select("id")
    own = prints.join(several, "id").select("id", *key).join(sets.select(*key, "rep"), key).select("id", "rep")
    own = own.groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("b")).select("a", F.explode("b").alias("b"))
    comp = components(all_links.unionByName(own))
    classes = sets.select(*key, "rep", "copies").join(comp.groupBy("id").agg(F.min("component").alias("component")).withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select(*key, "copies", F.coalesce("component", "rep").alias("component"))
    members = split_join(prints.select("id", *key), classes, key, "copies", "id", total).groupBy("id").agg(F.min("component").alias("component"))
    members = work_table(members, "members")
    release(prints, sets, first, pairs, links, rest, more, comp)
    out = kept.select(F.col(id_col)).join(members, F.col(id_col).cast("long") == F.col("id"), "left")
    recall = float(seen.found / seen.truth) if seen.truth else 1.0
    out = out.select(id_col, F.coalesce("component", F.col(id_col).cast("long")).alias("class_id"), F.lit(recall).alias("graph_recall"))
    return out, spark.createDataFrame([(int(seen.truth), int(seen.found))], "truth long, found long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose class has an earlier document."""
    classes, _ = near_duplicates(docs, id_col, text_col)
    drop = classes.filter(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("__drop")).distinct()
    where = [i for i, c in enumerate(docs.columns) if c == id_col][0]
    flat = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return flat.join(drop, flat[f"_{where}"] == F.col("__drop"), "left_anti").toDF(*docs.columns)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0]
