"""Substring dedup by recompression: words in repeated 20-word windows are removed, but for each window's first occurrence.

Symbols. A text is a string of symbols: at first each run of an equal word is one, then ROUNDS rounds of pairs follow, in each of which a symbol of the
left half of the alphabet joins one of the right half after it. Which half a symbol is in changes by the round. A symbol's name comes from the names of
its parts alone, so all tasks give equal runs and pairs the same name, everywhere. Each symbol also carries the words that decided that it is there: its
own, and those of neighbours that it could have joined instead. Where these words repeat, so does the symbol. So the longest symbol whose deciding words
all lie in a window (ties: the greatest name) is the same in all equal windows; it stands for the window. A window inside one long run has no such
symbol and stands for itself.

Rounds over Spark: 1. The names of the symbols that stand for windows are counted globally; what only one place holds can't be in a repeat. 2. The
windows of shared symbols meet by name, as rows of words, one for each stretch of windows with the same symbol. Equal words (compared byte by byte)
in an earlier place make a repeat. 3. Each text is cut. What a batch can settle by itself it settles: repeats within it are found at once, and of each
name one row leaves it. So a passage that a third of all documents hold sends one row a batch.

Defined results: null and empty texts have no words; a null doc_id is passed on unchanged and is nobody's earlier document; rows of one doc_id are
one document at the same places, and don't remove each other's words; an empty table gives none; extra columns are kept where text is returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U, chunks, constants, gram_hashes, joined, keep_columns, mix, packed, parts, spans, starts_of, table, unpacked, word_hashes

WINDOW, ROUNDS, LONGEST = 20, 4, 12
PLACE = U(31)
_PAIR = constants(9, 3 + ROUNDS)


def symbols(h: np.ndarray, wfirst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last + 1 of the words that decide it, number of its words, name) of every symbol that any round makes. Texts don't join."""
    n = len(h)
    edge = np.zeros(n + 1, bool)
    edge[wfirst] = True
    with np.errstate(over="ignore"):
        new = edge[:n].copy()
        new[:1] = True
        new[1:] |= h[1:] != h[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        name = mix(h[at] * _PAIR[0] + size.astype(U))
        lo, hi = at - 1, at + size + 1  # a run ends where other words are
        made = [(lo, hi, size, name)]
        for turn in range(ROUNDS):
            left = mix(name ^ _PAIR[3 + turn]) & U(1) == 0
            k = np.flatnonzero(left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= LONGEST) & ~edge[at[1:]])
            pair = np.minimum(lo[k], lo[k + 1]), np.maximum(hi[k], hi[k + 1]), size[k] + size[k + 1], mix(name[k] * _PAIR[1] + name[k + 1] * _PAIR[2])
            made.append(pair)
            # one that stays alone is decided by the neighbour that it could have joined, too
            low, high = lo.copy(), hi.copy()
            i = np.flatnonzero(left[:-1])
            low[i], high[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
            i = np.flatnonzero(~left[1:]) + 1
            low[i], high[i] = np.minimum(lo[i], lo[i - 1]), np.maximum(hi[i], hi[i - 1])
            lo, hi, size, name = low, high, size.copy(), name.copy()
            lo[k], hi[k], size[k], name[k] = pair
            stay = np.ones(len(at), bool)
            stay[k + 1] = False
            at, lo, hi, size, name = at[stay], lo[stay], hi[stay], size[stay], name[stay]
    return tuple(np.concatenate(x) for x in zip(*made))


def _best(score: np.ndarray, first: np.ndarray, turns: list[np.ndarray], n: int) -> np.ndarray:
    """The greatest score of the symbols of each window, by its first word. turns[m]: the symbols that lie in m windows, from `first` on."""
    out = np.zeros(n + 2 * WINDOW, U)
    for m in range(len(turns) - 1, 0, -1):
        np.maximum.at(out, first[turns[m]] + WINDOW, score[turns[m]])
        if m > 1:  # what holds in m windows from here on holds in m - 1 from here, and from the next
            out[1:] = np.maximum(out[1:], out[:-1])
    return out[WINDOW : WINDOW + n]


def places(h: np.ndarray, wfirst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, name of the symbol that stands for it, whether to count the symbol anew: the window before has another, or the window holds it twice) of each window."""
    doc, at = starts_of(wfirst, WINDOW)
    if not len(at):
        return doc, at, np.zeros(0, U), np.zeros(0, bool)
    lo, hi, size, name = symbols(h, wfirst)
    fits = hi - lo <= WINDOW
    lo, hi, size, name = lo[fits], hi[fits], size[fits], name[fits]
    turns = [np.flatnonzero(hi - lo == WINDOW + 1 - m) for m in range(WINDOW - 1)]
    # the last five bits tell places of one name apart, which a window may hold
    score = size.astype(U) << U(59) | (name >> U(10)) << U(5)
    place = ((lo + WINDOW) & 31).astype(U)
    key = _best(score | place, hi - WINDOW, turns, len(h))[at]
    other = _best(score | (PLACE - place), hi - WINDOW, turns, len(h))[at]
    none = key == 0
    many = ((key ^ other) != PLACE) & ~none
    new = np.ones(len(at), bool)
    if none.any():
        key[none] = gram_hashes(h, WINDOW, 20)[at[none]] >> U(10) << U(5)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | many[1:] | none[1:]
    return doc, at, key | PLACE, new


def _names(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        docs, keys = [], []
        for row, data, offs in chunks(batch.column(1)):
            starts, ends, wfirst = spans(data, offs)
            doc, at, key, new = places(word_hashes(data, starts, ends), wfirst)
            if len(at):
                docs.append(ids[row + doc[new]])
                keys.append(key[new])
        if not keys:
            continue
        doc, key = np.concatenate(docs), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        doc, key = doc[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        alone = first & np.append(first[1:], True)
        own = ~alone  # known to repeat
        own[1:] &= first[1:] | (doc[1:] != doc[:-1])
        part = np.concatenate([key[first], mix(key[own] ^ mix(doc[own].view(U)))])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.view(np.int64)),
                pa.array(np.concatenate([doc[first], doc[own]]), mask=np.concatenate([~alone[first], np.zeros(int(own.sum()), bool)])),
                pa.array(np.concatenate([key[first], key[own]]).view(np.int64), mask=np.concatenate([np.ones(int(first.sum()), bool), np.zeros(int(own.sum()), bool)])),
            ],
            ["part", "doc", "own"],
        )


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the n bytes at a and at b are the same. Compares about `most` bytes at a time, which take some forty times their size in memory."""
    out = np.ones(len(a), bool)
    end = np.cumsum(n)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - n[lo] + most, "right")))
        size = n[lo:hi]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        if len(step):
            out[lo:hi] = np.logical_and.reduceat(buf[np.repeat(a[lo:hi], size) + step] == buf[np.repeat(b[lo:hi], size) + step], begin)
        lo = hi
    return out


def _late(key, gram, doc, start, buf, a, size) -> tuple[np.ndarray, np.ndarray]:
    """Of windows by symbol, hash, document, first word and bytes: which have the words of an earlier one, and which are the first of their words."""
    order = np.lexsort((start, doc, gram, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    first, late = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = ~same
    d, s = doc[order], start[order]
    after = (d > doc[head]) | (s > start[head])
    i, j = order[after], head[after]
    even = size[i] == size[j]
    i, j = i[even], j[even]
    late[i[_equal(buf, a[i], a[j], size[i])]] = True
    return late, first


def _runs(doc, start, *same) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, number) of windows that follow each other in one document with the same other values."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(doc)))


def _windows(batches):
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
        batch = batch.take(pa.array(order))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        known = batch.column(2)
        flat = known.flatten().to_numpy(zero_copy_only=False).view(U)
        counts = np.diff(known.offsets.to_numpy())
        with np.errstate(over="ignore"):
            wanted = np.unique(mix(flat + mix(np.repeat(np.arange(len(counts)), counts).astype(U))))
        out, bufs, total = [], [], 0
        for row, data, offs in chunks(unpacked(batch.column(1))):
            starts, ends, wfirst = spans(data, offs)
            h = word_hashes(data, starts, ends)
            doc, at, key, _ = places(h, wfirst)
            if not len(at):
                continue
            with np.errstate(over="ignore"):
                code = mix(key + mix((row + doc).astype(U)))
            slot = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
            yes = np.flatnonzero(wanted[slot] == code) if len(wanted) else np.zeros(0, int)
            if len(yes):
                text, begin = _words(data, starts, ends)
                at = at[yes]
                a = begin[at]
                out.append((ids[row + doc[yes]], at - wfirst[doc[yes]], key[yes], gram_hashes(h, WINDOW, 20)[at], a + total, begin[at + WINDOW] - 1 - a, row + doc[yes]))
                bufs.append(text)
                total += len(text)
        if not out:
            continue
        doc, start, key, gram, a, size, row = (np.concatenate(x) for x in zip(*out))
        buf = np.concatenate(bufs)
        late, _ = _late(key, gram, doc, start, buf, a, size)
        # known repeats, as ranges of starts without words
        i, n = _runs(row[late], start[late])
        d, s = doc[late][i], start[late][i]
        left = np.flatnonzero(~late)
        j, m = _runs(row[left], start[left], key[left])
        view = buf.tobytes()
        texts = [view[x:y] for x, y in zip(a[left[j]].tolist(), (a + size)[left[j + m - 1]].tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[left[j]].view(np.int64), mix(d.view(U) ^ mix(s.astype(U))).view(np.int64)])),
                pa.array(np.concatenate([doc[left[j]], d])),
                pa.array(np.concatenate([start[left[j]], s]).astype(np.int32)),
                pa.array(np.concatenate([m, n]).astype(np.int32)),
                pa.array(texts + [None] * len(d), pa.binary()),
            ],
            ["key", "doc", "start", "n", "words"],
        )


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words with a space after each, where each begins, and the end)."""
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    out = data[np.minimum(np.arange(int(size.sum())) + np.repeat(starts - begin, size), len(data) - 1)]
    out[begin + size - 1] = 32
    return out, np.append(begin, len(out))


def _settle(batches):
    """Rows sorted by key, doc, start; the first occurrences of the last key's windows go on to the next batch."""
    carry = None
    for whole in batches:
        for lo in range(0, whole.num_rows, 8192):
            batch = whole.slice(lo, 8192)
            open_ = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            doc, start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            found = [(doc[~open_], start[~open_], n[~open_])]
            rows = batch.filter(pa.array(open_))
            if rows.num_rows:
                old = 0 if carry is None else carry.num_rows
                rows = pa.Table.from_batches([rows] if carry is None else [carry, rows]).combine_chunks().to_batches()[0]
                key, doc, start = rows.column(0).to_numpy().view(U), rows.column(1).to_numpy(), rows.column(2).to_numpy()
                _, data, offs = next(chunks(rows.column(4), 1 << 40))
                starts, ends, wfirst = spans(data, offs)
                row, at = starts_of(wfirst, WINDOW)
                a, s = starts[at], start[row] + at - wfirst[row]
                late, first = _late(key[row], gram_hashes(word_hashes(data, starts, ends), WINDOW, 20)[at], doc[row], s, data, a, ends[at + WINDOW - 1] - a)
                new = late & (row >= old)
                i, m = _runs(row[new], s[new])
                found.append((doc[row[new]][i], s[new][i], m))
                keep = np.unique(row[first])
                carry = rows.take(pa.array(keep[key[keep] == key[-1]]))
            d, s, m = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))], ["doc", "start", "n"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc, cut: the ranges (start, n) of removed windows of each document that has any."""
    text = keep_columns(docs, id_col, text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    text = text.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    seen = text.mapInArrow(_names, "part long, doc long, own long")
    seen = seen.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("part")))
    hits = seen.filter("doc IS NOT NULL AND (own IS NOT NULL OR times > 1)").groupBy("doc").agg(F.collect_set(F.coalesce("own", "part")).alias("keys"))
    found = packed(text, "text").join(hits, "doc").select("doc", "text", "keys").mapInArrow(_windows, "key long, doc long, start int, n int, words binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(partitions, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_settle, "doc long, start int, n int")
    return found.select("doc", F.struct("start", "n").alias("cut")).groupBy("doc").agg(F.collect_list("cut").alias("cut"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: str = "digests") -> DataFrame:
    """outputs "digests": id, n_words, n_removed, kept_sha256. outputs "text": the columns of docs, where a text that lost words is its kept words joined by spaces."""
    cut = repeats(docs, id_col, text_col).withColumnRenamed("doc", "__doc").withColumnRenamed("cut", "__cut")
    digests = outputs == "digests"
    base = keep_columns(docs, id_col, text_col) if digests else docs
    names = base.columns
    base = packed(base, text_col)
    rows = base.join(cut, F.col(id_col).cast("long") == F.col("__doc"), "left").select(*[base[f"`{n}`"] for n in names], "__cut")
    ti, ii = names.index(text_col), names.index(id_col)

    def work(batches):
        for batch, texts in parts(batches, 2048, ti):
            cuts = batch.column(len(names))
            for row, data, offs in chunks(texts):
                n = len(offs) - 1
                starts, ends, wfirst = spans(data, offs)
                own = cuts.slice(row, n)
                counts = np.diff(own.offsets.to_numpy())
                keep = np.ones(len(starts), bool)
                if counts.sum():
                    flat = own.flatten()
                    doc = np.repeat(np.arange(n), counts)
                    a = flat.field("start").to_numpy() + wfirst[doc]
                    depth = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, a + flat.field("n").to_numpy() + WINDOW - 1, -1)
                    keep = np.cumsum(depth)[:-1] == 0
                kept = joined(data, offs, keep, starts, ends, wfirst)
                removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[wfirst])
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(ii).slice(row, n), pa.array(np.diff(wfirst)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["id", "n_words", "n_removed", "kept_sha256"]
                    )
                else:
                    part = batch.slice(row, n)
                    old = texts.slice(row, n).to_pylist()
                    new = pa.array([k.decode() if r else o if o is None else o.decode() for k, r, o in zip(kept, removed.tolist(), old)], pa.string())
                    yield pa.RecordBatch.from_arrays([new if i == ti else part.column(i) for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    # arrow lists of nulls have no length; null cuts are empty
    rows = rows.withColumn("__cut", F.coalesce("__cut", F.expr("cast(array() AS array<struct<start:int,n:int>>)")))
    if digests:
        kind = dict(base.dtypes)[id_col]
        return rows.mapInArrow(work, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
    kinds = ", ".join(f"c{i} {'string' if i == ti else f.dataType.simpleString()}" for i, f in enumerate(base.schema.fields))
    return rows.mapInArrow(work, kinds).toDF(*names)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
gone AS (SELECT doc_id, list_distinct(list_concat(list(i), flatten(list([i + 1, i + 2, i + 3, i + 4, i + 5, i + 6, i + 7, i + 8, i + 9, i + 10, i + 11, i + 12, i + 13, i + 14, i + 15, i + 16, i + 17, i + 18, i + 19])))) AS p FROM late GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, gone.p FROM d LEFT JOIN gone USING (doc_id)),
u AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
v AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN (SELECT doc_id, unnest(p) AS i FROM gone) z ON u.doc_id = z.doc_id AND u.i = z.i WHERE z.i IS NULL GROUP BY u.doc_id)
SELECT k.doc_id, len(k.w)::BIGINT AS n_words, coalesce(len(k.p), 0)::BIGINT AS n_removed, sha256(coalesce(v.kept, '')) AS kept_sha256 FROM k LEFT JOIN v ON k.doc_id = v.doc_id
"""
