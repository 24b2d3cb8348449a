"""Language identification by error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per bit predicts its bit from hashed byte n-grams of the text's letters. A document goes to
the language whose codeword has the least loss, the bits being weighted by how well their classifiers do in training; where the runner-up is close,
the row is flagged as ambiguous.

Training: every language that has a labelled row is learned, from its first `per_lang` different rows in the order of a hash of doc_id and text; rows
without doc_id count too, equal rows once. Their n-gram counts, not texts, come to the driver. Where languages are many, each has fewer rows, so that
about `rows_most` rows in all are learned from, but at least one a language. Prediction reads every whole text.

Defined results: null text and text without a letter are `und` with score 0; ties fall to the smaller language; without training rows all is
`und`; repeated rows give equal rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, keep_columns, table

DIM, PER_LANG, ROWS_MOST = 4096, 300, 300 * 64
#: Rows whose counts are held at once: 8 MB.
SLICE = 256
AMBIGUOUS = 0.6
LETTER = np.full(256, 32, np.uint8)
for _b in range(256):
    if 65 <= _b <= 90 or 97 <= _b <= 122:
        LETTER[_b] = _b | 32
    elif _b >= 128:
        LETTER[_b] = _b


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per document the root shares of its hashed pairs and triples of bytes; all else than letters reads as a space."""
    b = LETTER[data].astype(np.int64)
    if len(b) > 1:  # upper-case letters of the Latin-1 range
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        b[1:][up] += 32
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    counts = np.zeros(n * DIM)
    for k in (2, 3):
        if len(b) < k:
            continue
        code = b[: len(b) - k + 1].copy()
        for j in range(1, k):
            code = code << 8 | b[j : len(b) - k + 1 + j]
        slot = ((code + k * 77777777) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
        inside = doc[: len(slot)] == doc[k - 1 :]
        counts += np.bincount((doc[: len(slot)] * DIM + slot)[inside], minlength=n * DIM)
    x = np.sqrt(counts.reshape(n, DIM))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def feature_slices(column: pa.Array):
    """(first row, features) of at most SLICE rows at a time."""
    for row, data, offs in chunks(column):
        for lo in range(0, len(offs) - 1, SLICE):
            part = offs[lo : lo + SLICE + 1]
            yield row + lo, features(data[part[0] : part[-1]], part - part[0])


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to five languages, else the best spread of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols).T.astype(float)
    bits, best, far = int(np.ceil(10 * np.log2(n))), None, 0
    tries = max(1, 200 * 64**2 // max(n, 64) ** 2)  # comparing all pairs grows with the square
    for seed in itertools.count():
        if seed >= tries and best is not None:
            return best
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        near = bits
        for lo in range(0, n, 512):
            part = code[lo : lo + 512]
            alike = (part @ code[: lo + len(part)].T)[np.tri(len(part), lo + len(part), lo - 1, dtype=bool)]  # of pairs, each once
            near = min(near, int(bits - alike.max(initial=-bits)) // 2)
        if near > far:
            best, far = code, near


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], rounds: int = 150, rate: float = 20.0, decay: float = 1e-5) -> dict:
    """One logistic classifier a bit, by gradient steps with momentum; bit weights from training accuracy."""
    code = codewords(len(langs))
    want = code[y].astype(np.float32)
    w, v = np.zeros((x.shape[1], code.shape[1]), np.float32), 0.0
    bias, vb = np.zeros(code.shape[1], np.float32), 0.0
    count = np.bincount(y, minlength=len(langs))
    share = (1.0 / (len(langs) * count[y]))[:, None].astype(np.float32)
    for _ in range(rounds):
        pull = want * share / (1 + np.exp(np.clip((x @ w + bias) * want, -50, 50)))
        v = np.float32(0.9) * v + np.float32(rate) * (x.T @ pull - np.float32(decay) * w)
        vb = np.float32(0.9) * vb + np.float32(rate) * (pull.sum(0) - np.float32(decay) * bias)
        w, bias = w + v, bias + vb
    right = ((x @ w + bias) * want > 0).mean(0)
    weight = np.maximum(right - 0.5, 1e-3)
    w = np.vstack([w, bias])
    return {"w": w.astype(np.float32), "code": code, "bit": weight / weight.sum(), "langs": langs}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of each row: least weighted logistic loss over the codewords."""
    up, down = (np.logaddexp(0, z) * model["bit"] for z in (-margins, margins))
    loss = up @ (model["code"] > 0).T + down @ (model["code"] < 0).T
    loss = loss.round(9)  # ties are not left to rounding
    e = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
    p = e / e.sum(1, keepdims=True)
    best = loss.argmin(1)
    score = p[np.arange(len(p)), best]
    return best, score, score < AMBIGUOUS


def train(docs: DataFrame, rows, per_lang: int = PER_LANG, rows_most: int = ROWS_MOST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """docs has id, text, lang; rows is the condition for rows that may be learned from."""
    d = docs.filter(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = sorted(r[0] for r in d.select(lang_col).distinct().collect())
    if not langs:
        return None
    per_lang = max(1, min(per_lang, rows_most // len(langs)))
    d = d.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    # ranks of hashes alone; of each partition only the first few rows a language leave it
    ranked = d.select("lang", "h").withColumn("_rank", F.dense_rank().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.filter(F.col("_rank") <= per_lang).select("lang", "h").distinct()
    rows_ = d.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches):
        for batch in batches:
            for row, x in feature_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, len(x)), batch.column(2).slice(row, len(x)), pa.array(list(x), pa.list_(pa.float32()))], ["lang", "h", "x"])

    got = rows_.select("text", "lang", "h").mapInArrow(count, "lang string, h long, x array<float>").toArrow()
    h, names = got.column("h").to_numpy(), got.column("lang").to_numpy(zero_copy_only=False).astype(str)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    del got
    order = np.lexsort((h, names))
    number = {v: i for i, v in enumerate(langs)}
    return fit(x[order], np.array([number[v] for v in names[order]]), langs)


def identify(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """Per row: id, held_out, lang_pred, score, ambiguous. Only rows that aren't held out are learned from."""
    d = keep_columns(docs, id_col, text_col, lang_col)
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    model = train(d, ~held, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(d.dtypes)[id_col]

    def work(batches):
        m = shared.value
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            for row, x in feature_slices(batch.column(2)):
                n = len(x)
                some = letters[row : row + n].astype(bool)
                if m is None:
                    some = np.zeros(n, bool)
                    best, score, unsure = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
                else:
                    best, score, unsure = decode(x @ m["w"][:-1] + m["w"][-1], m)
                names = m["langs"] if m else ["und"]
                pred = [names[k] if s else "und" for k, s in zip(best, some)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(pred, pa.string()), pa.array(np.where(some, score, 0.0), pa.float64()), pa.array(unsure | ~some)],
                    [id_col, "held_out", "lang_pred", "score", "ambiguous"],
                )

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return d.select(id_col, held.alias("held_out"), text_col, letter.alias("letter")).mapInArrow(work, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return identify(table(spark, sf_dir, "documents"), held)
