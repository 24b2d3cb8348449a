"""Pieces that several corpus operators share: work tables, word spans and word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Separators of words: space and the ASCII controls 9 to 13. Every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a session in one local process may go without; it gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="velotrace-")
        folder = _LOCAL[app]
    return folder.rstrip("/")


def work_table(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/velotrace/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes work tables that no plan reads any more."""
    for t in tables:
        path = getattr(t, "work_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def split_join(rows: DataFrame, groups: DataFrame, key: list[str], times: str, spread: str, total: int, each: int = 100_000) -> DataFrame:
    """rows joined with groups, which has one row a key and counts the key's rows in `times`; the rows of a hot key are spread over several tasks.

    Hot are keys of over `each` rows and over a thousandth of all, so at most a thousand: that bounds what is broadcast."""
    most = max(each, total // 1000)
    parts = F.when(F.col(times) > most, F.ceil(F.col(times) / most)).otherwise(1).cast("int")
    hot = groups.filter(F.col(times) > most).select(*key, parts.alias("_parts"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.join(groups, [*key, "_salt"]).drop("_salt")


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, by exact position, so that extra columns with clashing names do no harm."""
    picked = []
    for name in names:
        at = [i for i, c in enumerate(df.columns) if c == name]
        if not at:
            raise ValueError(f"no column {name}")
        picked.append(at[0])
    if len(set(df.columns)) == len(df.columns):
        return df.select(*[df[f"`{n}`"] for n in names])
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"_{i}"].alias(n) for i, n in zip(picked, names)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """df with its text as zstd-compressed bytes, for texts that only Python reads after a shuffle: about a third less to move than by the shuffle's own codec."""
    at, names = df.columns.index(text_col), df.columns

    def work(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                small = pa.array([None if t is None else press.compress(t.encode()) for t in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([small if i == at else part.column(i) for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    kinds = ", ".join(f"c{i} {'binary' if i == at else f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    return df.mapInArrow(work, kinds).toDF(*names)


def unpacked(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of packed texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else press.decompress(t) for t in column.to_pylist()], pa.binary())


def parts(batches, size: int, columns: int):
    """Batches in slices of so many rows at most, where their texts are unpacked from column `columns`."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            yield part, unpacked(part.column(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(seed: int, n: int, odd: bool = True) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 7919))
    return out | U(1) if odd else out


BYTE = constants(1, 256, odd=False)
_place = constants(2, 4096)
GRAM = constants(3, 64)


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting alone, several times faster on integers than by its hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = constants(2, n * 2)
    return _place


def chunks(column: pa.Array, size: int = CHUNK):
    """(first row, data bytes, document offsets) of runs of rows of about size bytes; nulls are empty texts."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        end = min(end, n, row + 65_535)
        yield row, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the end) of all words; words never cross documents."""
    ns = ~SEP[data]
    first, last = ns.copy(), ns.copy()
    first[1:] &= ~ns[:-1]
    last[:-1] &= ~ns[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = ns[inner]
    last[inner - 1] = ns[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and their places."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    at = pos + np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(BYTE[data[at]] * places(int(lens.max()))[pos], begin) + lens.astype(U))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k-word windows that start at each word but the last k - 1 (windows over ends of documents included)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * GRAM[j + seed]
    return mix(out)


def starts_of(wfirst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, word index) of each k-word window that lies in one document."""
    n = np.maximum(np.diff(wfirst) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(wfirst[:-1], n)
    return doc, at


def joined(data: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None, starts=None, ends=None, wfirst=None) -> list[bytes]:
    """Per document its (kept) words joined by one space."""
    if starts is None:
        starts, ends, wfirst = spans(data, offs)
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
        wfirst = np.concatenate([[0], np.cumsum(keep)])[wfirst]
    lens = ends - starts + 1
    total = int(lens.sum())
    begin = np.cumsum(lens) - lens
    src = np.arange(total) - np.repeat(begin - starts, lens)
    out = data[np.minimum(src, max(len(data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[begin + lens - 1] = 32
    cut = np.concatenate([begin, [total]])[wfirst]
    view = out.tobytes()
    return [view[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
