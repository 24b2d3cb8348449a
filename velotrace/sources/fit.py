"""FIT files as one wide table of messages, from which points, sessions and file ids are projections."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ascii_only, degrees, fit_instant
from ..operators.summary import last_valid
from . import fitcodec as C

WIDE = (
    "activity_id string, kind string, seq long, t_fit long, lat_semi int, lon_semi int, elevation double, heart_rate short, cadence short, power int, temperature byte, "
    "manufacturer int, product int, product_name string, total_distance_m double, total_ascent_m double, total_descent_m double, max_speed_ms double, avg_speed_ms double, total_elapsed_s double, total_timer_s double, "
    "sport short, sub_sport short, error string"
)
_NAMES = [x.split()[0] for x in WIDE.split(", ")]
_KIND = {C.RECORD: "record", C.SESSION: "session", C.FILE_ID: "file_id"}
#: field number: column, scale, offset
_FIELDS = {
    C.RECORD: {253: ("t_fit", 1, 0), 0: ("lat_semi", 1, 0), 1: ("lon_semi", 1, 0), 2: ("elevation", 5, 500), 3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 7: ("power", 1, 0), 13: ("temperature", 1, 0)},
    C.SESSION: {9: ("total_distance_m", 100, 0), 22: ("total_ascent_m", 1, 0), 23: ("total_descent_m", 1, 0), 15: ("max_speed_ms", 1000, 0), 14: ("avg_speed_ms", 1000, 0), 7: ("total_elapsed_s", 1000, 0), 8: ("total_timer_s", 1000, 0), 5: ("sport", 1, 0), 6: ("sub_sport", 1, 0)},
    C.FILE_ID: {1: ("manufacturer", 1, 0), 2: ("product", 1, 0), 8: ("product_name", 1, 0)},
}
_FLOAT = {"elevation", "total_distance_m", "total_ascent_m", "total_descent_m", "max_speed_ms", "avg_speed_ms", "total_elapsed_s", "total_timer_s"}
#: The messages of small files go to Spark together, about so many at once.
BATCH_ROWS = 10_000
SESSION_FIELDS = [c for c, *_ in _FIELDS[C.SESSION].values()]


def read_messages(files: DataFrame, kinds: tuple[str, ...] = ("record", "session", "file_id")) -> DataFrame:
    """Messages of the given kinds, and one row of kind error for a file that can't be decoded."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = {n for n, k in _KIND.items() if k in kinds}
    shape = to_arrow_schema(_parse_datatype_string(WIDE))

    kinds_of = {f.name: f.type for f in shape}

    def error(path: str, e: Exception) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"activity_id": path, "kind": "error", "seq": 0, "error": f"Failed to decode: {e}"}], schema=shape)

    def table(path: str, number: int, seq: int, n: int, found: list[tuple[int, dict]]) -> pa.RecordBatch:
        """One batch of n messages of a kind, of runs that may have different fields."""
        cols = {"activity_id": pa.repeat(pa.scalar(path), n), "kind": pa.repeat(pa.scalar(_KIND[number]), n), "seq": pa.array(np.arange(seq, seq + n))}
        for num, (col, scale, offset) in _FIELDS[number].items():
            if kinds_of[col] == pa.string():
                cols[col] = pa.array([t or None for k, f in found for t in (f[num][0] if num in f and isinstance(f[num][0], list) else [None] * k)], pa.string())
                continue
            v = np.concatenate([f[num][0] if num in f and not isinstance(f[num][0], list) else np.zeros(k) for k, f in found])
            ok = np.concatenate([f[num][1] if num in f and not isinstance(f[num][0], list) else np.zeros(k, bool) for k, f in found])
            if col in _FLOAT:
                cols[col] = pa.array(v / scale - offset, pa.float64(), mask=~ok)
            else:
                ok = ok & (np.abs(v.astype(float)) < 2 ** (kinds_of[col].bit_width - 1))  # what the column can't hold is missing
                cols[col] = pa.array(np.where(ok, v, 0).astype(np.int64), mask=~ok).cast(kinds_of[col])
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in shape], schema=shape)

    def tables(path: str, data: bytes) -> list[pa.RecordBatch]:
        made, seq, held, count, last = [], 0, [], 0, None
        for number, n, fields in C.runs(data, wanted):
            if held and (number != last or count > 20_000):
                made.append(table(path, last, seq, count, held))
                seq, held, count = seq + count, [], 0
            held.append((n, fields))
            count, last = count + n, number
        if held:
            made.append(table(path, last, seq, count, held))
        return made

    def work(batches):
        held, rows = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                try:  # all of a file or nothing
                    made = tables(path, batch.column(1)[k].as_py())
                except (C.FitError, IndexError, ValueError, OverflowError, TypeError, struct.error, pa.ArrowInvalid) as e:
                    made = [error(path, e)]
                held += made
                rows += sum(m.num_rows for m in made)
                if rows > BATCH_ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return files.select("path", "content").mapInArrow(work, WIDE)


def points(messages: DataFrame) -> DataFrame:
    """Records with both positions; what else they lack is null."""
    p = messages.filter("kind = 'record' AND lat_semi IS NOT NULL AND lon_semi IS NOT NULL")
    t = F.coalesce("t_fit", F.lit(0)).cast("long")
    return p.select(
        "activity_id", "seq", degrees(F.col("lat_semi")).alias("lat"), degrees(F.col("lon_semi")).alias("lon"), "elevation", t.alias("t_fit"), fit_instant(t).alias("ts"),
        "heart_rate", "cadence", "power", "temperature", F.lit(None).cast("double").alias("speed_sensor_ms"), F.lit(None).cast("double").alias("src_distance_m"),
    )


def sessions(messages: DataFrame) -> DataFrame:
    return last_valid(messages.filter("kind = 'session'"), SESSION_FIELDS)


def file_ids(messages: DataFrame) -> DataFrame:
    f = messages.filter("kind = 'file_id'").withColumn("garmin_product", F.when(F.col("manufacturer").isin(*C.GARMIN), F.col("product")))
    return last_valid(f.withColumn("product_name", ascii_only(F.col("product_name"))), ["manufacturer", "garmin_product", "product_name"])


def errors(messages: DataFrame) -> DataFrame:
    return messages.filter("kind = 'error'").select(F.col("activity_id").alias("path"), F.col("error").alias("reason"))
