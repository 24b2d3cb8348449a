"""Sinks: JSON documents and FIT files, one per activity. An activity is bounded by the 100 MB gate, so its points fit one row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_time, scaled_round
from ..operators.summary import writer_stats
from ..operators.tracks import with_backfill, with_odometer, with_steps
from ..sources.fitcodec import POINT_FIELDS, encode_fields, record_fields

#: Small files go to Spark together, up to about this size.
BATCH_BYTES = 1 << 20


def point_json(points: DataFrame) -> DataFrame:
    """activity_id, seq and point, a struct whose null fields to_json leaves out."""
    p = with_backfill(with_steps(points))
    return p.select("activity_id", "seq", F.struct(
        scaled_round(F.col("lat"), 6).alias("lat"), scaled_round(F.col("lon"), 6).alias("lon"), scaled_round(F.coalesce("elevation", F.lit(0.0)), 1).alias("elevation"), F.col("speed_shown").alias("speed"),
        F.col("heart_rate").alias("heartRate"), "power", "cadence", "temperature", iso_time(F.col("t_fit")).alias("timestamp"),
    ).alias("point"))


def ride_json(points: DataFrame, summary: DataFrame) -> DataFrame:
    """activity_id and json: coordinates in order, and the summary; means have one decimal."""
    c = point_json(points).groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("seq", "point"))).alias("all"))
    means = {"avgHeartRate", "avgPower", "avgCadence", "avgSpeed"}
    s = F.struct(*[(scaled_round(F.col(n), 1).alias(n) if n in means else F.col(n)) for n in summary.columns if n != "activity_id"])
    j = summary.select("activity_id", s.alias("summary")).join(c, "activity_id", "left")
    coords = F.coalesce(F.transform("all", lambda x: x["point"]), F.array().cast(c.select(F.transform("all", lambda x: x["point"])).schema[0].dataType))
    return j.select("activity_id", F.to_json(F.struct(coords.alias("coordinates"), "summary")).alias("json"))


def fit_files(points: DataFrame) -> DataFrame:
    """activity_id and fit, the bytes of an activity file."""
    p = with_odometer(with_steps(points))
    keep = ["seq", "lat", "lon", "elevation", "t_fit", "heart_rate", "cadence", "power", "temperature", "speed_sensor_ms", "cum_dist_m"]
    rows = writer_stats(p, F.sort_array(F.collect_list(F.struct(*keep))).alias("points"))
    rows = rows.select("activity_id", "points", F.struct(*[c for c in rows.columns if c not in ("activity_id", "points")]).alias("stats"))

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, cut = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fields = record_fields({c: flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in POINT_FIELDS})
            stats = batch.column(2).to_pylist()
            begin, made, size = 0, [], 0
            for k in range(batch.num_rows):
                made.append(encode_fields([(n, b, v[cut[k] : cut[k + 1]], ok[cut[k] : cut[k + 1]]) for n, b, v, ok in fields], stats[k]))
                size += len(made[-1])
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(made)), pa.array(made, pa.binary())], ["activity_id", "fit"])
                    begin, made, size = k + 1, [], 0

    return rows.mapInArrow(work, "activity_id string, fit binary")


def write_files(df: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes each row's second column as a file of its own, at once; returns activity_id and path. The folder is a path or URL that all executors reach
    (any file system pyarrow knows). Files are put in place by a rename, so that a retried task does no harm; the list of them is a table in the folder."""

    def work(batches):
        import hashlib
        import os
        import posixpath
        import uuid

        from pyarrow import fs

        if "://" in folder or folder.startswith("file:"):
            system, root = fs.FileSystem.from_uri(folder)
        else:
            system, root = fs.LocalFileSystem(), os.path.abspath(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stem = posixpath.splitext(posixpath.basename(key))[0] + "-" + hashlib.sha256(key.encode()).hexdigest()[:12]
                part = f"{root}/.{stem}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(value if isinstance(value, bytes) else value.encode())
                system.move(part, f"{root}/{stem}{suffix}")
                names.append(f"{root}/{stem}{suffix}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["activity_id", "path"])

    written = f"{folder.rstrip('/')}/_written"
    df.mapInArrow(work, "activity_id string, path string").write.mode("overwrite").parquet(written)
    return df.sparkSession.read.schema("activity_id string, path string").parquet(written)
