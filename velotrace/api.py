"""Whole jobs over files: parse, convert and trim many activities at once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import extension
from .operators import summary as S
from .operators import trim as R
from .operators.tracks import with_odometer, with_steps
from .sinks.documents import fit_files, ride_json, write_files
from .sources import files, fit, xml


class Rides:
    """points, session, file_id, activities and errors of a set of files. What was read from files is kept, so that each is decoded once; release() lets it go."""

    def __init__(self, points: DataFrame, session: DataFrame, file_id: DataFrame, activities: DataFrame, errors: DataFrame, kept: tuple[DataFrame, ...] = ()):
        self.points, self.session, self.file_id, self.activities, self.errors, self._kept = points, session, file_id, activities, errors, kept

    def totals(self) -> DataFrame:
        return S.ride_totals(with_odometer(with_steps(self.points)))

    def summary(self) -> DataFrame:
        return S.summarize(self.points, self.activities, self.session, self.file_id, odometer=True)

    def json(self) -> DataFrame:
        return ride_json(self.points, self.summary())

    def release(self) -> None:
        for t in self._kept:
            t.unpersist()


def read(spark: SparkSession, *paths: str, formats: tuple[str, ...] = files.FORMATS, strict: bool = False) -> Rides:
    """All readable files as one set of tables; the others are rows of errors, or an exception if strict. Session fields of GPX and TCX rides are their own totals."""
    found = files.scan(spark, *paths)
    points, errors, names, kept = [], [files.rejected(found), files.empty(spark, *paths)], [], []
    msgs = fit.read_messages(files.accepted(found, ".fit")).persist(StorageLevel.DISK_ONLY)
    kept.append(msgs)
    if ".fit" in formats:
        points.append(fit.points(msgs))
        errors.append(fit.errors(msgs))
        good = msgs.filter("kind <> 'error'").select("activity_id").distinct()
        names.append(good.select("activity_id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("own_session")))
    for ext, root, schema, to_points, to_names in ((".gpx", "gpx", xml.GPX, xml.gpx_points, xml.gpx_names), (".tcx", "TrainingCenterDatabase", xml.TCX, xml.tcx_points, xml.tcx_names)):
        if ext in formats:
            docs = xml.documents(files.accepted(found, ext), root, schema).persist(StorageLevel.DISK_ONLY)
            kept.append(docs)
            p = to_points(docs)
            points.append(p)
            errors.append(xml.xml_errors(docs, p, root))
            names.append(to_names(docs).join(p.select("activity_id").distinct(), "activity_id", "left_semi").withColumn("own_session", F.lit(True)))
    both = reduce(DataFrame.unionByName, points)
    bad = reduce(DataFrame.unionByName, errors)
    acts = reduce(DataFrame.unionByName, names).withColumn("format", F.ltrim(extension(F.col("activity_id")), F.lit(".")))
    if strict and (one := bad.limit(1).collect()):
        raise ValueError(f"{one[0].path}: {one[0].reason}")
    return Rides(both, fit.sessions(msgs), fit.file_ids(msgs), acts, bad, tuple(kept))


def parse(spark: SparkSession, *paths: str) -> DataFrame:
    """activity_id and json of each ride."""
    return read(spark, *paths).json()


def convert(spark: SparkSession, out: str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Writes GPX and TCX files as FIT; (activity_id and path of what was written, report). FIT files are refused."""
    found = files.scan(spark, *paths)
    if found.filter(extension(F.col("path")) == ".fit").limit(1).count():
        raise ValueError("FIT files need no conversion")
    rides = read(spark, *paths, formats=(".gpx", ".tcx"))
    return write_files(fit_files(rides.points), out, ".fit"), S.conversion_report(rides.totals())


def trim(spark: SparkSession, out: str, start_m: float | str, end_m: float | str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Writes FIT files without positions near start and end; (activity_id and path, activity_id and status). Distances may be texts that begin with a number. A file that can't be read, or has no point, has an error object as its status."""
    start, end = metres(start_m), metres(end_m)
    if start is None or end is None:
        found = files.scan(spark, *paths)
        none = found.select(F.col("path").alias("activity_id")).limit(0)
        return none.withColumn("path", F.lit("")), found.select(F.col("path").alias("activity_id"), R.error_object(F.lit("Invalid trim distance")).alias("status"))
    rides = read(spark, *paths, formats=(".fit",))
    lost = rides.activities.select("activity_id").join(rides.points.select("activity_id").distinct(), "activity_id", "left_anti")
    bad = rides.errors.select(F.col("path").alias("activity_id"), R.error_object(F.col("reason")).alias("status")).unionByName(lost.select("activity_id", R.error_object(F.lit("no GPS points")).alias("status")))
    return write_files(fit_files(R.trim(rides.points, start, end).drop("zone")), out, ".fit"), R.status(R.zones(rides.points, start, end)).unionByName(bad)


def metres(x: float | str) -> float | None:
    """The number that a text argument begins with; None where it begins with none."""
    if isinstance(x, (int, float)):
        return float(x)
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", x)
    return float(m.group(1)) if m else None
