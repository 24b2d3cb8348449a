"""Privacy trimmer: positions near the start and the end of a ride, along its path, are withheld; sensors stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TRIM_EARTH_M
from .tracks import running, step, whole


def zones(points: DataFrame, start_m: float, end_m: float) -> DataFrame:
    """cum_m, total_m and zone: start, end or null. Both limits are strict, and start wins; 0 marks nothing."""
    p = points.withColumn("_seg", step(TRIM_EARTH_M))
    p = p.withColumn("cum_m", F.sum(F.coalesce("_seg", F.lit(0.0))).over(running())).withColumn("total_m", F.max("cum_m").over(whole())).drop("_seg")
    return p.withColumn("zone", F.when(F.col("cum_m") < start_m, "start").when(F.col("total_m") - F.col("cum_m") < end_m, "end"))


def trim(points: DataFrame, start_m: float, end_m: float) -> DataFrame:
    """points with null lat and lon in both zones."""
    z = zones(points, start_m, end_m)
    hide = F.col("zone").isNotNull()
    return z.select(*[F.when(~hide, F.col(c)).alias(c) if c in ("lat", "lon") else F.col(c) for c in points.columns], "zone")


def counts(zoned: DataFrame) -> DataFrame:
    return zoned.groupBy("activity_id").agg(F.count_if(F.col("zone") == "start").alias("stripped_start"), F.count_if(F.col("zone") == "end").alias("stripped_end"))


def status(zoned: DataFrame) -> DataFrame:
    """The status line of each activity."""
    c = counts(zoned)
    return c.select("activity_id", F.to_json(F.struct(F.lit("ok").alias("status"), "stripped_start", "stripped_end")).alias("status"))


def error_object(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), message.alias("message")))
