"""Operators over points in order. All share one window, so a plan has one exchange on activity_id and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import haversine, scaled_round
from ..schemas import EARTH_M


def by_seq():
    return Window.partitionBy("activity_id").orderBy("seq")


def running():
    return by_seq().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole():
    return Window.partitionBy("activity_id")


def drop_null_island(points: DataFrame) -> DataFrame:
    """Without points at exactly 0, 0; one zero alone stays."""
    return points.filter(~((F.col("lat") == 0) & (F.col("lon") == 0)))


def positioned(points: DataFrame) -> DataFrame:
    return points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def step(radius: float = EARTH_M) -> Column:
    """Metres from the point before; null for the first, and where either position is withheld."""
    return haversine(F.lag("lat").over(by_seq()), F.lag("lon").over(by_seq()), F.col("lat"), F.col("lon"), radius)


def with_steps(points: DataFrame, radius: float = EARTH_M) -> DataFrame:
    """seg_m, dt_s (wraps at 32 bits, as unsigned seconds do), ele_delta, speed_kmh (0.1 km/h; null where time stands still)."""
    p = points.withColumns({
        "seg_m": step(radius), "dt_s": F.pmod(F.col("t_fit") - F.lag("t_fit").over(by_seq()), F.lit(4294967296)), "ele_delta": F.col("elevation") - F.lag("elevation").over(by_seq()),
    })
    return p.withColumn("speed_kmh", F.when(F.col("dt_s") > 0, scaled_round((F.col("seg_m") / 1000) / (F.col("dt_s") / 3600), 1)))


def with_distance(points: DataFrame) -> DataFrame:
    """cum_dist_m: metres so far, by steps."""
    return points.withColumn("cum_dist_m", F.sum(F.coalesce("seg_m", F.lit(0.0))).over(running()))


def with_odometer(points: DataFrame) -> DataFrame:
    """cum_dist_m where files carry a distance: a positive one sets the sum, a zero (or none) adds the step, a negative one leaves it."""
    d = F.coalesce("src_distance_m", F.lit(0.0))
    p = points.withColumn("_grp", F.sum(F.when(d > 0, 1).otherwise(0)).over(running()))
    run = Window.partitionBy("activity_id", "_grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.first(F.when(d > 0, d), ignorenulls=True).over(run)
    return p.withColumn("cum_dist_m", F.coalesce(base, F.lit(0.0)) + F.sum(F.when(d == 0, F.coalesce("seg_m", F.lit(0.0))).otherwise(0.0)).over(run)).drop("_grp")


def with_backfill(points: DataFrame) -> DataFrame:
    """speed_shown: the first point shows the second one's speed. Averages use speed_kmh."""
    first = F.row_number().over(by_seq()) == 1
    return points.withColumn("speed_shown", F.when(first, F.coalesce("speed_kmh", F.lead("speed_kmh").over(by_seq()))).otherwise(F.col("speed_kmh")))
