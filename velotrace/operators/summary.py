"""Aggregates of a ride: one grouping on activity_id, which reuses the window's partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_indoor, iso_time, kmh, scaled_round
from ..schemas import SESSION
from .tracks import with_odometer, with_steps

MOVING_KMH = 1.0


def duration_s() -> Column:
    """Last less first time by order, 0 where that isn't positive."""
    return F.greatest(F.max_by("t_fit", "seq") - F.min_by("t_fit", "seq"), F.lit(0))


def ascent() -> Column:
    return F.coalesce(F.sum(F.greatest("ele_delta", F.lit(0.0))), F.lit(0.0))


def descent() -> Column:
    return F.coalesce(F.sum(F.greatest(-F.col("ele_delta"), F.lit(0.0))), F.lit(0.0))


def moving(value: str) -> Column:
    return F.when(F.col("speed_kmh") > MOVING_KMH, F.col(value))


def ride_totals(stepped: DataFrame) -> DataFrame:
    """Unrounded totals and sensor statistics per activity, of points with with_steps columns. With cum_dist_m, the distance is its last value: an odometer's, where files carry one."""
    metres = F.max_by("cum_dist_m", "seq") if "cum_dist_m" in stepped.columns else F.sum("seg_m")
    return stepped.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(metres, F.lit(0.0)).alias("distance_m"), duration_s().alias("duration_s"),
        F.avg("heart_rate").alias("avg_hr"), F.max("heart_rate").alias("max_hr"), F.avg("power").alias("avg_power"), F.max("power").alias("max_power"), F.avg("cadence").alias("avg_cadence"),
        F.coalesce(scaled_round(F.avg(moving("speed_kmh")), 1), F.lit(0.0)).alias("avg_speed"), F.coalesce(F.max("speed_kmh"), F.lit(0.0)).alias("max_speed"),
        F.coalesce(F.sum(moving("dt_s")), F.lit(0)).alias("moving_s"), ascent().alias("ascent_m"), descent().alias("descent_m"),
        F.min_by("t_fit", "seq").alias("start_fit"), F.max_by("t_fit", "seq").alias("end_fit"),
    )


def last_valid(messages: DataFrame, fields: list[str], order: str = "seq") -> DataFrame:
    """Per activity each field's last value that is there: a later message overrides an earlier one field by field."""
    return messages.groupBy("activity_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def own_session() -> dict[str, Column]:
    """Session fields of files without session messages: own totals where positive; moving is elapsed."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    none = {"max_speed_ms": "double", "avg_speed_ms": "double", "sport": "short", "sub_sport": "short"}
    own = {"total_distance_m": pos("distance_m"), "total_ascent_m": pos("ascent_m"), "total_descent_m": pos("descent_m"), "total_elapsed_s": pos("duration_s"), "total_timer_s": pos("duration_s")}
    return own | {c: F.lit(None).cast(t) for c, t in none.items()}


def from_totals(totals: DataFrame) -> DataFrame:
    own = own_session()
    names = [x.split()[0] for x in SESSION.split(", ")][1:]
    return totals.select("activity_id", *[own[n].alias(n) for n in names])


def summarize(points: DataFrame, activities: DataFrame | None = None, session: DataFrame | None = None, file_id: DataFrame | None = None, odometer: bool = False) -> DataFrame:
    """One row per activity, with the names of the JSON summary. activities adds rides without points; where it has own_session, its true rows get their session fields from their own totals."""
    stepped = with_steps(points)
    t = ride_totals(with_odometer(stepped) if odometer else stepped)
    if activities is not None:
        own = [F.col("own_session")] if "own_session" in activities.columns else []
        t = activities.select("activity_id", *own).distinct().join(t, "activity_id", "left")
    if session is None:
        t = t.withColumns(own_session())
    else:
        t = t.join(session, "activity_id", "left")
        if "own_session" in t.columns:
            t = t.withColumns({n: F.when(F.col("own_session"), c).otherwise(F.col(n)) for n, c in own_session().items()})
    if file_id is not None:
        t = t.join(file_id, "activity_id", "left")
    else:
        t = t.withColumns({"manufacturer": F.lit(None).cast("int"), "garmin_product": F.lit(None).cast("int"), "product_name": F.lit(None).cast("string")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.select(
        "activity_id", zero(F.col("points")).alias("points"), scaled_round(F.coalesce("distance_m", F.lit(0.0)) / 1000, 2).alias("distanceKm"), scaled_round(zero(F.col("duration_s")) / 60, 2).alias("durationMin"),
        F.col("avg_hr").alias("avgHeartRate"), F.col("max_hr").alias("maxHeartRate"), F.col("avg_power").alias("avgPower"), F.col("max_power").alias("maxPower"), F.col("avg_cadence").alias("avgCadence"),
        F.coalesce("avg_speed", F.lit(0.0)).alias("avgSpeed"), F.coalesce("max_speed", F.lit(0.0)).alias("maxSpeed"), zero(F.col("moving_s")).alias("movingTimeSec"),
        scaled_round(F.col("total_distance_m") / 1000, 2).alias("sessionDistanceKm"), F.col("total_ascent_m").alias("sessionElevationGainM"), F.col("total_descent_m").alias("sessionElevationLossM"),
        scaled_round(kmh(F.col("max_speed_ms")), 1).alias("sessionMaxSpeedKmh"), scaled_round(kmh(F.col("avg_speed_ms")), 1).alias("sessionAvgSpeedKmh"),
        F.col("total_elapsed_s").alias("sessionElapsedSec"), F.col("total_timer_s").alias("sessionMovingSec"),
        "manufacturer", F.col("garmin_product").alias("garminProduct"), F.when(F.col("product_name") != "", F.col("product_name")).alias("productName"), "sport", F.col("sub_sport").alias("subSport"),
        is_indoor(F.col("sub_sport"), F.col("manufacturer")).alias("isIndoor"), iso_time(F.col("start_fit")).alias("startTime"), iso_time(F.col("end_fit")).alias("endTime"),
    )


def writer_stats(points: DataFrame, *more: Column) -> DataFrame:
    """What a FIT session message holds: means cut to integers, sensor speed or else distance by time. points has cum_dist_m and ele_delta. more are further aggregates of the same grouping."""
    over = lambda c: F.when(F.col(c) > 0, F.col(c))
    cols = []
    for c in ("heart_rate", "cadence", "power"):
        v = over(c).cast("long")
        cols += [F.when(F.count(v) > 0, F.floor(F.sum(v) / F.count(v))).cast("long").alias(f"avg_{c}"), F.max(v).alias(f"max_{c}")]
    t = points.groupBy("activity_id").agg(
        *cols, F.avg(over("speed_sensor_ms")).alias("sensor_avg"), F.max(over("speed_sensor_ms")).alias("sensor_max"), F.max_by("cum_dist_m", "seq").alias("distance_m"), duration_s().alias("elapsed_s"),
        ascent().alias("ascent_m"), descent().alias("descent_m"), F.min_by("t_fit", "seq").alias("start_fit"), F.max_by("t_fit", "seq").alias("end_fit"), *more,
    )
    own = F.when((F.col("elapsed_s") > 0) & (F.col("distance_m") > 0), F.col("distance_m") / F.col("elapsed_s"))
    t = t.withColumn("avg_speed_ms", F.coalesce("sensor_avg", own))
    return t.withColumn("max_speed_ms", F.coalesce("sensor_max", "avg_speed_ms")).drop("sensor_avg", "sensor_max")


def conversion_report(totals: DataFrame) -> DataFrame:
    """points, km, min and ascent as a conversion reports them."""
    return totals.select("activity_id", "points", scaled_round(F.col("distance_m") / 1000, 2).alias("km"), scaled_round(F.col("duration_s") / 60, 2).alias("min"), scaled_round(F.col("ascent_m"), 0).alias("ascent"))
