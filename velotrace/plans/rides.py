"""Registered ride queries over pseudo-tracks from the events table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as X
from ..operators import summary as S
from ..operators import tracks as K
from ..operators import trim as R
from ..schemas import FIT_EPOCH
from ..sinks import documents as D
from ..sources import fit, xml


def pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points of one ride per user: positions from the event's number, sensors from its properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    t = (F.unix_timestamp("ts") - FIT_EPOCH).cast("long")
    e = e.withColumn("k", k).withColumn("t_fit", t)
    e = e.withColumn("activity_id", F.col("user_id").cast("string"))  # the key of all later windows and groups: one exchange
    seq = (F.row_number().over(Window.partitionBy("activity_id").orderBy("t_fit", "event_id")) - 1).cast("long")
    return e.select(
        "activity_id", seq.alias("seq"), (50 + F.pmod(F.col("event_id") * 7919, F.lit(100000)) / F.lit(200000.0)).alias("lat"), (4 + F.pmod(F.col("event_id") * 104729, F.lit(100000)) / F.lit(200000.0)).alias("lon"),
        (F.col("value") / 10 - 20).alias("elevation"), "t_fit", X.fit_instant(F.col("t_fit")).alias("ts"), F.when(F.col("event_type") != "error", 60 + F.col("k")).cast("short").alias("heart_rate"),
        F.col("k").cast("short").alias("cadence"), F.when(F.col("event_type").isin("click", "purchase"), 4 * F.col("k")).cast("int").alias("power"), (F.col("k") - 50).cast("byte").alias("temperature"),
        F.when(F.col("event_type") == "view", F.col("k") / F.lit(10.0)).alias("speed_sensor_ms"), F.when(F.pmod(F.col("event_id"), F.lit(7)) == 0, F.col("event_id") * 1.0).when(F.pmod(F.col("event_id"), F.lit(11)) == 0, F.lit(-1.0)).otherwise(F.lit(0.0)).alias("src_distance_m"),
    )


T_SQL = """
e AS (SELECT *, (props::JSON->>'$.k')::INT AS k, epoch(date_trunc('second', ts))::BIGINT - 631065600 AS t_fit FROM events),
t AS (SELECT user_id::VARCHAR AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY t_fit, event_id) - 1 AS seq, event_id, t_fit,
 50 + (event_id * 7919 % 100000) / 200000.0::DOUBLE AS lat, 4 + (event_id * 104729 % 100000) / 200000.0::DOUBLE AS lon, value / 10 - 20 AS elevation,
 CASE WHEN event_type <> 'error' THEN 60 + k END AS heart_rate, k AS cadence, CASE WHEN event_type IN ('click', 'purchase') THEN 4 * k END AS power, k - 50 AS temperature,
 CASE WHEN event_type = 'view' THEN k / 10.0::DOUBLE END AS speed_sensor_ms,
 CASE WHEN event_id % 7 = 0 THEN event_id * 1.0::DOUBLE WHEN event_id % 11 = 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS src_distance_m FROM e)"""


def _hav(radius: str) -> str:
    a = "(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2))"
    return f"2 * {radius}::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a}))"


_W = "WINDOW w AS (PARTITION BY activity_id ORDER BY seq)"
S_SQL = (
    T_SQL
    + f""",
s0 AS (SELECT *, {_hav('6371003')} AS seg_m, (t_fit - lag(t_fit) OVER w + 4294967296) % 4294967296 AS dt_s, elevation - lag(elevation) OVER w AS ele_delta FROM t {_W}),
s AS (SELECT *, CASE WHEN dt_s > 0 THEN floor(seg_m / 1000 / (dt_s / 3600.0::DOUBLE) * 10 + 0.5) / 10 END AS speed_kmh FROM s0)"""
)


def _r(c: str, n: int) -> F.Column:
    return X.scaled_round(F.col(c), n).alias(c)


def _rs(c: str, n: int) -> str:
    return f"sign({c}) * floor(abs({c} * {10**n}.0::DOUBLE) + 0.5) / {10**n}.0::DOUBLE"


def segment_distance(spark, d):
    return K.with_steps(pseudo(spark, d)).select("activity_id", "seq", _r("seg_m", 4))


def cumulative_distance(spark, d):
    return K.with_distance(K.with_steps(pseudo(spark, d))).select("activity_id", "seq", _r("cum_dist_m", 3))


def ride_distance(spark, d):
    return S.ride_totals(K.with_steps(pseudo(spark, d))).select("activity_id", "points", X.scaled_round(F.col("distance_m") / 1000, 2).alias("distanceKm"))


def ride_duration(spark, d):
    return S.ride_totals(K.with_steps(pseudo(spark, d))).select("activity_id", X.scaled_round(F.col("duration_s") / 60, 2).alias("durationMin"), X.iso_time(F.col("start_fit")).alias("startTime"), X.iso_time(F.col("end_fit")).alias("endTime"))


def gps_speed(spark, d):
    return K.with_steps(pseudo(spark, d)).select("activity_id", "seq", "dt_s", "speed_kmh")


def speed_backfill(spark, d):
    return K.with_backfill(K.with_steps(pseudo(spark, d))).select("activity_id", "seq", "speed_shown")


def _slow(spark, d):
    """A track with standing points (place by thirds) and times by the hour, so that some steps are still and some have no time."""
    p = pseudo(spark, d)
    third = F.floor(F.col("seq") / 3)
    return p.withColumns({"lat": 50 + third / 1000.0, "lon": 4 + third / 500.0, "t_fit": F.floor(F.col("t_fit") / 3600).cast("long") * 3600})


def moving_stats(spark, d):
    return S.ride_totals(K.with_steps(_slow(spark, d))).select("activity_id", "avg_speed", "max_speed", "moving_s")


def sensor_summary(spark, d):
    t = S.ride_totals(K.with_steps(pseudo(spark, d)))
    return t.select("activity_id", _r("avg_hr", 6), "max_hr", _r("avg_power", 6), "max_power", _r("avg_cadence", 6), F.col("avg_hr").isNotNull().alias("has_hr"), F.col("avg_power").isNotNull().alias("has_power"), F.col("avg_cadence").isNotNull().alias("has_cadence"))


def ascent_descent(spark, d):
    return S.ride_totals(K.with_steps(pseudo(spark, d))).select("activity_id", _r("ascent_m", 6), _r("descent_m", 6))


def tcx_odometer(spark, d):
    return K.with_odometer(K.with_steps(pseudo(spark, d))).select("activity_id", "seq", _r("cum_dist_m", 3))


def _dirty(spark, d):
    p = pseudo(spark, d)
    return p.withColumns({"lat": F.when(F.pmod("seq", F.lit(5)) == 0, 0.0).otherwise(F.col("lat")), "lon": F.when(F.pmod("seq", F.lit(10)) == 0, 0.0).otherwise(F.col("lon"))})


def null_island_filter(spark, d):
    return K.drop_null_island(_dirty(spark, d)).select("activity_id", "seq", "lat", "lon")


def sensor_range_filter(spark, d):
    p = pseudo(spark, d)
    wide = F.col("heart_rate").cast("int") * 2
    return p.select("activity_id", "seq", X.in_range(wide, 255).alias("heart_rate"), X.in_range(F.col("cadence").cast("int"), 255).alias("cadence"), X.in_range(F.col("power") * 200, 65535).alias("power"))


def fit_epoch_roundtrip(spark, d):
    p = pseudo(spark, d).withColumn("text", X.iso_time(F.col("t_fit")))
    return p.select("activity_id", "seq", "text", X.fit_time(F.col("text")).alias("back"), X.fit_time(F.concat(F.translate(F.substring("text", 1, 19), "T", " "), F.lit(".250+02:00"))).alias("spaced"))


def semicircle_roundtrip(spark, d):
    p = pseudo(spark, d).select("activity_id", "seq", X.semicircles(F.col("lat")).alias("semi_lat"), X.semicircles(-F.col("lon")).alias("semi_lon"))
    return p.withColumn("lat", X.scaled_round(X.degrees(F.col("semi_lat")), 9))


def _messages(spark, d):
    """Session-like messages, one for each point of the activity, whose fields have gaps."""
    p = pseudo(spark, d)
    some = lambda n, c: F.when(F.pmod(F.col("cadence") + F.col("seq"), F.lit(n)) != 0, c)
    return p.select("activity_id", "seq", some(2, F.col("cadence") * 100.0).alias("total_distance_m"), some(3, F.col("cadence") / 4.0).alias("max_speed_ms"), some(4, F.pmod(F.col("cadence").cast("int"), F.lit(70))).alias("sub_sport"), some(2, F.pmod(F.col("cadence").cast("int") * 7, F.lit(400))).alias("manufacturer"))


def session_last_valid(spark, d):
    s = S.last_valid(_messages(spark, d), ["total_distance_m", "max_speed_ms", "sub_sport", "manufacturer"])
    return s.select("activity_id", X.scaled_round(F.col("total_distance_m") / 1000, 2).alias("sessionDistanceKm"), X.scaled_round(X.kmh(F.col("max_speed_ms")), 1).alias("sessionMaxSpeedKmh"), "sub_sport", "manufacturer")


def indoor_flag(spark, d):
    s = S.last_valid(_messages(spark, d), ["sub_sport", "manufacturer"])
    return s.select("activity_id", X.is_indoor(F.col("sub_sport"), F.col("manufacturer")).alias("isIndoor"))


def session_preference(spark, d):
    t = S.ride_totals(K.with_steps(pseudo(spark, d)))
    own = S.from_totals(t)
    device = S.last_valid(_messages(spark, d).filter("sub_sport > 30"), ["total_distance_m"])
    j = own.select("activity_id", F.col("total_distance_m").alias("own_m"), "total_elapsed_s").join(device, "activity_id", "left")
    return j.select("activity_id", X.scaled_round(F.coalesce("total_distance_m", "own_m") / 1000, 2).alias("sessionDistanceKm"), "total_elapsed_s")


def privacy_trim_mask(spark, d):
    p = R.trim(pseudo(spark, d), 50_000, 60_000)
    return p.select("activity_id", "seq", "zone", "lat", "lon", "heart_rate")


def privacy_trim_counts(spark, d):
    return R.counts(R.zones(pseudo(spark, d), 50_000, 60_000))


def trim_status(spark, d):
    return R.status(R.zones(pseudo(spark, d), 50_000, 60_000))


def fit_session_stats(spark, d):
    w = S.writer_stats(K.with_odometer(K.with_steps(pseudo(spark, d).withColumn("src_distance_m", F.lit(0.0)))))
    return w.select("activity_id", "avg_heart_rate", "max_heart_rate", "avg_cadence", "max_cadence", "avg_power", "max_power", _r("avg_speed_ms", 4), _r("max_speed_ms", 4), _r("distance_m", 2), "elapsed_s")


def conversion_report(spark, d):
    return S.conversion_report(S.ride_totals(K.with_steps(pseudo(spark, d))))


def point_json(spark, d):
    return D.point_json(pseudo(spark, d)).select("activity_id", "seq", F.to_json("point").alias("json"))


def ride_summary(spark, d):
    s = S.summarize(pseudo(spark, d))
    return s.select("activity_id", "points", "distanceKm", "durationMin", _r("avgHeartRate", 6), "maxHeartRate", _r("avgPower", 6), "maxPower", _r("avgCadence", 6), "avgSpeed", "maxSpeed", "movingTimeSec", "sessionDistanceKm", _r("sessionElevationGainM", 6), _r("sessionElevationLossM", 6), "sessionElapsedSec", "isIndoor", "startTime", "endTime")


def ride_json(spark, d):
    p = pseudo(spark, d)
    return D.ride_json(p, S.summarize(p))


_TRKPT = "<trkpt lat=\"{}\" lon=\"{}\"><ele>{}</ele><time>{}</time><extensions><power>{}</power><gpxtpx:TrackPointExtension><gpxtpx:atemp>{}</gpxtpx:atemp><gpxtpx:hr>{}</gpxtpx:hr><gpxtpx:cad>{}</gpxtpx:cad></gpxtpx:TrackPointExtension></extensions></trkpt>"


def _fill(form: str, *cols) -> F.Column:
    parts, out = form.split("{}"), []
    for k, text in enumerate(parts):
        out.append(F.lit(text))
        if k < len(cols):
            out.append(F.coalesce(cols[k].cast("string"), F.lit("")))
    return F.concat(*out)


def _gpx_docs(spark, d):
    c = F.col
    p = pseudo(spark, d).withColumn("x", _fill(_TRKPT, c("lat"), c("lon"), c("elevation"), X.iso_time(c("t_fit")), c("power"), c("temperature"), c("heart_rate"), c("cadence")))
    g = p.groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "\n").alias("x"))
    head = '<?xml version="1.0"?><gpx version="1.1" xmlns:gpxtpx="t"><metadata><name>Ride</name></metadata><trk><name>T</name><trkseg>'
    return g.select(F.col("activity_id").alias("path"), F.encode(F.concat(F.lit(head), "x", F.lit("</trkseg></trk></gpx>")), "UTF-8").alias("content"))


def gpx_scan(spark, d):
    p = xml.gpx_points(xml.documents(_gpx_docs(spark, d), "gpx", xml.GPX))
    return p.select("activity_id", "seq", _r("lat", 9), _r("lon", 9), _r("elevation", 6), "t_fit", "heart_rate", "cadence", "power", "temperature")


_TP = "<Trackpoint><Time>{}</Time><Position><LatitudeDegrees>{}</LatitudeDegrees><LongitudeDegrees>{}</LongitudeDegrees></Position><AltitudeMeters>{}</AltitudeMeters><DistanceMeters>{}</DistanceMeters><HeartRateBpm><Value>{}</Value></HeartRateBpm><Cadence>{}</Cadence><Extensions><ns3:TPX><ns3:Speed>{}</ns3:Speed><ns3:Watts>{}</ns3:Watts></ns3:TPX></Extensions></Trackpoint>"


def _tcx_docs(spark, d):
    c = F.col
    p = pseudo(spark, d).withColumn("x", _fill(_TP, X.iso_time(c("t_fit")), c("lat"), c("lon"), c("elevation"), c("src_distance_m"), c("heart_rate"), c("cadence"), c("speed_sensor_ms"), c("power")))
    laps = p.groupBy("activity_id", F.floor(F.col("seq") / 20).alias("lap")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "\n").alias("x"))
    g = laps.groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lap", "x"))), lambda s: F.concat(F.lit("<Lap><Track>"), s["x"], F.lit("</Track></Lap>"))), "").alias("x"))
    head = '<?xml version="1.0"?><TrainingCenterDatabase xmlns:ns3="e"><Activities><Activity Sport="Biking"><Id>1</Id>'
    return g.select(F.col("activity_id").alias("path"), F.encode(F.concat(F.lit(head), "x", F.lit("</Activity></Activities></TrainingCenterDatabase>")), "UTF-8").alias("content"))


def tcx_scan(spark, d):
    p = K.with_odometer(K.with_steps(xml.tcx_points(xml.documents(_tcx_docs(spark, d), "TrainingCenterDatabase", xml.TCX))))
    return p.select("activity_id", "seq", _r("lat", 9), _r("lon", 9), _r("elevation", 6), "t_fit", "heart_rate", "cadence", "power", _r("cum_dist_m", 2))


def tcx_summary(spark, d):
    """Totals of TCX rides whose points carry distances: the running odometer's last value."""
    s = S.summarize(pseudo(spark, d), odometer=True)
    return s.select("activity_id", "points", "distanceKm", "sessionDistanceKm", _r("sessionElevationGainM", 6), "durationMin")


def tcx_conversion_report(spark, d):
    return S.conversion_report(S.ride_totals(K.with_odometer(K.with_steps(pseudo(spark, d)))))


def gpx_tracks(spark, d):
    """Documents of several tracks and segments, of which some are empty."""
    c = F.col
    p = pseudo(spark, d).withColumn("x", F.format_string('<trkpt lat="%s" lon="%s"><ele>%s</ele></trkpt>', c("lat").cast("string"), c("lon").cast("string"), c("elevation").cast("string")))
    g = p.groupBy("activity_id", F.floor(c("seq") / 7).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "").alias("x"))
    seg = F.concat(F.lit("<trkseg>"), "x", F.lit("</trkseg>"), F.when(F.pmod("g", F.lit(3)) == 0, "</trk><trk><name>next</name><trkseg/>").otherwise(""))
    g = g.withColumn("x", seg).groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "x"))), lambda s: s["x"]), "").alias("x"))
    docs = g.select(c("activity_id").alias("path"), F.encode(F.concat(F.lit('<gpx version="1.1"><trk>'), "x", F.lit("</trk></gpx>")), "UTF-8").alias("content"))
    p = xml.gpx_points(xml.documents(docs, "gpx", xml.GPX))
    return p.select("activity_id", "seq", _r("lat", 9), _r("lon", 9), _r("elevation", 6))


def tcx_courses(spark, d):
    """Documents of courses, whose tracks lie outside of laps, with an odometer."""
    c = F.col
    p = pseudo(spark, d).withColumn("x", _fill(_TP, X.iso_time(c("t_fit")), c("lat"), c("lon"), c("elevation"), c("src_distance_m"), c("heart_rate"), c("cadence"), c("speed_sensor_ms"), c("power")))
    g = p.groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "").alias("x"))
    docs = g.select(c("activity_id").alias("path"), F.encode(F.concat(F.lit('<TrainingCenterDatabase xmlns:ns3="e"><Courses><Course><Name>C</Name><Track>'), "x", F.lit("</Track></Course></Courses></TrainingCenterDatabase>")), "UTF-8").alias("content"))
    p = xml.tcx_points(xml.documents(docs, "TrainingCenterDatabase", xml.TCX))
    t = S.ride_totals(K.with_odometer(K.with_steps(p)))
    return t.select("activity_id", "points", X.scaled_round(c("distance_m") / 1000, 2).alias("distanceKm"), "max_hr")


def fit_session_message(spark, d):
    """The SESSION message of written FIT files, read back."""
    made = D.fit_files(pseudo(spark, d).withColumn("src_distance_m", F.lit(0.0))).select(F.col("activity_id").alias("path"), F.col("fit").alias("content"))
    s = fit.sessions(fit.read_messages(made, ("session",)))
    return s.select("activity_id", F.coalesce("total_distance_m", F.lit(0.0)).alias("total_distance_m"), "total_elapsed_s", "total_timer_s", F.col("sport").cast("int").alias("sport"), F.col("sub_sport").cast("int").alias("sub_sport"), F.coalesce("total_ascent_m", F.lit(0.0)).alias("total_ascent_m"))


def fit_roundtrip(spark, d):
    made = D.fit_files(pseudo(spark, d)).select(F.col("activity_id").alias("path"), F.col("fit").alias("content"))
    p = fit.points(fit.read_messages(made))
    w = Window.partitionBy("activity_id").orderBy("seq")
    return p.select("activity_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), _r("lat", 9), _r("lon", 9), "t_fit", "heart_rate", "cadence", "power", "temperature")


FUNCTIONS = (
    segment_distance, cumulative_distance, ride_distance, ride_duration, gps_speed, speed_backfill, moving_stats, sensor_summary, ascent_descent, tcx_odometer, null_island_filter, sensor_range_filter, fit_epoch_roundtrip,
    semicircle_roundtrip, session_last_valid, indoor_flag, session_preference, privacy_trim_mask, privacy_trim_counts, trim_status, fit_session_stats, conversion_report, point_json, ride_summary, ride_json, gpx_scan, tcx_scan, fit_roundtrip, tcx_summary, tcx_conversion_report, gpx_tracks, tcx_courses, fit_session_message,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_DUR = "greatest(arg_max(t_fit, seq) - arg_min(t_fit, seq), 0)"
_ISO = "strftime(make_timestamp((({}) + 631065600) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_Z = (
    T_SQL
    + f""", z0 AS (SELECT *, {_hav('6371000')} AS sg FROM t {_W}), z1 AS (SELECT *, sum(coalesce(sg, 0)) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM z0),
z2 AS (SELECT *, max(cum) OVER (PARTITION BY activity_id) AS total FROM z1), z AS (SELECT *, CASE WHEN cum < 50000 THEN 'start' WHEN total - cum < 60000 THEN 'end' END AS zone FROM z2)"""
)
_M = (
    T_SQL
    + """, m AS (SELECT activity_id, seq, CASE WHEN (cadence + seq) % 2 <> 0 THEN cadence * 100.0::DOUBLE END AS total_distance_m, CASE WHEN (cadence + seq) % 3 <> 0 THEN cadence / 4.0::DOUBLE END AS max_speed_ms,
 CASE WHEN (cadence + seq) % 4 <> 0 THEN cadence % 70 END AS sub_sport, CASE WHEN (cadence + seq) % 2 <> 0 THEN (cadence * 7) % 400 END AS manufacturer FROM t)"""
)


def _last(c: str) -> str:
    return f"arg_max({c}, seq) FILTER ({c} IS NOT NULL)"


_ODO = """, o AS (SELECT *, sum(CASE WHEN src_distance_m > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp FROM s),
q AS (SELECT *, coalesce(max(CASE WHEN src_distance_m > 0 THEN src_distance_m END) OVER g, 0) + sum(CASE WHEN src_distance_m = 0 THEN coalesce(seg_m, 0) ELSE 0 END) OVER g AS cum_dist_m FROM o
 WINDOW g AS (PARTITION BY activity_id, grp ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
_SLOW = S_SQL.replace("FROM e)", "FROM e), t1 AS (SELECT * REPLACE (50 + (seq // 3) / 1000.0::DOUBLE AS lat, 4 + (seq // 3) / 500.0::DOUBLE AS lon, (t_fit // 3600) * 3600 AS t_fit) FROM t)").replace("FROM t WINDOW", "FROM t1 WINDOW")
_MOVE = "coalesce(floor(avg(CASE WHEN speed_kmh > 1 THEN speed_kmh END) * 10 + 0.5) / 10, 0.0)"
_UP, _DOWN = "coalesce(sum(greatest(ele_delta, 0)), 0)", "coalesce(sum(greatest(-ele_delta, 0)), 0)"
SQL = {
    "segment_distance": f"WITH {S_SQL} SELECT activity_id, seq, {_rs('seg_m', 4)} AS seg_m FROM s",
    "cumulative_distance": f"WITH {S_SQL}, c AS (SELECT *, sum(coalesce(seg_m, 0)) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum_dist_m FROM s) SELECT activity_id, seq, {_rs('cum_dist_m', 3)} AS cum_dist_m FROM c",
    "ride_distance": f"WITH {S_SQL} SELECT activity_id, count(*) AS points, floor(sum(seg_m) / 1000 * 100 + 0.5) / 100 AS \"distanceKm\" FROM s GROUP BY activity_id",
    "ride_duration": f"WITH {T_SQL} SELECT activity_id, floor({_DUR} / 60.0::DOUBLE * 100 + 0.5) / 100 AS \"durationMin\", {_ISO.format('arg_min(t_fit, seq)')} AS \"startTime\", {_ISO.format('arg_max(t_fit, seq)')} AS \"endTime\" FROM t GROUP BY activity_id",
    "gps_speed": f"WITH {S_SQL} SELECT activity_id, seq, dt_s, speed_kmh FROM s",
    "speed_backfill": f"WITH {S_SQL} SELECT activity_id, seq, CASE WHEN seq = 0 THEN coalesce(speed_kmh, lead(speed_kmh) OVER w) ELSE speed_kmh END AS speed_shown FROM s {_W}",
    "moving_stats": f"WITH {_SLOW} SELECT activity_id, {_MOVE} AS avg_speed, coalesce(max(speed_kmh), 0.0) AS max_speed, coalesce(sum(CASE WHEN speed_kmh > 1 THEN dt_s END), 0)::BIGINT AS moving_s FROM s GROUP BY activity_id",
    "sensor_summary": f"WITH {T_SQL}, a AS (SELECT activity_id, avg(heart_rate) AS avg_hr, max(heart_rate) AS max_hr, avg(power) AS avg_power, max(power) AS max_power, avg(cadence) AS avg_cadence FROM t GROUP BY activity_id) SELECT activity_id, {_rs('avg_hr', 6)} AS avg_hr, max_hr, {_rs('avg_power', 6)} AS avg_power, max_power, {_rs('avg_cadence', 6)} AS avg_cadence, avg_hr IS NOT NULL AS has_hr, avg_power IS NOT NULL AS has_power, avg_cadence IS NOT NULL AS has_cadence FROM a",
    "ascent_descent": f"WITH {S_SQL}, a AS (SELECT activity_id, {_UP} AS u, {_DOWN} AS d FROM s GROUP BY activity_id) SELECT activity_id, {_rs('u', 6)} AS ascent_m, {_rs('d', 6)} AS descent_m FROM a",
    "tcx_odometer": f"WITH {S_SQL}{_ODO} SELECT activity_id, seq, {_rs('cum_dist_m', 3)} AS cum_dist_m FROM q",
    "null_island_filter": f"WITH {T_SQL}, x AS (SELECT activity_id, seq, CASE WHEN seq % 5 = 0 THEN 0.0 ELSE lat END AS lat, CASE WHEN seq % 10 = 0 THEN 0.0 ELSE lon END AS lon FROM t) SELECT * FROM x WHERE NOT (lat = 0 AND lon = 0)",
    "sensor_range_filter": f"WITH {T_SQL} SELECT activity_id, seq, CASE WHEN heart_rate * 2 BETWEEN 1 AND 255 THEN heart_rate * 2 END AS heart_rate, CASE WHEN cadence BETWEEN 1 AND 255 THEN cadence END AS cadence, CASE WHEN power * 200 BETWEEN 1 AND 65535 THEN power * 200 END AS power FROM t",
    "fit_epoch_roundtrip": f"WITH {T_SQL} SELECT activity_id, seq, {_ISO.format('t_fit')} AS text, t_fit AS back, t_fit AS spaced FROM t",
    "semicircle_roundtrip": f"WITH {T_SQL}, x AS (SELECT activity_id, seq, trunc(lat * (2147483648.0::DOUBLE / 180))::INT AS semi_lat, trunc(-lon * (2147483648.0::DOUBLE / 180))::INT AS semi_lon FROM t), y AS (SELECT *, semi_lat * (180.0::DOUBLE / 2147483648) AS deg FROM x) SELECT activity_id, seq, semi_lat, semi_lon, {_rs('deg', 9)} AS lat FROM y",
    "session_last_valid": f"WITH {_M}, l AS (SELECT activity_id, {_last('total_distance_m')} / 1000 AS d, {_last('max_speed_ms')} * 3.6::DOUBLE AS v, {_last('sub_sport')} AS sub_sport, {_last('manufacturer')} AS manufacturer FROM m GROUP BY activity_id) SELECT activity_id, {_rs('d', 2)} AS \"sessionDistanceKm\", {_rs('v', 1)} AS \"sessionMaxSpeedKmh\", sub_sport, manufacturer FROM l",
    "indoor_flag": f"WITH {_M}, l AS (SELECT activity_id, {_last('sub_sport')} AS sub_sport, {_last('manufacturer')} AS manufacturer FROM m GROUP BY activity_id) SELECT activity_id, (coalesce(sub_sport IN (6, 58), false) OR coalesce(manufacturer IN (260, 144, 331, 67), false)) AS \"isIndoor\" FROM l",
    "session_preference": f"WITH {_M}, {S_SQL.replace(T_SQL + ',', '')}, d AS (SELECT activity_id, {_last('total_distance_m')} AS dm FROM m WHERE sub_sport > 30 GROUP BY activity_id), o AS (SELECT activity_id, sum(seg_m) AS om, {_DUR}::DOUBLE AS el FROM s GROUP BY activity_id), j AS (SELECT activity_id, coalesce(dm, CASE WHEN om > 0 THEN om END) / 1000 AS km, CASE WHEN el > 0 THEN el END AS el FROM o LEFT JOIN d USING (activity_id)) SELECT activity_id, {_rs('km', 2)} AS \"sessionDistanceKm\", el AS total_elapsed_s FROM j",
    "privacy_trim_mask": f"WITH {_Z} SELECT activity_id, seq, zone, CASE WHEN zone IS NULL THEN lat END AS lat, CASE WHEN zone IS NULL THEN lon END AS lon, heart_rate FROM z",
    "privacy_trim_counts": f"WITH {_Z} SELECT activity_id, count(*) FILTER (zone = 'start') AS stripped_start, count(*) FILTER (zone = 'end') AS stripped_end FROM z GROUP BY activity_id",
    "trim_status": f"WITH {_Z}, c AS (SELECT activity_id, count(*) FILTER (zone = 'start') AS a, count(*) FILTER (zone = 'end') AS b FROM z GROUP BY activity_id) SELECT activity_id, '{{\"status\":\"ok\",\"stripped_start\":' || a || ',\"stripped_end\":' || b || '}}' AS status FROM c",
    "fit_session_stats": f"WITH {S_SQL}, a AS (SELECT activity_id, (sum(heart_rate) FILTER (heart_rate > 0))::BIGINT // count(*) FILTER (heart_rate > 0) AS avg_heart_rate, max(heart_rate) FILTER (heart_rate > 0) AS max_heart_rate, (sum(cadence) FILTER (cadence > 0))::BIGINT // count(*) FILTER (cadence > 0) AS avg_cadence, max(cadence) FILTER (cadence > 0) AS max_cadence, (sum(power) FILTER (power > 0))::BIGINT // count(*) FILTER (power > 0) AS avg_power, max(power) FILTER (power > 0) AS max_power, avg(speed_sensor_ms) FILTER (speed_sensor_ms > 0) AS sa, max(speed_sensor_ms) FILTER (speed_sensor_ms > 0) AS sm, sum(seg_m) AS dm, {_DUR} AS elapsed_s FROM s GROUP BY activity_id), b AS (SELECT *, coalesce(sa, CASE WHEN elapsed_s > 0 AND dm > 0 THEN dm / elapsed_s END) AS av FROM a), c AS (SELECT *, coalesce(sm, av) AS mx FROM b) SELECT activity_id, avg_heart_rate, max_heart_rate, avg_cadence, max_cadence, avg_power, max_power, {_rs('av', 4)} AS avg_speed_ms, {_rs('mx', 4)} AS max_speed_ms, {_rs('dm', 2)} AS distance_m, elapsed_s FROM c",
    "conversion_report": f"WITH {S_SQL}, a AS (SELECT activity_id, count(*) AS points, sum(seg_m) / 1000 AS k, {_DUR} / 60.0::DOUBLE AS m, {_UP} AS u FROM s GROUP BY activity_id) SELECT activity_id, points, {_rs('k', 2)} AS km, {_rs('m', 2)} AS min, {_rs('u', 0)} AS ascent FROM a",
    "ride_summary": f"WITH {S_SQL}, a AS (SELECT activity_id, count(*) AS points, sum(seg_m) / 1000 AS k, {_DUR} AS du, avg(heart_rate) AS h, max(heart_rate) AS mh, avg(power) AS p, max(power) AS mp, avg(cadence) AS c, {_MOVE} AS av, coalesce(max(speed_kmh), 0.0) AS mv, coalesce(sum(CASE WHEN speed_kmh > 1 THEN dt_s END), 0)::BIGINT AS ms, {_UP} AS u, {_DOWN} AS d, arg_min(t_fit, seq) AS t0, arg_max(t_fit, seq) AS t1 FROM s GROUP BY activity_id), b AS (SELECT *, du / 60.0::DOUBLE AS dm FROM a) SELECT activity_id, points, {_rs('k', 2)} AS \"distanceKm\", {_rs('dm', 2)} AS \"durationMin\", {_rs('h', 6)} AS \"avgHeartRate\", mh AS \"maxHeartRate\", {_rs('p', 6)} AS \"avgPower\", mp AS \"maxPower\", {_rs('c', 6)} AS \"avgCadence\", av AS \"avgSpeed\", mv AS \"maxSpeed\", ms AS \"movingTimeSec\", CASE WHEN k > 0 THEN {_rs('k', 2)} END AS \"sessionDistanceKm\", CASE WHEN u > 0 THEN {_rs('u', 6)} END AS \"sessionElevationGainM\", CASE WHEN d > 0 THEN {_rs('d', 6)} END AS \"sessionElevationLossM\", CASE WHEN du > 0 THEN du::DOUBLE END AS \"sessionElapsedSec\", false AS \"isIndoor\", {_ISO.format('t0')} AS \"startTime\", {_ISO.format('t1')} AS \"endTime\" FROM b",
    "gpx_scan": f"WITH {T_SQL} SELECT activity_id, seq, {_rs('lat', 9)} AS lat, {_rs('lon', 9)} AS lon, {_rs('elevation', 6)} AS elevation, t_fit, heart_rate, CASE WHEN cadence > 0 THEN cadence END AS cadence, CASE WHEN power > 0 THEN power END AS power, temperature FROM t",
    "tcx_scan": f"WITH {S_SQL}{_ODO} SELECT activity_id, seq, {_rs('lat', 9)} AS lat, {_rs('lon', 9)} AS lon, {_rs('elevation', 6)} AS elevation, t_fit, heart_rate, CASE WHEN cadence > 0 THEN cadence END AS cadence, CASE WHEN power > 0 THEN power END AS power, {_rs('cum_dist_m', 2)} AS cum_dist_m FROM q",
    "fit_roundtrip": f"WITH {T_SQL}, x AS (SELECT *, trunc(lat * (2147483648.0::DOUBLE / 180))::INT * (180.0::DOUBLE / 2147483648) AS la, trunc(lon * (2147483648.0::DOUBLE / 180))::INT * (180.0::DOUBLE / 2147483648) AS lo FROM t) SELECT activity_id, seq, {_rs('la', 9)} AS lat, {_rs('lo', 9)} AS lon, t_fit, heart_rate, CASE WHEN cadence > 0 THEN cadence END AS cadence, CASE WHEN power > 0 THEN power END AS power, temperature FROM x",
    "tcx_summary": f"WITH {S_SQL}{_ODO}, a AS (SELECT activity_id, count(*) AS points, arg_max(cum_dist_m, seq) / 1000 AS k, {_UP} AS u, {_DUR} / 60.0::DOUBLE AS dm FROM q GROUP BY activity_id) SELECT activity_id, points, {_rs('k', 2)} AS \"distanceKm\", CASE WHEN k > 0 THEN {_rs('k', 2)} END AS \"sessionDistanceKm\", CASE WHEN u > 0 THEN {_rs('u', 6)} END AS \"sessionElevationGainM\", {_rs('dm', 2)} AS \"durationMin\" FROM a",
    "tcx_conversion_report": f"WITH {S_SQL}{_ODO}, a AS (SELECT activity_id, count(*) AS points, arg_max(cum_dist_m, seq) / 1000 AS k, {_DUR} / 60.0::DOUBLE AS m, {_UP} AS u FROM q GROUP BY activity_id) SELECT activity_id, points, {_rs('k', 2)} AS km, {_rs('m', 2)} AS min, {_rs('u', 0)} AS ascent FROM a",
    "gpx_tracks": f"WITH {T_SQL} SELECT activity_id, seq, {_rs('lat', 9)} AS lat, {_rs('lon', 9)} AS lon, {_rs('elevation', 6)} AS elevation FROM t",
    "tcx_courses": f"WITH {S_SQL}{_ODO}, a AS (SELECT activity_id, count(*) AS points, arg_max(cum_dist_m, seq) / 1000 AS k, max(heart_rate) AS max_hr FROM q GROUP BY activity_id) SELECT activity_id, points, {_rs('k', 2)} AS \"distanceKm\", max_hr FROM a",
    "fit_session_message": f"WITH {S_SQL}, a AS (SELECT activity_id, coalesce(sum(seg_m), 0) AS m, {_DUR}::DOUBLE AS du, {_UP} AS u FROM s GROUP BY activity_id) SELECT activity_id, {_rs('m', 2)} AS total_distance_m, du AS total_elapsed_s, du AS total_timer_s, 2 AS sport, 0 AS sub_sport, floor(least(u, 65534) + 0.5) AS total_ascent_m FROM a",
    "point_json": f"WITH {S_SQL}, p AS (SELECT *, CASE WHEN seq = 0 THEN coalesce(speed_kmh, lead(speed_kmh) OVER w) ELSE speed_kmh END AS shown FROM s {_W}), r AS (SELECT *, {_rs('lat', 6)} AS la, {_rs('lon', 6)} AS lo, {_rs('coalesce(elevation, 0.0)', 1)} AS el FROM p) SELECT activity_id, seq, '{{\"lat\":' || la || ',\"lon\":' || lo || ',\"elevation\":' || el || coalesce(',\"speed\":' || shown, '') || coalesce(',\"heartRate\":' || heart_rate, '') || coalesce(',\"power\":' || power, '') || coalesce(',\"cadence\":' || cadence, '') || coalesce(',\"temperature\":' || temperature, '') || ',\"timestamp\":\"' || {_ISO.format('t_fit')} || '\"}}' AS json FROM r",
}
