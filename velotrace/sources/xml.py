"""GPX and TCX documents to points, by from_xml with explicit schemas. Leaves are arrays of text, of which the first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import fit_instant, in_range, integer_text, number_text, parsed, since_fit_epoch, unix_time

PROLOG = r"(?s)^\x{FEFF}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*"


def _leaf(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(T.StringType())) for n in names]


def _many(name: str, fields: list[T.StructField]) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StructType(fields)))


_PREFIX = ("gpxtpx:", "", "ns3:")
_TPE = [_many(f"{p}TrackPointExtension", _leaf(*[f"{q}{n}" for n in ("hr", "cad", "atemp", "speed", "power") for q in _PREFIX])) for p in _PREFIX]
GPX = T.StructType([
    _many("metadata", _leaf("name")),
    _many("trk", [*_leaf("name"), _many("trkseg", [_many("trkpt", [
        T.StructField("_lat", T.StringType()), T.StructField("_lon", T.StringType()), *_leaf("ele", "time", "speed"), _many("extensions", [*_leaf("power", "gpxtpx:power", "speed", "gpxtpx:speed"), *_TPE]),
    ])])]),
])
_TPX = [_many(n, _leaf("Speed", "ns3:Speed", "Watts", "ns3:Watts", "RunCadence", "ns3:RunCadence")) for n in ("TPX", "ns3:TPX", "ActivityTrackpointExtension")]
_TRACK = _many("Track", [_many("Trackpoint", [
    *_leaf("Time", "AltitudeMeters", "DistanceMeters", "Cadence"), _many("Position", _leaf("LatitudeDegrees", "LongitudeDegrees")), _many("HeartRateBpm", _leaf("Value")), _many("Extensions", _TPX),
])])
_RIDE = [*_leaf("Name"), _many("Lap", [_TRACK]), _TRACK]
TCX = T.StructType([_many("Activities", [_many("Activity", _RIDE)]), _many("Courses", [_many("Course", _RIDE)])])


def first(c: Column, *names: str) -> Column:
    """The first element of the first of these fields that is there."""
    return F.coalesce(*[F.get(c.getField(n), F.lit(0)) for n in names])


def documents(files: DataFrame, root: str, schema: T.StructType) -> DataFrame:
    """activity_id, root_ok and doc of each file."""
    head = F.lower(F.decode(F.expr("substring(content, 1, 200)"), "ISO-8859-1"))
    latin = head.rlike(r"encoding\s*=\s*[\"'](?:iso-8859-1|iso-8859-15|latin-?1|windows-1252|us-ascii)")
    # bytes that aren't valid in UTF-8 are read as Latin-1 or else replaced, so that one file can't fail the others
    text = F.when(latin, F.decode("content", "ISO-8859-1")).otherwise(F.coalesce(F.expr("try_validate_utf8(cast(content AS string))"), F.decode("content", "ISO-8859-1")))
    d = files.select(F.col("path").alias("activity_id"), text.alias("text"))
    xml = F.col("text")
    if root == "gpx":  # older files write <Name>
        xml = F.when(xml.contains("Name>"), F.regexp_replace(xml, r"<(/?)Name>", "<$1name>")).otherwise(xml)
    return d.select("activity_id", F.col("text").rlike(PROLOG + rf"<{root}[\s/>]").alias("root_ok"), F.from_xml(xml, schema, {"rowTag": root}).alias("doc"))


def number_points(df: DataFrame, *order: str) -> DataFrame:
    """seq from document positions."""
    from pyspark.sql.window import Window

    return df.withColumn("seq", (F.row_number().over(Window.partitionBy("activity_id").orderBy(*order)) - 1).cast("long"))


def _read(p: DataFrame, keep: tuple[str, ...], **leaves: tuple[str, Column]) -> DataFrame:
    """keep and the leaves, which are double, int, time or place (0 for none), as values. In steps of which each uses the one before more than once: Spark then merges none of them, and takes each leaf and each expression once a point."""
    kinds = {n: kind for n, (kind, _) in leaves.items()}
    text = {"double": number_text, "int": integer_text, "time": unix_time, "place": number_text}
    value = {"double": lambda c: parsed(c, "double"), "int": lambda c: parsed(c, "int"), "time": since_fit_epoch, "place": lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))}
    p = p.select(*keep, *[c.alias(n) for n, (_, c) in leaves.items()])
    p = p.select(*keep, *[text[kind](F.col(n)).alias(n) for n, kind in kinds.items()])
    return p.select(*keep, *[value[kind](F.col(n)).alias(n) for n, kind in kinds.items()])


def _valid(n: str, most: int) -> Column:
    return in_range(F.col(n), most)


def gpx_points(docs: DataFrame) -> DataFrame:
    """All points but those at 0, 0, in document order across tracks and segments."""
    p = docs.filter("root_ok").select("activity_id", F.posexplode("doc.trk").alias("k", "trk")).select("activity_id", "k", F.posexplode("trk.trkseg").alias("s", "seg"))
    p = p.select("activity_id", "k", "s", F.posexplode("seg.trkpt").alias("i", "p"))
    x = F.get(F.col("p.extensions"), F.lit(0))
    e = F.coalesce(*[F.get(x.getField(f"{q}TrackPointExtension"), F.lit(0)) for q in _PREFIX])
    leaf = lambda n: first(e, *[f"{q}{n}" for q in _PREFIX])
    p = _read(
        p, ("activity_id", "k", "s", "i"), lat=("place", F.col("p._lat")), lon=("place", F.col("p._lon")), elevation=("double", first(F.col("p"), "ele")), t_fit=("time", first(F.col("p"), "time")),
        hr=("int", leaf("hr")), cad=("int", leaf("cad")), power=("int", F.coalesce(first(x, "power", "gpxtpx:power"), first(e, "gpxtpx:power", "power"))), temp=("int", leaf("atemp")),
        speed=("double", F.coalesce(first(F.col("p"), "speed"), leaf("speed"))),
    )
    p = p.select(
        "activity_id", "k", "s", "i", "lat", "lon", "elevation", "t_fit", _valid("hr", 255).cast("short").alias("heart_rate"), _valid("cad", 255).cast("short").alias("cadence"),
        _valid("power", 65535).alias("power"), F.col("temp").try_cast("byte").alias("temperature"), F.col("speed").alias("speed_sensor_ms"), F.lit(None).cast("double").alias("src_distance_m"),
    ).filter("NOT (lat = 0 AND lon = 0)")
    return _finish(p, "k", "s", "i")


def tcx_points(docs: DataFrame) -> DataFrame:
    """Activities, or courses where there are none. Within a ride, laps come before tracks outside of laps."""
    a = docs.filter("root_ok").select("activity_id", F.posexplode(F.when(F.col("doc.Activities").isNotNull(), F.flatten("doc.Activities.Activity")).otherwise(F.flatten("doc.Courses.Course"))).alias("k", "ride"))
    laps = F.transform(F.coalesce("ride.Lap", F.expr("array()").cast(_RIDE[1].dataType)), lambda lap: lap["Track"])
    tracks = F.concat(F.coalesce(F.flatten(F.filter(laps, lambda x: x.isNotNull())), F.expr("array()").cast(_TRACK.dataType)), F.coalesce("ride.Track", F.expr("array()").cast(_TRACK.dataType)))
    p = a.select("activity_id", "k", F.posexplode(tracks).alias("s", "track")).select("activity_id", "k", "s", F.posexplode("track.Trackpoint").alias("i", "p"))
    pos, hr, ext = (F.get(F.col(f"p.{n}"), F.lit(0)) for n in ("Position", "HeartRateBpm", "Extensions"))
    x = F.coalesce(*[F.get(ext.getField(n), F.lit(0)) for n in ("TPX", "ns3:TPX", "ActivityTrackpointExtension")])
    lat, lon = first(pos, "LatitudeDegrees"), first(pos, "LongitudeDegrees")
    both = lat.isNotNull() & lon.isNotNull()
    p = _read(
        p, ("activity_id", "k", "s", "i"), lat=("place", F.when(both, lat)), lon=("place", F.when(both, lon)), elevation=("double", first(F.col("p"), "AltitudeMeters")), t_fit=("time", first(F.col("p"), "Time")),
        hr=("int", first(hr, "Value")), cad=("int", first(F.col("p"), "Cadence")), steps=("int", first(x, "RunCadence", "ns3:RunCadence")), power=("int", first(x, "Watts", "ns3:Watts")), speed=("double", first(x, "Speed", "ns3:Speed")), src_distance_m=("double", first(F.col("p"), "DistanceMeters")),
    )
    p = p.select(
        "activity_id", "k", "s", "i", "lat", "lon", "elevation", "t_fit", _valid("hr", 255).cast("short").alias("heart_rate"),
        F.coalesce(_valid("cad", 255), _valid("steps", 255)).cast("short").alias("cadence"), _valid("power", 65535).alias("power"), F.lit(None).cast("byte").alias("temperature"), F.col("speed").alias("speed_sensor_ms"), "src_distance_m",
    ).filter("NOT (lat = 0 AND lon = 0)")
    return _finish(p, "k", "s", "i")


def _finish(p: DataFrame, *order: str) -> DataFrame:
    p = number_points(p, *order).withColumn("ts", fit_instant(F.col("t_fit")))
    return p.select("activity_id", "seq", "lat", "lon", "elevation", "t_fit", "ts", "heart_rate", "cadence", "power", "temperature", "speed_sensor_ms", "src_distance_m")


def gpx_names(docs: DataFrame) -> DataFrame:
    """The metadata name, or else the first track name that isn't empty."""
    name = F.get(F.filter(F.flatten(F.filter(F.transform("doc.trk", lambda t: t["name"]), lambda x: x.isNotNull())), lambda n: n != ""), F.lit(0))
    return docs.select("activity_id", F.coalesce(F.nullif(first(F.get(F.col("doc.metadata"), F.lit(0)), "name"), F.lit("")), name).alias("name"))


def tcx_names(docs: DataFrame) -> DataFrame:
    rides = F.coalesce(F.flatten("doc.Activities.Activity"), F.flatten("doc.Courses.Course"))
    return docs.select("activity_id", F.get(F.filter(F.flatten(F.filter(F.transform(rides, lambda r: r["Name"]), lambda x: x.isNotNull())), lambda n: n != ""), F.lit(0)).alias("name"))


def xml_errors(docs: DataFrame, points: DataFrame, root: str) -> DataFrame:
    """Files with another root, that can't be read, or without a valid point."""
    some = points.select("activity_id").distinct().withColumn("some", F.lit(True))
    e = docs.join(some, "activity_id", "left")
    why = F.when(~F.col("root_ok"), f"no <{root}> root element").when(F.col("some").isNull(), "malformed, or without a valid point")
    return e.select(F.col("activity_id").alias("path"), why.alias("reason")).filter(F.col("reason").isNotNull())
