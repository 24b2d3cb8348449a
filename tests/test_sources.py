import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velotrace import api
from velotrace.functions import scalar as X
from velotrace.operators import summary as S
from velotrace.operators import tracks as K
from velotrace.operators import trim as R
from velotrace.sources import fit, fitcodec, xml
from velotrace.streaming.ingest import ingest_fit


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def gpx(body, root="gpx"):
    return f'<?xml version="1.0"?><{root} xmlns:gpxtpx="x">{body}</{root}>'


def load(spark, text, kind="gpx"):
    df = spark.createDataFrame([("a." + kind, bytearray(text.encode()))], "path string, content binary")
    return xml.documents(df, *(("gpx", xml.GPX) if kind == "gpx" else ("TrainingCenterDatabase", xml.TCX)))


def rows(df):
    return df.orderBy("seq").collect()


def test_scalars(spark):
    assert one(spark, X.scaled_round(F.lit(1.005), 2)) == 1.0
    assert one(spark, X.scaled_round(F.lit(-2.5), 0)) == -3.0
    assert one(spark, X.fit_time(F.lit("2024-05-01T10:00:00.5+02:00"))) == one(spark, X.fit_time(F.lit("2024-05-01 10:00:00"))) == 1714557600 - 631065600
    for bad in ("", "x", "1980-01-01T00:00:00Z"):
        assert one(spark, X.fit_time(F.lit(bad))) == 0
    assert one(spark, X.iso_time(F.lit(0))) == "1989-12-31T00:00:00Z"
    assert one(spark, X.integer(F.lit("14.5"))) == 14 and one(spark, X.integer(F.lit("-5.5"))) == -5 and one(spark, X.integer(F.lit("abc"))) == 0
    assert one(spark, X.semicircles(F.lit(-1e-7))) == -1
    assert one(spark, X.ascii_only(F.lit("Zwïft"))) == "Zw?ft"
    assert one(spark, X.extension(F.lit("/a.b/c.GPX"))) == ".gpx"
    assert one(spark, X.is_indoor(F.lit(None).cast("int"), F.lit(260))) and not one(spark, X.is_indoor(F.lit(None).cast("int"), F.lit(None).cast("int")))
    assert abs(one(spark, X.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111194.979) < 0.01


def test_gpx(spark):
    ext = '<extensions><gpxtpx:TrackPointExtension><gpxtpx:hr>{}</gpxtpx:hr><gpxtpx:cad>0</gpxtpx:cad><gpxtpx:atemp>-5.5</gpxtpx:atemp><gpxtpx:power>210</gpxtpx:power></gpxtpx:TrackPointExtension></extensions>'
    body = (
        '<trk><Name></Name><trkseg><trkpt lat="0" lon="0"/><trkpt lat="52.1" lon="4.1"><ele>1.5</ele><time>2024-05-01T10:00:00Z</time><speed>3.5</speed>' + ext.format(256) + "</trkpt></trkseg></trk>"
        '<trk><Name>Late</Name><trkseg><trkpt lat="0" lon="4.2"><ele>-2</ele>' + ext.format(140) + '</trkpt></trkseg><trkseg><trkpt lat="52.3" lon="4.3"/></trkseg></trk>'
    )
    docs = load(spark, gpx(body))
    p = rows(xml.gpx_points(docs))
    assert [(r.lat, r.lon) for r in p] == [(52.1, 4.1), (0.0, 4.2), (52.3, 4.3)]
    assert (p[0].heart_rate, p[0].cadence, p[0].power, p[0].temperature, p[0].speed_sensor_ms) == (None, None, 210, -5, 3.5)
    assert p[1].heart_rate == 140 and p[1].elevation == -2.0 and p[1].t_fit == 0 and p[2].elevation is None
    assert xml.gpx_names(docs).first().name == "Late"
    steps = rows(K.with_steps(xml.gpx_points(docs)))
    assert steps[0].seg_m is None and steps[2].seg_m > 0  # the chain runs across segments and tracks


def test_gpx_errors(spark):
    for text, why in ((gpx("", "kml"), "root"), ("<gpx><trk>", "malformed"), (gpx("<trk/>"), "valid point")):
        docs = load(spark, text)
        assert why in xml.xml_errors(docs, xml.gpx_points(docs), "gpx").first().reason
    assert rows(xml.gpx_points(load(spark, "﻿" + gpx('<trk><trkseg><trkpt lat="1" lon="1"/></trkseg></trk>'))))


TP = "<Trackpoint><Position><LatitudeDegrees>{}</LatitudeDegrees><LongitudeDegrees>4.0</LongitudeDegrees></Position>{}</Trackpoint>"


def test_tcx(spark):
    d = "<DistanceMeters>{}</DistanceMeters>"
    laps = "<Lap><Track>" + TP.format(52.0, d.format(0)) + TP.format(52.001, d.format(0)) + "</Track></Lap><Lap><Track>" + TP.format(52.002, d.format(1000)) + TP.format(52.003, "<Extensions><TPX><RunCadence>80</RunCadence><Watts>0</Watts></TPX></Extensions>") + TP.format(52.004, d.format(-5)) + "</Track></Lap>"
    ride = load(spark, f"<TrainingCenterDatabase><Activities><Activity><Id>1</Id>{laps}</Activity></Activities></TrainingCenterDatabase>", "tcx")
    p = rows(K.with_odometer(K.with_steps(xml.tcx_points(ride))))
    step = p[1].seg_m
    assert [round(r.cum_dist_m - w, 3) for r, w in zip(p, (0, step, 1000, 1000 + step, 1000 + step))] == [0] * 5
    assert p[3].cadence == 80 and p[3].power is None
    course = load(spark, f"<TrainingCenterDatabase><Courses><Course><Name>C</Name><Track>{TP.format(51.0, '')}</Track></Course></Courses></TrainingCenterDatabase>", "tcx")
    assert rows(xml.tcx_points(course))[0].lat == 51.0 and xml.tcx_names(course).first().name == "C"


def points(spark, data):
    cols = "activity_id string, seq long, lat double, lon double, elevation double, t_fit long, ts timestamp, heart_rate short, cadence short, power int, temperature byte, speed_sensor_ms double, src_distance_m double"
    return spark.createDataFrame(data, cols)


def test_clock_and_backfill(spark):
    p = points(spark, [("a", i, 52.0 + i / 100, 4.0, None, t, None, None, None, None, None, None, None) for i, t in enumerate((100, 160, 160, 150))])
    r = rows(K.with_backfill(K.with_steps(p)))
    assert [x.dt_s for x in r] == [None, 60, 0, 4294967286]
    assert r[0].speed_shown == r[1].speed_kmh and r[2].speed_kmh is None and r[3].speed_kmh == 0.0
    s = S.summarize(p).first()
    assert s.movingTimeSec == 60 and s.durationMin == 0.83


def test_trim(spark):
    p = points(spark, [("a", i, 52.0 + i / 1000, 4.0, 1.0, i, None, 100, None, None, None, None, None) for i in range(10)])
    assert R.counts(R.zones(p, 0, 0)).first()[1:] == (0, 0)
    assert R.counts(R.zones(p, 1e6, 1e6)).first()[1:] == (10, 0)
    t = rows(R.trim(p, 150, 150))
    assert [x.lat is None for x in t] == [True, True, False, False, False, False, False, False, True, True] and all(x.heart_rate == 100 for x in t)


def test_fit_protocol():
    w = fitcodec.Writer()
    w.add(fitcodec.RECORD, [(253, fitcodec.UINT32, 1000), (3, fitcodec.UINT8, 0)])
    data = w.close()
    assert list(fitcodec.messages(data)) == [(20, {253: 1000, 3: 0})]
    assert len(list(fitcodec.messages(data + data))) == 2
    with pytest.raises(fitcodec.FitError):
        list(fitcodec.messages(data[:-1] + bytes([data[-1] ^ 1])))
    import struct

    # big endian, a developer field and a compressed timestamp
    body = bytes([0x60, 0, 1]) + struct.pack(">HB", 20, 2) + bytes([253, 4, 0x86, 7, 2, 0x84]) + bytes([1, 0, 1, 0]) + bytes([0x00]) + struct.pack(">IHB", 64, 250, 9)
    body += bytes([0x41, 0, 0]) + struct.pack("<HB", 20, 1) + bytes([3, 1, 2]) + bytes([0x80 | 1 << 5 | 3, 99]) + bytes([0x80 | 1 << 5 | 1, 255])
    head = struct.pack("<BBHI4s", 12, 16, 0, len(body), b".FIT")
    whole = head + body
    got = list(fitcodec.messages(whole + struct.pack("<H", fitcodec.crc16(whole))))
    assert got == [(20, {253: 64, 7: 250}), (20, {253: 67, 3: 99}), (20, {253: 97})]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-89, 89), st.floats(-179, 179), st.integers(1, 10**9), st.one_of(st.none(), st.integers(1, 254))), min_size=1, max_size=20))
def test_fit_round_trip(data):
    pts = [{"lat": a, "lon": b, "t_fit": t, "heart_rate": h, "cadence": None, "power": None, "temperature": None, "elevation": 10.0, "cum_dist_m": 0.0, "speed_sensor_ms": None} for a, b, t, h in data]
    stats = dict.fromkeys(("avg_heart_rate", "max_heart_rate", "avg_cadence", "max_cadence", "avg_power", "max_power", "avg_speed_ms", "max_speed_ms", "ascent_m", "descent_m"))
    stats |= {"start_fit": 1, "end_fit": 2, "elapsed_s": 1, "distance_m": 0.0}
    got = [v for n, v in fitcodec.messages(fitcodec.encode_activity(pts, stats)) if n == fitcodec.RECORD]
    assert [(g[253], g.get(3)) for g in got] == [(p["t_fit"], p["heart_rate"]) for p in pts]
    assert all(abs(g[0] * 180 / 2**31 - p["lat"]) < 1e-6 for g, p in zip(got, pts))


def test_sessions_and_zero_sensors(spark):
    w = fitcodec.Writer()
    w.add(fitcodec.FILE_ID, [(1, fitcodec.UINT16, 260), (2, fitcodec.UINT16, 5), (8, fitcodec.STRING, "Zwïft")])
    w.add(fitcodec.RECORD, [(253, fitcodec.UINT32, 5), (0, fitcodec.SINT32, 10), (1, fitcodec.SINT32, 10), (3, fitcodec.UINT8, 0)])
    w.add(fitcodec.RECORD, [(253, fitcodec.UINT32, 6), (3, fitcodec.UINT8, 90)])
    w.add(fitcodec.SESSION, [(9, fitcodec.UINT32, 5000), (22, fitcodec.UINT16, 7)])
    w.add(fitcodec.SESSION, [(9, fitcodec.UINT32, 9000), (6, fitcodec.ENUM, 6)])
    df = spark.createDataFrame([("a.fit", bytearray(w.close())), ("b.fit", bytearray(b"nothing at all"))], "path string, content binary")
    m = fit.read_messages(df)
    p = fit.points(m).collect()
    assert len(p) == 1 and p[0].heart_rate == 0  # a valid zero counts; records without a position don't
    s = fit.sessions(m).first()
    assert (s.total_distance_m, s.total_ascent_m, s.sub_sport) == (90.0, 7.0, 6)
    f = fit.file_ids(m).first()
    assert (f.manufacturer, f.garmin_product, f.product_name) == (260, None, "Zw?ft")
    assert fit.errors(m).first().path == "b.fit"


def test_files(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    pts = "".join(f'<trkpt lat="{52 + i / 1000}" lon="4.5"><ele>{i}</ele><time>2024-05-01T10:00:{i:02d}Z</time></trkpt>' for i in range(30))
    (src / "a.gpx").write_text(gpx(f"<trk><name>A</name><trkseg>{pts}</trkseg></trk>"))
    (src / "b.gpx").write_text("<gpx><trk>")
    (src / "c.txt").write_text("x")
    (src / "d.fit").write_bytes(b"")
    rides = api.read(spark, str(src))
    assert rides.summary().count() == 1 and rides.summary().first().points == 30
    assert sorted(os.path.basename(r.path) for r in rides.errors.collect()) == ["b.gpx", "c.txt", "d.fit"]
    with pytest.raises(ValueError):
        api.read(spark, str(src), strict=True)
    written, report = api.convert(spark, str(out), str(src / "a.gpx"))
    made = written.collect()
    assert len(made) == 1 and report.first().points == 30 and report.first().ascent == 29
    with pytest.raises(ValueError):
        api.convert(spark, str(out), str(out))
    back = api.read(spark, str(out))
    assert back.summary().first().points == 30
    cut, status = api.trim(spark, str(tmp_path / "cut"), 500, 500, str(out))
    cut.collect()
    assert '"status":"ok","stripped_start":5,"stripped_end":5' in status.first().status
    assert api.read(spark, str(tmp_path / "cut")).summary().first().points == 20
    q = ingest_fit(spark, str(out), str(tmp_path / "table"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "table")).filter("kind = 'record'").count() == 30
