"""One bad file is one row of errors, never an exception; odometers, odd encodings, checksums and plans."""

import struct

import numpy as np

from velotrace import api
from velotrace.sources import fit, fitcodec

GPX = '<gpx version="1.1"><trk><name>N</name><trkseg>{}</trkseg></trk></gpx>'
POINT = '<trkpt lat="52.{0}" lon="4.5"><ele>{0}</ele><time>2024-05-01T10:00:0{0}Z</time>{1}</trkpt>'


def track(extra=""):
    return GPX.format("".join(POINT.format(k, extra) for k in range(1, 4)))


def test_bad_files_are_rows(spark, tmp_path):
    src = tmp_path / "in dir"
    src.mkdir()
    (src / "good.gpx").write_text(track())
    (src / "latin.gpx").write_bytes(b'<?xml version="1.0" encoding="ISO-8859-1"?>' + track().replace("<name>N", "<name>\xe9t\xe9").encode("latin-1"))
    (src / "undeclared.gpx").write_bytes(track().replace("<name>N", "<name>\xe9").encode("latin-1"))
    (src / "hot.gpx").write_text(track("<extensions><gpxtpx:TrackPointExtension><gpxtpx:atemp>300</gpxtpx:atemp></gpxtpx:TrackPointExtension></extensions>"))
    (src / "far.gpx").write_text(track().replace('lon="4.5"', 'lon="200"'))
    (src / "zero bytes.fit").write_bytes(b"")
    body = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 9) + bytes([253, 4])
    whole = struct.pack("<BBHI4s", 12, 16, 0, len(body), b".FIT") + body
    (src / "cut.fit").write_bytes(whole + struct.pack("<H", fitcodec.crc16(whole)))
    rides = api.read(spark, str(src))
    assert {r.path.rsplit("/", 1)[1] for r in rides.errors.collect()} == {"zero bytes.fit", "cut.fit"}
    names = {r.activity_id.rsplit("/", 1)[1]: r.name for r in rides.activities.collect()}
    assert names == {"good.gpx": "N", "latin.gpx": "\xe9t\xe9", "undeclared.gpx": "\xe9", "hot.gpx": "N", "far.gpx": "N"}
    assert {r.points for r in rides.summary().collect()} == {3}
    assert {r.temperature for r in rides.points.collect()} == {None}
    written, report = api.convert(spark, str(tmp_path / "out"), str(src / "good.gpx"), str(src / "far.gpx"))
    assert written.count() == 2 and report.count() == 2
    back = {r.points for r in api.read(spark, str(tmp_path / "out")).summary().collect()}
    assert back == {3, 0}  # a longitude that no FIT field holds is no position
    _, status = api.trim(spark, str(tmp_path / "cut"), "500 m", "x", str(tmp_path / "out"))
    assert {r.status for r in status.collect()} == {'{"status":"error","message":"Invalid trim distance"}'}
    _, status = api.trim(spark, str(tmp_path / "cut"), "0", 0, str(tmp_path / "out"), str(src))
    got = sorted(r.status for r in status.collect())
    assert sum('"ok"' in x for x in got) == 1 and any("no GPS points" in x for x in got) and any("file is empty" in x for x in got)


def test_tcx_totals_are_the_odometer(spark, tmp_path):
    tp = '<Trackpoint><Time>2024-05-01T10:00:0{0}Z</Time><Position><LatitudeDegrees>52.00{0}</LatitudeDegrees><LongitudeDegrees>4</LongitudeDegrees></Position><DistanceMeters>{1}</DistanceMeters></Trackpoint>'
    (tmp_path / "a.tcx").write_text("<TrainingCenterDatabase><Activities><Activity><Lap><Track>" + tp.format(1, 100) + tp.format(2, 5000) + "</Track></Lap></Activity></Activities></TrainingCenterDatabase>")
    rides = api.read(spark, str(tmp_path))
    s = rides.summary().first()
    assert (s.distanceKm, s.sessionDistanceKm) == (5.0, 5.0)
    _, report = api.convert(spark, str(tmp_path / "out"), str(tmp_path / "a.tcx"))
    assert report.first().km == 5.0
    assert api.read(spark, str(tmp_path / "out")).session.first().total_distance_m == 5000.0


def test_each_file_is_decoded_once(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(track())
    api.convert(spark, str(tmp_path / "out"), str(tmp_path / "a.gpx"))
    rides = api.read(spark, str(tmp_path))
    rides.json().collect()
    plan = rides.json()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") > 1 and all(t.storageLevel.useDisk for t in rides._kept)
    rides.release()


def test_checksum_of_long_data():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4095, 4096, 5000, 70_001):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        crc = 0x1234
        for b in data:
            crc = crc >> 8 ^ fitcodec._CRC[(crc ^ b) & 0xFF]
        assert fitcodec.crc16(data, 0x1234) == crc


def test_runs_of_mixed_shapes(spark):
    w, want = fitcodec.Writer(), []
    for k in range(300):
        fields = [(253, fitcodec.UINT32, 1000 + k), (0, fitcodec.SINT32, k), (1, fitcodec.SINT32, -k)] + ([(3, fitcodec.UINT8, k % 200 + 1)] if k % 90 < 70 else [])
        w.add(fitcodec.RECORD, fields)
        want.append((k, 1000 + k, k % 200 + 1 if k % 90 < 70 else None))
        if k % 100 == 50:
            w.add(fitcodec.EVENT, [(253, fitcodec.UINT32, 1)])
    df = spark.createDataFrame([("a.fit", bytearray(w.close()))], "path string, content binary")
    got = fit.points(fit.read_messages(df)).orderBy("seq").collect()
    assert [(r.seq, r.t_fit, r.heart_rate) for r in got] == want
