"""Totals of the SESSION message against the SQL of fit_session_message, where rounding and field widths matter."""

import datetime

from velotrace.plans import rides
from velotrace.sources import fitcodec


def session(**stats):
    none = dict.fromkeys(("avg_heart_rate", "max_heart_rate", "avg_cadence", "max_cadence", "avg_power", "max_power", "avg_speed_ms", "max_speed_ms", "ascent_m", "descent_m"))
    point = {"lat": 50.0, "lon": 4.0, "t_fit": 1}
    data = fitcodec.encode_activity([point], none | {"start_fit": 1, "end_fit": 2, "elapsed_s": 1, "distance_m": 0.0} | stats)
    return next(v for n, v in fitcodec.messages(data) if n == fitcodec.SESSION)


def test_halves_go_up():
    assert [session(ascent_m=m)[22] for m in (0.5, 150.5, 151.5, 70000.0)] == [1, 151, 152, 65534]


def test_long_totals_are_whole():
    s = session(elapsed_s=19_831_805, distance_m=60_000_000.25)
    assert (s[7], s[8], s[9]) == (19_831_805_000, 19_831_805_000, 6_000_000_025)


def test_query_equals_sql(spark, duck, same, tmp_path):
    """A ride of 300 days, with an ascent of exactly 150.5 m, and one of 40 seconds that climbs 80 km."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(days=100 * k), 1, "view", v, '{"k": 5}') for k, v in enumerate((200.0, 1705.0, 100.0, 50.0))]
    rows += [(k, day + datetime.timedelta(seconds=k), 2, "view", 40_000.0 * (k % 2), '{"k": 5}') for k in range(10, 50)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "events.parquet")
    want = duck(str(tmp_path)).execute(rides.SQL["fit_session_message"]).df()
    assert sorted(want.total_ascent_m) == [151.0, 65534.0] and want.total_elapsed_s.max() == 300 * 86400
    same(rides.fit_session_message(spark, str(tmp_path)), want)
