"""Session fields over all messages of a ride, against plain Python."""

import collections
import json

import pandas as pd

from velotrace.plans import rides

SF = "/root/testdata/sf0.001"


def test_last_values_of_whole_rides(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    tracks = collections.defaultdict(list)
    for r in e.itertuples():
        tracks[str(r.user_id)].append((r.ts.floor("s"), r.event_id, json.loads(r.props)["k"]))
    want, device = {}, {}
    for ride, rows in tracks.items():
        last = [None] * 4
        for seq, (_, _, k) in enumerate(sorted(rows)):
            got = [k / 10 if (k + seq) % 2 else None, round(k * 0.9, 1) if (k + seq) % 3 else None, k % 70 if (k + seq) % 4 else None, k * 7 % 400 if (k + seq) % 2 else None]
            last = [old if new is None else new for old, new in zip(last, got)]
            if got[0] is not None and (got[2] or 0) > 30:
                device[ride] = got[0]
        want[ride] = last
    assert max(map(len, tracks.values())) > 9
    got = {r.activity_id: [r.sessionDistanceKm, r.sessionMaxSpeedKmh, r.sub_sport, r.manufacturer] for r in rides.session_last_valid(spark, SF).collect()}
    assert got == want
    indoor = {r.activity_id: r.isIndoor for r in rides.indoor_flag(spark, SF).collect()}
    assert indoor == {k: v[2] in (6, 58) or v[3] in (260, 144, 331, 67) for k, v in want.items()}
    km = {r.activity_id: r.sessionDistanceKm for r in rides.session_preference(spark, SF).collect()}
    assert km.keys() == want.keys() and {k: km[k] for k in device} == device
