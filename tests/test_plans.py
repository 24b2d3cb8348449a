"""Work per point in the plans of the file queries."""

import pytest

from velotrace.plans import rides
from velotrace.sources import fitcodec

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, leaves", [("gpx_scan", 7), ("tcx_scan", 8)])
def test_each_number_is_searched_once(spark, name, leaves):
    """Once a leaf, and once more for lat and lon in the filter of null island."""
    assert optimized(rides.QUERIES[name](spark, SF)).count("regexp_extract(") <= leaves + 2


def test_fit_files_group_once(spark):
    plan = optimized(rides.fit_roundtrip(spark, SF))
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_checksum_of_blocks():
    data = bytes((7 * k * k + k // 3) % 256 for k in range(9000))
    for n in (0, 1, 2, 4095, 4096, 4097, 8192, 8193, 9000):
        for start in (0, 1, 0xBEEF):
            crc = start
            for b in data[:n]:
                crc ^= b
                for _ in range(8):
                    crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
            assert fitcodec.crc16(data[:n], start) == crc
