import pytest

import __spark_entry__ as entry
from velotrace.plans import rides

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(rides.SQL))
def test_query_equals_sql(spark, duck, same, name):
    same(rides.QUERIES[name](spark, SF), duck(SF).execute(rides.SQL[name]).df())


def test_one_exchange_before_the_window(spark):
    plan = rides.ride_distance(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_json_is_read_back(spark):
    import json

    row = rides.ride_json(spark, SF).first()
    doc = json.loads(row.json)
    assert len(doc["coordinates"]) == doc["summary"]["points"] > 0
    assert "heartRate" in "".join(map(str, doc["coordinates"])) and all(v is not None for v in doc["summary"].values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
