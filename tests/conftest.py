import collections
import glob
import os

import duckdb
import pandas as pd
import pytest

from velotrace.session import session

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    def connect(folder):
        c = duckdb.connect()
        for p in glob.glob(f"{folder}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        return c

    return connect


def bag(frame: pd.DataFrame, cols: list[str]) -> collections.Counter:
    def plain(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return None
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return str(v)

    return collections.Counter(tuple(map(plain, r)) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(df, frame):
        got = df.toPandas()
        cols = sorted(got.columns)
        assert cols == sorted(frame.columns)
        a, b = bag(got, cols), bag(frame, cols)
        assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])

    return check
