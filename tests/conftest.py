import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from factloom.session import get_spark

    session = get_spark("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    import glob

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows_of(df_rows, columns):
    """Rows as a sorted multiset of plain values, columns by name."""
    import math
    from collections import Counter

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if hasattr(v, "normalize") and not isinstance(v, str):
            return float(v)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in df_rows)
