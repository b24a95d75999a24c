"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from typedframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{DIR}/{n}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    number = lambda rs: [tuple(str(float(v)) if v is not None and v.replace(".", "", 1).lstrip("-").isdigit() else v for v in r) for r in rs]
    assert number(rows(got)) == number(rows(want))
