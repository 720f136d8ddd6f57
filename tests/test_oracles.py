import decimal
import glob
import os

import duckdb
import pytest

from inquest.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(value):
    return round(float(value), 6) if isinstance(value, (float, decimal.Decimal)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([norm(v) for v in row]) for row in found.fetchall())
    assert sorted(str([norm(row[c]) for c in columns]) for row in df.collect()) == want
