import duckdb
import numpy as np
import pytest

import __spark_entry__
from tesseral.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in queries.ORACLE_SQL:
        return
    want = duck.sql(queries.ORACLE_SQL[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    names = sorted(want.columns)
    keys = [c for c in names if want[c].dtype.kind != "f"]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in names:
        if b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
