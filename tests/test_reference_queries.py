"""Every registered query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

from tessera.plans.queries import ORACLES, QUERIES

TABLES = "embeddings events".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect(config={"memory_limit": "3GB", "threads": 2, "temp_directory": ""})
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    for c in columns:
        if got[c].dtype.kind == "f":
            assert (abs(got[c] - want[c]) < 1e-9).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
