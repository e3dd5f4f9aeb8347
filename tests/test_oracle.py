"""Every query with SQL gives the rows of that SQL in DuckDB."""

import os

import duckdb
import pytest

from reconcord.plans import queries as plans
from reconcord.plans import audit, reads, streams  # noqa: F401  register their queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].convert_dtypes()
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    wanted = duck.execute(plans.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
