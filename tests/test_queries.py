"""Queries against their SQL on the smallest tables."""

import os

import pytest

from fieldweave.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "supplier lineitem events documents embeddings pages".split()


def rows(frame):
    columns = sorted(frame.columns)
    return sorted([tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in frame[columns].itertuples(index=False)], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(connection.sql(ORACLES[name]).df())
