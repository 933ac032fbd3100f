"""The worked examples: operators on files, mails, requests and answers written there."""

import duckdb
import pytest

from tests.test_queries import SF, TABLES, rows
from tests.worked import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_example(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
