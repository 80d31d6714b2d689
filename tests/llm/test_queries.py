"""Every registered training-data query that has SQL, against DuckDB on the smallest tables."""
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

from marketgrid.llm.queries import ORACLE, QUERIES  # noqa: E402
from oracle_check import digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_its_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    found = con.execute(ORACLE[key])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(rows, df.columns) == digest(found.fetchall(), columns)
