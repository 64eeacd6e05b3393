"""Every query of the core with SQL gives the rows that DuckDB gives."""

import os
from collections import Counter

import duckdb
import pytest

from corvane import plans

QUERIES = {k: v for m in plans.modules() for k, v in m.QUERIES.items()}
SQL = {k: v for m in plans.modules() for k, v in m.SQL.items()}
TABLES = ["documents", "doc_states", "runs", "chunks", "records", "quarantine", "exports", "eval", "embeddings"]


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{os.path.join(sf, t)}.parquet'")
    return c


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    want = db.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = Counter(tuple(_plain(v) for v in r) for r in df.select(*cols).collect())
    assert got == Counter(tuple(_plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
