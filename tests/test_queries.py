"""Every registered query beside its SQL on the smallest tables; none may be vacuous."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lexloom.plans import registry

SF = os.environ.get("LEXLOOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Queries that may be empty on the smallest tables.
SPARSE = {"scroll_page", "scroll_state"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = _plain(df.select(*columns).collect())
    assert rows or name in SPARSE
    if name in registry.ORACLE_SQL:
        other = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(other.columns) == columns
        assert _plain(other.select(*(f'"{c}"' for c in columns)).fetchall()) == rows
