"""Every registered query that has an oracle, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def plain(rows):
    out = []
    for row in rows:
        out.append([None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, float) else v for v in row])
    return sorted(out, key=lambda r: [f"{v:.6g}" if isinstance(v, float) else str(v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_oracle(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == names
    got = plain(df.select(*[f"`{n}`" for n in names]).collect())
    want = plain(relation.project(", ".join(f'"{n}"' for n in names)).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)), (a, b)


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
