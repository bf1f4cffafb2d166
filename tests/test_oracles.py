"""Every query against its oracle in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "as_integer_ratio"):
        return None if v != v else round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_matches_oracle(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(catalog.oracles()[name])
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs_without_oracle(name, spark, sf):
    df = catalog.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
