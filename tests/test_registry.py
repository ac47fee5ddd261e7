"""Every registered query of the point engine against its SQL in DuckDB, and the driver's contract."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from pointloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table(got, df.columns) == table(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_morton_codes_of_cells_beyond_ten_bits_match_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute("""CREATE TABLE events AS SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_days(i::INTEGER * 150) AS ts, 'view' AS event_type,
      i * 700.5 - 2000 AS value, (i * 1021) % 5000 AS user_id FROM range(12) r(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in registry.QUERIES["morton3"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(registry.ORACLES["morton3"]).fetchall())


def test_contract(spark):
    assert entry_module.entry(spark).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
