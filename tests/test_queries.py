"""Every registered query that SQL can express, against DuckDB."""

import math

import duckdb
import pytest

from blockloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = sorted(tuple(map(repr, (value(r[c]) for c in columns))) for r in got.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    wanted = sorted(tuple(map(repr, (value(r[names.index(c)]) for c in columns))) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert found == wanted


def test_wide_text_of_no_cents_has_no_sign(spark, sf_dir, tmp_path):
    """Of the given tables only sf0.1 has values of 0.00."""
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(20).withColumn("value", F.expr("event_id % 3 / 100D")).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["event_id"]: (r["unsigned"], r["signed"]) for r in registry.queries()["uint256_text"](spark, str(tmp_path)).collect()}
    assert len(found) == 20
    assert all(found[k] == (str((k % 3) << 96), str(-(k % 3))) for k in found)
