"""Every registered query against its SQL, and shape checks for those without."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, str | bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    number = float(v)
    return "nan" if math.isnan(number) else f"{number:.6g}"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "canonical_id", "group_size", "is_canonical"] and df.count() > 0


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
