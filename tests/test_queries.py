"""Every registered query against its SQL, at the smallest scale."""

import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return repr(round(float(v), 8) + 0.0)
    return repr(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    have = [c[0] for c in got.description]
    assert sorted(have) == names
    assert rows == sorted(tuple(plain(r[have.index(c)]) for c in names) for r in got.fetchall())
