"""The queries that SQL can express, against it, on a table of their own and on the driver's."""

import duckdb
import pytest

from plumbline.llm import queries as Q


def compare(df, sql, con):
    names = sorted(df.columns)
    got = con.execute(sql)
    have = [c[0] for c in got.description]
    assert sorted(have) == names
    rows = lambda found, pick: sorted(repr([pick(r, n) for n in names]) for r in found)
    assert rows(df.collect(), lambda r, n: r[n]) == rows(got.fetchall(), lambda r, n: r[have.index(n)])


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    compare(Q.queries()[name](spark, sf_dir), Q.oracle_sql()[name], con)
