"""Every registered query against its DuckDB statement (the driver's gate)."""

import pytest

import __spark_entry__ as entry_mod
from compare import rows_of_duck, rows_of_spark

Q = entry_mod.queries()
SQL = entry_mod.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = Q[name](spark, sf_dir)
    scols, srows = rows_of_spark(df)
    dcols, drows = rows_of_duck(duck, SQL[name])
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(Q)


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
