"""Every query of the library against its SQL, or for rows and schema where SQL has no such operation."""

from __future__ import annotations

import comparing
import pytest

from skerry import catalogue

DIR = "/root/testdata/sf0.01"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    got = comparing.spark_rows(catalogue.queries()[name](spark, DIR))
    assert comparing.difference(got, comparing.duck_rows(DIR, SQL[name])) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, DIR)
    assert df.columns and len(df.columns) == len(set(map(str.lower, df.columns)))
    assert df.limit(1000).collect(), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
