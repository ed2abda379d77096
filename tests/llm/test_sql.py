"""The corpus operators' queries against their SQL, on whole tables."""

from __future__ import annotations

import comparing
import pytest

from skerry.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    got = comparing.spark_rows(queries.queries()[name](spark, DIR))
    assert comparing.difference(got, comparing.duck_rows(DIR, queries.oracle_sql()[name])) == ""
