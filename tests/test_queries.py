"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

from outcomelens.oracles import ORACLES
from outcomelens.registry import QUERIES

from . import oracle

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.check(spark, FOLDER, name, con) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
