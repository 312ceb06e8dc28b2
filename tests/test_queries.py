"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from dialogprep.plans.catalogue import QUERIES
from tests.compare import compare
from tests.conftest import SF


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SF) > 0


def test_entry(spark):
    assert entry(spark).columns == ["conv_id", "input_ids"]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())
