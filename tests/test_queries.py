from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from scriptorium import plans

from .compare import SF, assert_same

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, plans.QUERIES[name], plans.ORACLES[name])


def test_entry_lists_every_plan():
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_hash_embedding_is_unit_length(spark):
    for r in plans.QUERIES["hash_embedding"](spark, SF).limit(5).collect():
        assert len(r.v) == 1024 and abs(sum(x * x for x in r.v) - 1) < 1e-4
