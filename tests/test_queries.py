"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

from catalog import load
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_equals_sql(spark, con, name):
    df = REGISTRY.queries[name](spark, SF_DIR)
    assert differences(df, con, REGISTRY.oracles[name]) == []


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.oracles)))
def test_model_query_gives_rows(spark, name):
    df = REGISTRY.queries[name](spark, SF_DIR)
    rows = df.collect()
    assert rows and len({c for c in df.columns}) == len(df.columns)
