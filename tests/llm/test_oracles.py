"""Queries that SQL can express, against DuckDB."""

import pytest

from keyloom.llm import catalog

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, name):
    oracle.same(catalog.QUERIES[name](spark, SF), oracle.connect(SF), catalog.ORACLES[name])
