"""The registered queries: names, and a sample of them against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from lorehouse.plans.catalog import oracle_sql, queries
from lorehouse.plans.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("hybrid_search", "chunk_by_type", "neighbor_nodes", "replace_links", "normalize_extractions", "toggle_sessions")


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 100


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    line, same = compare(spark, connect(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name])
    assert same, line
