"""Registered queries against their DuckDB twins on the smallest tables."""
import os

import pytest

from check_oracles import connect, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ("match_by_title", "verify_references", "resolve_citations", "apply_patches", "bm25", "assess", "web_meta", "compare_web", "quota_state", "quota_stream", "rollup_stream",
          "last_good_snapshot", "format_apa", "split_references", "works_from_dblp", "layout_stats", "retry_due")


def test_contract():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    assert rows_of(queries()[name](spark, SF).toPandas()) == rows_of(connect(SF).sql(oracle_sql()[name]).df())
