"""Registered corpus queries against their SQL."""

import pytest
from compare import connect, differences

from __spark_entry__ import oracle_sql, queries

NAMES = ("op2_near_dup", "op4_line_dedup", "op5_suffix_dedup", "op6_url_filter", "op7_quality_rules", "op11_infill", "op12_merkle")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) == []
