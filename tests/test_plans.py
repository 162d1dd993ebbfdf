"""Shapes of plans: tables are read as often as they must be."""

from __future__ import annotations

import re

import pytest

from equiloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table", "most"), [("w13_trend_quality", "lineitem", 2), ("x01_director_score", "lineitem", 1), ("x02_distress", "lineitem", 2), ("m08_forward_pe", "lineitem", 1), ("a23_keyword_audit", "documents", 1), ("f07_pattern_match", "documents", 1), ("j23_theme_ids", "documents", 1)])
def test_scans(spark, name, table, most):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(re.findall(rf"FileScan parquet.*?{table}\.parquet", plan)) <= most
