"""All operators and the pipeline are registered: an import that fails by a
mistake within the subpackage would leave none."""

from __future__ import annotations

import re

import __spark_entry__


def test_all_are_registered():
    found = {int(m[1]) for name in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", name))}
    assert found == set(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert {"op11_filter_audit", "op12_hard_negatives"} <= set(__spark_entry__.oracle_sql())
