"""Blocks of a note hold whole texts, by the query and by its SQL."""

from __future__ import annotations

import duckdb
from equiloom.plans import registry

ROWS = [(1, 0, "short"), (1, 1, "  " + "long text " * 50 + "end\n\n"), (1, 2, " \n\t"), (1, 3, None), (1, 4, "two\n\nlines"), (2, 0, "x" * 5000)]


def test_note_blocks(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    want = sorted((c, n, t.strip()) for c, n, t in ROWS if t and t.strip())
    df = registry.queries()["a36_note_blocks"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == want
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(duck.execute(registry.oracle_sql()["a36_note_blocks"]).fetchall()) == want
