"""Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from equiloom.operators.governance import seat_events


def seat_event_stream(snapshots: DataFrame, read_old: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is a set of new board snapshots: its events against the
    stored seats, and the seats themselves, go to `write`, once a batch."""

    def one(batch: DataFrame, _: int) -> None:
        old = read_old().join(batch.select("ticker").distinct(), "ticker", "left_semi")
        write(seat_events(old, batch), batch)

    return snapshots.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def signal_counts(events: DataFrame, late: str = "1 day", span: str = "1 day") -> DataFrame:
    """Events by kind and tumbling window, late ones dropped after `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
