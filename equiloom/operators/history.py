"""Bar history: daily bars made weeks and months, the depth a signal needs, the
series to use of a symbol's aliases, and the gate of the session.

Every step is a hash aggregation by symbol and period, or a join with one row a
symbol; nothing is ordered over a whole market.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.functions import dates
from equiloom.operators import indicators as I


@dataclass(frozen=True)
class Need:
    """What a signal reads: bars of a period (day, week or month), years back,
    the least number of them, and below how many days after the one before the
    last bar is a stub."""

    period: str
    years: int
    least: int
    stub: int


# History by signal.
NEEDS = {"tq": Need("week", 2, 50, 6), "bb": Need("week", 2, 50, 6), "bb_monthly": Need("month", 5, 50, 25), "ema": Need("day", 2, 200, 0)}
USABLE = 5  # bars from which a symbol's primary series is used


def resample(daily: DataFrame, period: str) -> DataFrame:
    """Bars of calendar weeks (from Monday) or months by their first day, from
    daily bars (symbol, date, open, high, low, close, volume). The last period
    may still be open: it holds the days there are."""
    if period == "day":
        return daily
    start = F.date_trunc(period, F.col("date").cast("timestamp")).cast("date")
    return daily.groupBy("symbol", start.alias("date")).agg(
        F.min_by("open", F.col("date")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.col("date")).alias("close"),
        F.sum(F.col("volume").cast("decimal(38,2)")).cast("double").alias("volume"),
    )


def since(as_of: str, years: int) -> Column:
    return F.add_months(F.lit(as_of).cast("date"), -12 * years)


def history(daily: DataFrame, signal: str, as_of: str) -> DataFrame:
    """The bars a signal reads, up to a day, of symbols that have enough; days
    without a price are left out, and a stub at the end is."""
    n = NEEDS[signal]
    day = I.clean(daily).where((F.col("date") <= F.lit(as_of).cast("date")) & (F.col("date") >= since(as_of, n.years)))
    bars = resample(day, n.period)
    bars = I.trim_stub(bars, n.stub) if n.stub else bars
    enough = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= n.least).select("symbol")
    return bars.join(enough, "symbol", "left_semi")


def best_series(bars: DataFrame) -> DataFrame:
    """Of a symbol's aliases (column `alias`, `place` 0 for the primary one) the
    primary series if it has USABLE bars, or else the longest, the first of
    equals. Only the winners' names meet the bars again."""
    size = bars.groupBy("symbol", "alias", "place").agg(F.count("*").alias("n"))
    usable = (F.col("place") == 0) & (F.col("n") >= USABLE)
    best = size.groupBy("symbol").agg(F.min_by("alias", F.struct(F.when(usable, 0).otherwise(1), -F.col("n"), "place")).alias("alias"))
    return bars.join(best, ["symbol", "alias"], "left_semi")


def session(bars: DataFrame, period: str) -> Column:
    """The session that a series' last bar stands for: a week's Friday, or the
    bar's own day."""
    last = F.max("date")
    return dates.trading_friday(last) if period == "week" else last


def session_gate(bars: DataFrame, benchmark: DataFrame, signal: str) -> DataFrame:
    """Bars of the symbols whose last session is the benchmark's; all pass where
    the benchmark has no bar. Monthly bars have no gate."""
    period = NEEDS[signal].period
    if period == "month":
        return bars
    now = benchmark.agg(session(benchmark, period).alias("_now"))  # one row
    last = bars.groupBy("symbol").agg(session(bars, period).alias("_last"))
    kept = last.crossJoin(F.broadcast(now)).where(F.col("_now").isNull() | (F.col("_last") == F.col("_now"))).select("symbol")
    return bars.join(kept, "symbol", "left_semi")
