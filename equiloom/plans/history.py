"""Bar history by signal, series of aliases and the session gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.operators import history as H
from equiloom.plans.base import query
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

_DAY = "2001-11-14"


def _resampled(name: str, source: str, unit: str, years: int) -> str:
    return f""", {name} AS (SELECT symbol, date_trunc('{unit}', date)::DATE AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume::DECIMAL(38,2))::DOUBLE AS volume
 FROM {source} WHERE date <= DATE '{_DAY}' AND date >= DATE '{_DAY}' - INTERVAL {years} YEAR GROUP BY ALL)"""


_ENOUGH = " WHERE symbol IN (SELECT symbol FROM {0} GROUP BY 1 HAVING count(*) >= {1})"


@query(W("daily") + _resampled("w", "daily", "week", 2) + " SELECT * FROM w" + _ENOUGH.format("w", 50))
def s44_weekly_history(spark, d):
    return H.history(D.daily_bars(spark, d), "tq", _DAY)


@query(W("daily") + _resampled("m", "daily", "month", 5) + " SELECT * FROM m" + _ENOUGH.format("m", 50))
def s44_monthly_history(spark, d):
    return H.history(D.daily_bars(spark, d), "bb_monthly", _DAY)


@query(W("daily") + f", x AS (SELECT DISTINCT 'S' || substr(symbol, 2)::INT % 10 AS symbol, date FROM daily WHERE date <= DATE '{_DAY}' AND date >= DATE '{_DAY}' - INTERVAL 2 YEAR) SELECT symbol, count(*) AS n, max(date) AS last_date FROM x" + _ENOUGH.format("x", 200) + " GROUP BY symbol")
def s44_daily_depth(spark, d):
    """Ten series, each of the companies whose numbers end alike."""
    tens = F.concat(F.lit("S"), (F.substring("symbol", 2, 9).cast("int") % 10).cast("string"))
    daily = H.resample(D.daily_bars(spark, d).withColumn("symbol", tens).dropDuplicates(["symbol", "date"]), "day")
    return H.history(daily, "ema", _DAY).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


@query(W("daily", "bench_daily") + _resampled("w", "daily", "week", 2) + _resampled("b", "bench_daily", "week", 2) + " SELECT symbol, max(date) AS last_week FROM w" + _ENOUGH.format("w", 50) + " GROUP BY symbol HAVING max(date) = (SELECT max(date) FROM b)")
def w15_session_gate(spark, d):
    """Symbols that traded in the benchmark's last week."""
    market = H.resample(D.benchmark_daily(spark, d).where(F.col("date") <= _DAY), "week")
    bars = H.session_gate(H.history(D.daily_bars(spark, d), "tq", _DAY), market, "tq")
    return bars.groupBy("symbol").agg(F.max("date").alias("last_week"))


@query(W("daily", "bench_daily") + f", x AS (SELECT * FROM daily WHERE date <= DATE '{_DAY}') SELECT symbol, max(date) AS last_day FROM x GROUP BY symbol HAVING max(date) = (SELECT max(date) FROM bench_daily WHERE date <= DATE '{_DAY}')")
def w15_daily_gate(spark, d):
    upto = lambda df: df.where(F.col("date") <= _DAY)
    return H.session_gate(upto(D.daily_bars(spark, d)), upto(D.benchmark_daily(spark, d)), "ema").groupBy("symbol").agg(F.max("date").alias("last_day"))


_ALIAS = ", a AS (SELECT 'S' || k % 10 AS symbol, symbol AS alias, k // 10 AS place, date, close FROM (SELECT *, substr(symbol, 2)::INT AS k FROM daily) WHERE k // 10 > 0 OR date < DATE '1992-02-10'), n AS (SELECT symbol, alias, place, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT symbol, alias FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN place = 0 AND n >= 5 THEN 0 ELSE 1 END, n DESC, place) = 1)"


@query(W("daily") + _ALIAS + " SELECT a.symbol, a.alias, a.date, a.close FROM a JOIN b USING (symbol, alias)")
def s26_series_bars(spark, d):
    """Bars of the series to use; primary ones have a few days only."""
    k = F.substring("symbol", 2, 9).cast("int")
    x = D.daily_bars(spark, d).withColumns({"k": k, "alias": F.col("symbol")})
    x = x.select(F.concat(F.lit("S"), (F.col("k") % 10).cast("string")).alias("symbol"), "alias", F.floor(F.col("k") / 10).cast("int").alias("place"), "date", "close").where("place > 0 or date < '1992-02-10'")
    return H.best_series(x).select("symbol", "alias", "date", "close")
