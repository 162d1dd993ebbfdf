"""Evidence on companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.operators import evidence as E
from equiloom.plans.base import query
from equiloom.plans.market import _r
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

_DAY = "2001-10-20"


def _evidence(spark, d):
    c, k = D.company(spark, d), F.col("k")
    none = F.lit(None).cast("double")
    quotes = c.where("k % 4 <> 1").select("ticker", F.when(k % 3 == 0, F.col("price")).alias("price"), F.when(k % 5 == 0, F.lit(100.0)).alias("prev"), F.lit(90.0).alias("open"), F.lit(120.0).alias("high"), F.lit(80.0).alias("low"), F.lit(40.0).alias("volume"), F.when(k % 2 == 0, 10.0).alias("avg_volume"), none.alias("change_pct"))
    analysts = c.where("k % 3 <> 2").select("ticker", F.lit(" buy ").alias("consensus"), F.when(k % 2 == 0, (k % 7).cast("int")).alias("num_analysts"), (k * 10.0).alias("target_mean"), none.alias("target_low"), none.alias("target_high"), (k % 3).alias("strong_buy"), (k % 4).alias("buy"), (k % 5).alias("hold"), F.lit(1).alias("sell"), F.lit(None).cast("int").alias("strong_sell"))
    said = F.when((k + F.col("place")) % 3 == 0, "Record growth").when((k + F.col("place")) % 3 == 1, "Weak loss").otherwise("A plain day")
    news = c.select("ticker", "k", F.explode(F.sequence(F.lit(0), F.greatest(k % 11, F.lit(0)))).alias("place")).select("ticker", F.col("place").cast("int").alias("place"), said.alias("title"), F.lit("l").alias("link"), F.lit(None).cast("date").alias("published"))
    return E.evidence(E.gather(c, D.daily_bars(spark, d), quotes, analysts, news, _DAY))


_PCT = lambda a, b, n: f"CASE WHEN {b} > 0 THEN {_r(f'({a} - {b}) / {b} * 100', n)} END"
_SQL = W("company", "daily") + f""", b AS (SELECT symbol, count(*) AS n, max(high) AS hi, min(low) AS lo, last(close ORDER BY date) AS c1, last(open ORDER BY date) AS o1, last(high ORDER BY date) AS h1, last(low ORDER BY date) AS l1, last(volume ORDER BY date) AS v1, first(close ORDER BY date) AS c0,
 list(close ORDER BY date) AS cs, list(volume ORDER BY date) AS vs FROM daily WHERE date <= DATE '{_DAY}' AND date >= DATE '{_DAY}' - 35 GROUP BY symbol),
j AS (SELECT c.*, b.*, coalesce(b.n, 0) AS m, c.k % 4 <> 1 AS quoted, coalesce(b.n, 0) >= 2 AS ok FROM company c LEFT JOIN b ON b.symbol = c.ticker),
p AS (SELECT *, coalesce(CASE WHEN quoted AND k % 3 = 0 THEN price END, CASE WHEN ok THEN c1 END) AS live, coalesce(CASE WHEN quoted AND k % 5 = 0 THEN 100.0::DOUBLE END, CASE WHEN ok THEN cs[m - 1] END) AS prev, coalesce(CASE WHEN ok THEN h1 END, CASE WHEN quoted THEN 120.0::DOUBLE END) AS dh, coalesce(CASE WHEN ok THEN l1 END, CASE WHEN quoted THEN 80.0::DOUBLE END) AS dl,
 coalesce(CASE WHEN ok AND v1 > 0 THEN v1 END, CASE WHEN quoted THEN 40.0::DOUBLE END) AS vol,
 coalesce(CASE WHEN m >= 21 THEN list_sum(vs[m - 20:m - 1]) / 20 WHEN m > 1 THEN list_sum(vs[1:m - 1]) / (m - 1) END, CASE WHEN quoted AND k % 2 = 0 THEN 10.0::DOUBLE END) AS av, CASE WHEN m >= 20 THEN list_sum(cs[m - 19:m]) / 20 END AS sma,
 CASE WHEN k % 3 <> 2 THEN k * 10.0::DOUBLE END AS target, CASE WHEN k % 3 <> 2 THEN k % 3 + k % 4 + k % 5 + 1 END AS total FROM j),
f AS (SELECT *, {_PCT('live', 'prev', 2)} AS day_change_pct, CASE WHEN ok AND hi > lo THEN {_r('(live / hi - 1) * 100', 1)} END AS pct_from_high, CASE WHEN vol > 0 AND av > 0 THEN {_r('vol / av', 2)} END AS rvol, {_PCT('live', 'sma', 1)} AS vs_sma,
 CASE WHEN ok AND c0 > 0 THEN {_r('(c1 / c0 - 1) * 100', 1)} END AS window_return_pct, CASE WHEN dh > dl THEN {_r('(live - dl) / (dh - dl) * 100', 1)} END AS day_range_position_pct, {_PCT('target', 'live', 1)} AS upside_pct,
 CASE WHEN total > 0 THEN {_r('(k % 3 + k % 4)::DOUBLE / total * 100', 1)} END AS buy_pct, CASE WHEN total > 0 THEN CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN k % 7 ELSE total END END AS num_analysts FROM p)"""


@query(_SQL + f" SELECT ticker AS symbol, {_r('live', 2)} AS live, day_change_pct, pct_from_high, rvol, vs_sma AS price_vs_sma_pct, window_return_pct, day_range_position_pct, CASE WHEN vs_sma > 2 THEN 'up' WHEN vs_sma < -2 THEN 'down' WHEN vs_sma IS NOT NULL THEN 'sideways' END AS trend, buy_pct, num_analysts::BIGINT AS num_analysts, upside_pct, least(8, k % 11 + 1)::INT AS headlines, (SELECT count(*) FROM range(least(8, k % 11 + 1)) AS r(i) WHERE (k + i) % 3 = 0) AS positive, (SELECT count(*) FROM range(least(8, k % 11 + 1)) AS r(i) WHERE (k + i) % 3 = 1) AS negative, array_to_string([x FOR x IN [CASE WHEN NOT quoted THEN 'quote' END, CASE WHEN NOT ok THEN 'daily_ohlc' END, CASE WHEN rvol IS NULL THEN 'rvol' END, CASE WHEN vs_sma IS NULL THEN 'sma20' END, CASE WHEN k % 3 = 2 THEN 'analyst' END] IF x IS NOT NULL], ',') AS gaps FROM f")
def p16_evidence(spark, d):
    e = _evidence(spark, d)
    return e.select(
        "symbol", "price.live", "price.day_change_pct", "range_52w.pct_from_high", "technicals.rvol", "technicals.price_vs_sma_pct", "technicals.window_return_pct", "technicals.day_range_position_pct", "technicals.trend",
        "analyst.buy_pct", F.col("analyst.num_analysts").cast("long").alias("num_analysts"), "analyst.upside_pct", F.col("news.total").alias("headlines"), "news.positive", "news.negative", F.array_join("data_gaps", ",").alias("gaps"),
    )
