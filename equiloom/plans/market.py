"""Queries on bars, indicators, signals and quarterly figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from equiloom.functions import dates, num
from equiloom.operators import fundamentals as Q
from equiloom.operators import indicators as I
from equiloom.operators import signals as S
from equiloom.plans.base import query
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W


def _r(x: str, k: int) -> str:
    return f"floor(({x}) * {10**k} + 0.5) / {10**k}"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {agg}({x}) OVER {_w(n)} END"


_LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
_O = "(PARTITION BY symbol ORDER BY date)"


@query(W("bars") + " SELECT symbol, date, " + _r("open", 4) + " AS open, " + _r("high", 4) + " AS high, " + _r("low", 4) + " AS low, " + _r("close", 4) + " AS close, volume FROM bars")
def s25_weekly_bars(spark, d):
    r = lambda c: num.js_round(F.col(c), 4).alias(c)
    return I.clean(D.bars(spark, d)).select("symbol", "date", r("open"), r("high"), r("low"), r("close"), "volume")


@query(W("bars") + f" SELECT symbol, date, {_r(_full('avg', 'close', 10), 4)} AS mean10, {_full('sum', 'volume', 10)} AS vol10, {_r(_full('stddev_samp', 'close', 10), 4)} AS std10 FROM bars")
def w01_rolling(spark, d):
    c = F.col("close")
    return D.bars(spark, d).select("symbol", "date", num.js_round(I.rolling_mean(c, 10), 4).alias("mean10"), I.rolling_sum(F.col("volume"), 10).alias("vol10"), num.js_round(I.rolling_std(c, 10), 4).alias("std10"))


_BB = W("bars") + f", m AS (SELECT *, {_full('avg', 'close', 50)} AS mid, {_full('stddev_samp', 'close', 50)} AS sd FROM bars), bb AS (SELECT *, mid + 2 * sd AS upper_, mid - 2 * sd AS lower_ FROM m)"


@query(_BB + f" SELECT symbol, date, {_r('mid', 4)} AS mid, {_r('upper_', 4)} AS upper_band, {_r('lower_', 4)} AS lower_band FROM bb")
def w04_bollinger(spark, d):
    b = I.bollinger(D.bars(spark, d))
    return b.select("symbol", "date", num.js_round(F.col("mid"), 4).alias("mid"), num.js_round(F.col("upper"), 4).alias("upper_band"), num.js_round(F.col("lower"), 4).alias("lower_band"))


_RSI = f"""stp AS (SELECT *, coalesce(close - lag(close) OVER {_O}, 0) AS step FROM {{0}}), gl AS (SELECT *, greatest(step, 0) AS g, greatest(-step, 0) AS l FROM stp),
ab AS (SELECT *, {_full('avg', 'g', 21)} AS a, {_full('avg', 'l', 21)} AS b FROM gl), rsi AS (SELECT *, CASE WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END AS rsi FROM ab)"""


@query(W("bars") + ", " + _RSI.format("bars") + f" SELECT symbol, date, {_r('rsi', 4)} AS rsi FROM rsi")
def w06_rsi(spark, d):
    return I.rsi(D.bars(spark, d)).select("symbol", "date", num.js_round(F.col("rsi"), 4).alias("rsi"))


_TR = f"CASE WHEN lag(close) OVER {_O} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER {_O}), abs(low - lag(close) OVER {_O})) END"


@query(W("bars") + f", t AS (SELECT *, {_TR} AS tr FROM bars) SELECT symbol, date, {_r('tr', 4)} AS tr, {_r(_full('avg', 'tr', 10), 4)} AS atr FROM t")
def w08_atr(spark, d):
    return I.atr(D.bars(spark, d)).select("symbol", "date", num.js_round(F.col("tr"), 4).alias("tr"), num.js_round(F.col("atr"), 4).alias("atr"))


_ADX = f"""a0 AS (SELECT *, {_TR} AS tr, high - lag(high) OVER {_O} AS up, lag(low) OVER {_O} - low AS dn, row_number() OVER {_O} - 1 AS i FROM {{0}}),
a1 AS (SELECT *, coalesce(CASE WHEN up > dn AND up > 0 THEN up END, 0) AS u, coalesce(CASE WHEN dn > up AND dn > 0 THEN dn END, 0) AS d FROM a0),
a2 AS (SELECT *, {_full('sum', 'tr', 13)} AS t, {_full('sum', 'u', 13)} AS us, {_full('sum', 'd', 13)} AS ds FROM a1),
a3 AS (SELECT *, CASE WHEN t > 0 THEN 100 * us / t END AS di_plus, CASE WHEN t > 0 THEN 100 * ds / t END AS di_minus FROM a2),
a4 AS (SELECT *, CASE WHEN di_plus + di_minus > 0 THEN 100 * abs(di_plus - di_minus) / (di_plus + di_minus) WHEN di_plus + di_minus = 0 THEN 0 END AS dx FROM a3),
adx AS (SELECT *, CASE WHEN i >= 24 THEN {_full('avg', 'dx', 13)} END AS adx FROM a4)"""


@query(W("bars") + ", " + _ADX.format("bars") + f" SELECT symbol, date, {_r('di_plus', 3)} AS di_plus, {_r('di_minus', 3)} AS di_minus, {_r('adx', 3)} AS adx FROM adx")
def w10_adx(spark, d):
    return I.adx(D.bars(spark, d)).select("symbol", "date", *[num.js_round(F.col(c), 3).alias(c) for c in ("di_plus", "di_minus", "adx")])


_AL = "al AS (SELECT b.*, n.close AS bench, count(*) OVER (PARTITION BY symbol) AS n_ FROM bars b JOIN bench n USING (date) QUALIFY n_ >= 65)"


@query(W("bars", "bench") + f", {_AL} SELECT symbol, date, {_r(f'close / bench / lag(close / bench, 13) OVER {_O} - 1', 5)} AS rs13, {_r(f'close / bench / lag(close / bench, 52) OVER {_O} - 1', 5)} AS rs52 FROM al")
def w11_rs(spark, d):
    a = I.aligned(D.bars(spark, d), D.benchmark_bars(spark, d))
    return a.select("symbol", "date", num.js_round(I.relative_strength(13), 5).alias("rs13"), num.js_round(I.relative_strength(52), 5).alias("rs52"))


_EMA = """RECURSIVE {body}, x AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars), k(n) AS (VALUES {spans}),
seed AS (SELECT symbol, n, n AS i, sum(close) / n AS e FROM x, k WHERE x.i <= n GROUP BY symbol, n HAVING count(*) = n),
r AS (SELECT * FROM seed UNION ALL SELECT r.symbol, r.n, x.i, x.close * (2.0::DOUBLE / (r.n + 1)) + r.e * (1 - 2.0::DOUBLE / (r.n + 1)) FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1),
fin AS (SELECT symbol, n, e FROM r QUALIFY row_number() OVER (PARTITION BY symbol, n ORDER BY i DESC) = 1)"""
_EMA4 = "WITH " + _EMA.format(body=W("bars")[5:], spans="(10), (20), (50), (200)")


@query(_EMA4 + f" SELECT symbol, {_r('e', 3)} AS ema20 FROM fin WHERE n = 20")
def w05_ema(spark, d):
    s = I.series(D.bars(spark, d)).select("symbol", I.last_ema(F.transform("bars", lambda b: b["close"]), 20).alias("e"))
    return s.where("e is not null").select("symbol", num.js_round(F.col("e"), 3).alias("ema20"))


@query(_EMA4 + ", lb AS (SELECT symbol, close AS price, date AS signal_date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars " + _LAST + ") SELECT lb.symbol, " + _r("price", 4) + " AS price, signal_date, "
       + ", ".join(_r(f"max(CASE WHEN f.n = {k} THEN e END)", 4) + f" AS ema{k}" for k in (10, 20, 50, 200))
       + ", coalesce(count(e) = 4 AND price > max(e), false) AS stacked FROM lb LEFT JOIN fin f ON f.symbol = lb.symbol GROUP BY lb.symbol, price, signal_date")
def w14_ema_stack(spark, d):
    m = S.mean_stack(D.bars(spark, d))
    return m.select("symbol", num.js_round(F.col("price"), 4).alias("price"), "signal_date", *[f"ema{k}" for k in (10, 20, 50, 200)], "stacked")


_ST = f"""s0 AS (SELECT symbol, date, close, (high + low) / 2 AS mid, {_full('avg', 'tr', 10)} AS atr, row_number() OVER {_O} AS i FROM (SELECT *, {_TR} AS tr FROM bars)),
s1 AS (SELECT *, mid + 3 * atr AS bu, mid - 3 * atr AS bl FROM s0),
sr(symbol, i, u, l, d, c) AS (SELECT symbol, i, NULL::DOUBLE, NULL::DOUBLE, -1, close FROM s1 WHERE i = 1 UNION ALL
 SELECT symbol, i, u2, l2, CASE WHEN u IS NULL THEN d WHEN d = -1 AND close > u2 THEN 1 WHEN d = 1 AND close < l2 THEN -1 ELSE d END, close FROM (
 SELECT s1.symbol, s1.i, s1.close, sr.u, sr.d, CASE WHEN s1.atr IS NULL THEN sr.u WHEN sr.u IS NULL OR bu < sr.u OR sr.c > sr.u THEN bu ELSE sr.u END AS u2,
 CASE WHEN s1.atr IS NULL THEN sr.l WHEN sr.l IS NULL OR bl > sr.l OR sr.c < sr.l THEN bl ELSE sr.l END AS l2 FROM sr JOIN s1 ON s1.symbol = sr.symbol AND s1.i = sr.i + 1)),
st AS (SELECT symbol, d AS direction, CASE WHEN d = 1 THEN l ELSE u END AS line FROM sr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1)"""


@query("WITH RECURSIVE " + W("bars")[5:] + ", " + _ST + f" SELECT symbol, direction, {_r('line', 3)} AS line FROM st")
def w09_supertrend(spark, d):
    s = I.series(I.atr(D.bars(spark, d))).select("symbol", I.last_supertrend(F.col("bars")).alias("s"))
    return s.select("symbol", "s.direction", num.js_round(F.col("s.line"), 3).alias("line"))


@query(_BB + f", p AS (SELECT *, lag(close) OVER {_O} AS c1, lag(upper_) OVER {_O} AS u1 FROM bb), z AS (SELECT * FROM p {_LAST}) SELECT symbol, 'NEW_BREAKOUT' AS signal, {_r('close', 4)} AS price, {_r('upper_', 2)} AS upper_band, date AS signal_date FROM z WHERE close > upper_ AND c1 <= u1")
def w12_bb_signal(spark, d):
    return S.breakout(D.bars(spark, d)).withColumn("price", num.js_round(F.col("price"), 4))


_CLAMP = "greatest(0, least(25, {0}))"
_TQ = "WITH RECURSIVE " + W("bars", "bench")[5:] + f", {_AL}, " + _RSI.format("al") + ", " + _ADX.format("rsi") + ", " + _ST.replace("FROM bars)", "FROM al)") + f""",
q0 AS (SELECT *, close / bench / lag(close / bench, 52) OVER {_O} - 1 AS rs52, close / bench / lag(close / bench, 13) OVER {_O} - 1 AS rs13, {_full('avg', 'close', 13)} AS sma13, {_full('avg', 'volume', 13)} AS vol13 FROM adx),
q1 AS (SELECT *, lag(rs52) OVER {_O} AS p52, lag(rs13) OVER {_O} AS p13 FROM q0), q2 AS (SELECT q1.*, st.line FROM q1 JOIN st USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
q3 AS (SELECT *, (p52 < -0.15 AND rs52 > 0.005) OR (p52 < 0 AND rs52 > 0.02) AS lg, (p13 < -0.005 AND rs13 > 0.005) OR (p13 < 0.01 AND rs13 > 0.02) AS sh FROM q2)
SELECT symbol, coalesce(rsi > 55 AND close > line AND adx > 20 AND di_plus > di_minus AND close > sma13 AND volume > vol13 AND rs52 > 0 AND rs13 > 0, false) AS gates,
 CASE WHEN lg AND sh THEN 'both' WHEN lg THEN 'long' WHEN sh THEN 'short' END AS crossover,
 {_r(' + '.join(_CLAMP.format(x) for x in ('(rsi - 55) * 2.5', '(adx - 20) * 1.25', '(di_plus - di_minus) * 2', '(rs52 + rs13) * 1000')), 2)} AS score, date AS signal_date FROM q3"""


@query(_TQ)
def w13_trend_quality(spark, d):
    return S.trend_quality(D.bars(spark, d), D.benchmark_bars(spark, d))


def _back(n: int, m: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND {f'{m} PRECEDING' if m else 'CURRENT ROW'})"


_FEAT = W("bars") + f""", fx AS (SELECT *, avg(volume) OVER {_back(20, 1)} AS v20, max(high) OVER {_back(51)} AS hi, min(low) OVER {_back(51)} AS lo, first(close) OVER {_back(20)} AS c0,
 first(close) OVER {_back(63)} AS c63, {_full('avg', 'close', 20)} AS sma, lag(close) OVER {_O} AS prev FROM bars),
feat AS (SELECT symbol, date, close, {_r('CASE WHEN v20 <> 0 THEN volume / v20 END', 2)} AS rvol, {_r('(close / c0 - 1) * 100', 2)} AS window_return_pct, {_r('(close / c63 - 1) * 100', 2)} AS return_3m,
 {_r('(close / hi - 1) * 100', 1)} AS pct_from_high, {_r('(close / lo - 1) * 100', 1)} AS bounce_pct, {_r('CASE WHEN hi <> lo THEN (close - lo) / (hi - lo) END * 100', 1)} AS position_pct,
 {_r('(close / sma - 1) * 100', 2)} AS price_vs_sma_pct, {_r('(close / prev - 1) * 100', 2)} AS day_change_pct, {_r('CASE WHEN high <> low THEN (close - low) / (high - low) END * 100', 1)} AS day_range_position_pct FROM fx {_LAST})"""


@query(_FEAT + " SELECT * REPLACE (" + _r("close", 4) + " AS close) FROM feat")
def w17_bar_features(spark, d):
    return S.features(D.bars(spark, d)).withColumn("close", num.js_round(F.col("close"), 4))


@query("SELECT DISTINCT l_shipdate::DATE AS day, (l_shipdate::DATE + CASE dayofweek(l_shipdate) WHEN 6 THEN -1 ELSE 5 - dayofweek(l_shipdate) END::INT)::DATE AS friday FROM lineitem")
def d01_friday(spark, d):
    day = F.to_date("l_shipdate")
    return D.table(spark, d, "lineitem").select(day.alias("day")).distinct().select("day", dates.trading_friday(F.col("day")).alias("friday"))


@query(W("bars") + ", g AS (SELECT *, date - lag(date) OVER " + _O + " AS gap, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM bars) SELECT symbol, count(*) AS n, max(date) AS last_date FROM g WHERE NOT (r = 1 AND coalesce(gap, 99) < 14) GROUP BY symbol")
def f22_stub_trim(spark, d):
    return I.trim_stub(D.bars(spark, d), 14).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


_SIGS = "sig AS (SELECT event_type AS kind, user_id AS ticker, max(ts) AS ts, max(ts)::DATE AS signal_date FROM events GROUP BY ALL)"


def _event_signals(spark, d):
    e = D.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("ticker")).agg(F.max("ts").alias("ts"), F.to_date(F.max("ts")).alias("signal_date"))


@query(f"WITH {_SIGS} SELECT kind, ticker, signal_date FROM sig s WHERE signal_date = (SELECT max(signal_date) FROM sig t WHERE t.kind = s.kind)")
def f20_latest_session(spark, d):
    return I.latest_session(_event_signals(spark, d), "signal_date", "kind").select("kind", "ticker", "signal_date")


@query(f"WITH {_SIGS}, k AS (SELECT DISTINCT kind FROM sig), a AS (SELECT kind, row_number() OVER (ORDER BY kind) AS i FROM k) SELECT coalesce(x.ticker, y.ticker, z.ticker) AS ticker, x.ticker IS NOT NULL AS has_bb, y.ticker IS NOT NULL AS has_tq, z.ticker IS NOT NULL AS has_ema FROM (SELECT ticker FROM sig WHERE kind = 'click' AND ticker % 2 = 0) x FULL JOIN (SELECT ticker FROM sig WHERE kind = 'purchase' AND ticker % 3 = 0) y ON x.ticker = y.ticker FULL JOIN (SELECT ticker FROM sig WHERE ticker % 5 = 0 GROUP BY ticker) z ON z.ticker = coalesce(x.ticker, y.ticker)")
def s06_breakout_flags(spark, d):
    s = _event_signals(spark, d)
    return S.merge_flags(s.where("kind = 'click' and ticker % 2 = 0"), s.where("kind = 'purchase' and ticker % 3 = 0"), s.where("ticker % 5 = 0"))


@query(f"WITH {_SIGS} SELECT kind, count(*) AS n, max(signal_date) AS latest FROM sig GROUP BY kind")
def a05_signal_counts(spark, d):
    return _event_signals(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.max("signal_date").alias("latest"))


# --- quarters ---

_QL = "lq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS back FROM quarters QUALIFY back <= 5)"
_D2 = lambda x: f"({_r(x, 2)})::DECIMAL(20,2)::VARCHAR"


@query(W("quarters") + f", {_QL}, sc AS (SELECT *, CASE WHEN max(abs(revenue)) OVER (PARTITION BY ticker) >= 1e5 THEN revenue / 1e7 ELSE revenue END AS sales, CASE WHEN max(abs(net_income)) OVER (PARTITION BY ticker) >= 1e5 THEN net_income / 1e7 ELSE net_income END AS np_ FROM lq) SELECT ticker, string_agg(strftime(period_end, '%b %Y'), ',' ORDER BY period_end) AS labels, string_agg({_D2('sales')}, ',' ORDER BY period_end) AS sales, string_agg({_D2('np_')}, ',' ORDER BY period_end) AS np, string_agg({_D2('eps')}, ',' ORDER BY period_end) AS eps FROM sc GROUP BY ticker")
def w19_quarter_panel(spark, d):
    return Q.panel(D.quarters(spark, d))


_Y = lambda c: f"CASE WHEN o.{c} > 0 THEN {_r(f'(n.{c} / o.{c} - 1) * 100', 1)} END"
_YOY = f", {_QL}, yoy AS (SELECT n.ticker, {_Y('eps')} AS eps_yoy, {_Y('revenue')} AS sales_yoy, {_Y('net_income')} AS np_yoy FROM lq n LEFT JOIN lq o ON o.ticker = n.ticker AND last_day((o.period_end + INTERVAL 12 MONTH)::DATE) = n.period_end WHERE n.back = 1)"


@query(W("quarters") + _YOY + " SELECT * FROM yoy")
def w21_yoy(spark, d):
    return Q.yoy(D.quarters(spark, d))


def _pe(e: str) -> str:
    return f"CASE WHEN price IS NULL OR {e} IS NULL THEN NULL WHEN {e} <= 0 OR price / {e} <= 0 OR price / {e} > 500 THEN 999 ELSE {_r(f'price / {e}', 1)} END"


_VAL = f""", v AS (SELECT ticker, first(eps ORDER BY back) FILTER (WHERE eps IS NOT NULL) * 4 AS e1, CASE WHEN count(*) FILTER (WHERE back <= 4) = 4 THEN sum(({_r('eps', 6)})::DECIMAL(38,6)) FILTER (WHERE back <= 4)::DOUBLE END AS e4 FROM lq GROUP BY ticker),
val AS (SELECT ticker, {_pe('e1')} AS forward_pe, {_pe('e4')} AS trailing_pe FROM v JOIN company USING (ticker))"""


@query(W("quarters", "company") + f", {_QL}" + _VAL + " SELECT * FROM val")
def m08_forward_pe(spark, d):
    return Q.valuation(D.quarters(spark, d), D.company(spark, d).select("ticker", "price"))


@query(W("quarters", "company") + _YOY + _VAL + " SELECT ticker, coalesce(forward_pe > 0 AND forward_pe <= 20 AND eps_yoy > 0 AND sales_yoy > 0, false) AS all_green FROM val JOIN yoy USING (ticker)")
def f17_all_green(spark, d):
    q = D.quarters(spark, d)
    return Q.figures(q, D.company(spark, d)).select("ticker", Q.all_green().alias("all_green"))


@query(W("quarters") + f" SELECT ticker, period_end, CASE WHEN lag(revenue) OVER w IS NULL THEN 'na' WHEN revenue > lag(revenue) OVER w THEN 'up' WHEN revenue < lag(revenue) OVER w THEN 'down' ELSE 'flat' END AS direction FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY period_end)")
def w23_directions(spark, d):
    return Q.directions(D.quarters(spark, d))


_CUM = ", tot AS (SELECT n.ticker, n.period_end, n.revenue + coalesce(o.revenue, 0) AS r, n.net_income + coalesce(o.net_income, 0) AS ni FROM quarters n LEFT JOIN quarters o ON o.ticker = n.ticker AND last_day((o.period_end + INTERVAL 3 MONTH)::DATE) = n.period_end)"


@query(W("quarters") + _CUM + f" SELECT ticker, last_day((q.period_end - INTERVAL 3 MONTH)::DATE) AS period_end, {_r('r - revenue', 2)} AS revenue, {_r('ni - net_income', 2)} AS net_income FROM quarters q JOIN tot USING (ticker, period_end) WHERE r > 1.05 * revenue OR abs(ni) > 1.05 * abs(net_income)")
def w24_decumulate(spark, d):
    q = D.quarters(spark, d)
    o = q.select("ticker", F.last_day(F.add_months("period_end", 3)).alias("period_end"), F.col("revenue").alias("r0"), F.col("net_income").alias("n0"))
    total = q.join(o, ["ticker", "period_end"], "left").select("ticker", "period_end", (F.col("revenue") + F.coalesce("r0", F.lit(0.0))).alias("revenue"), (F.col("net_income") + F.coalesce("n0", F.lit(0.0))).alias("net_income"))
    out = Q.decumulate(q, total)
    return out.select("ticker", "period_end", num.js_round(F.col("revenue"), 2).alias("revenue"), num.js_round(F.col("net_income"), 2).alias("net_income"))


@query(W("quarters") + """, a AS (SELECT *, 0 AS source FROM quarters WHERE year(period_end) = 1999 AND month(period_end) <= length(ticker) * 2 UNION ALL SELECT *, 1 FROM quarters WHERE year(period_end) = 2000),
n AS (SELECT ticker, source, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT ticker, source FROM n QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n >= 2 DESC, CASE WHEN n >= 2 THEN source END NULLS FIRST, n DESC, source) = 1)
SELECT a.ticker, a.period_end, a.source FROM a JOIN p USING (ticker, source)""")
def s27_source_fallback(spark, d):
    q = D.quarters(spark, d)
    first = q.where((F.year("period_end") == 1999) & (F.month("period_end") <= F.length("ticker") * 2))
    return Q.by_priority([first, q.where(F.year("period_end") == 2000)]).select("ticker", "period_end", "source")


@query(W("quarters") + f" SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.period_end, b.period_end) AS period_end, {_r('coalesce(b.revenue, a.revenue)', 2)} AS revenue, {_r('coalesce(b.eps, a.eps)', 4)} AS eps FROM (SELECT * FROM quarters WHERE year(period_end) <= 1999) a FULL JOIN (SELECT ticker, period_end, CASE WHEN month(period_end) <> 6 THEN revenue * 2 END AS revenue, eps + 1 AS eps FROM quarters WHERE year(period_end) >= 1999) b ON a.ticker = b.ticker AND a.period_end = b.period_end")
def a30_merge_quarters(spark, d):
    q = D.quarters(spark, d)
    new = q.where(F.year("period_end") >= 1999).select("ticker", "period_end", F.when(F.month("period_end") != 6, F.col("revenue") * 2).alias("revenue"), (F.col("eps") + 1).alias("eps"))
    m = Q.merge_quarters(q.where(F.year("period_end") <= 1999), new)
    return m.select("ticker", "period_end", num.js_round(F.col("revenue"), 2).alias("revenue"), num.js_round(F.col("eps"), 4).alias("eps"))


@query(W("quarters") + " SELECT ticker, period_end FROM quarters WHERE period_end <= DATE '2000-03-31' + 5 AND coalesce(revenue, net_income, eps) IS NOT NULL")
def f23_reported(spark, d):
    return Q.reported(D.quarters(spark, d), "2000-03-31").select("ticker", "period_end")


@query("WITH c AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, strftime(day, '%b %Y') AS label, last_day((day + INTERVAL 2 MONTH)::DATE) AS quarter_end, CASE WHEN month(day) = 2 THEN make_date(2000 + year(day) % 100, 2, 28) ELSE last_day(make_date(2000 + year(day) % 100, month(day), 1)) END AS period_end FROM c")
def d05_quarter_labels(spark, d):
    o = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", dates.quarter_label(F.col("day")).alias("label"), dates.first_quarter_end(F.col("day")).alias("quarter_end"), dates.period_end(F.date_format("day", "MMM-yy")).alias("period_end"))


# --- scalars ---


@query(W("company") + f" SELECT ticker, {_r('mcap_cr', 1)} AS r1, floor(-mcap_cr + 0.5) AS r0, greatest(0, least(100, mcap_cr)) AS clamped, {_r('price * 1e6 / 1e7', 1)} AS mcap, {_r('70 * (1 - exp(-abs(mcap_cr) / 6000))', 4)} AS saturated, CASE WHEN abs(price) <= 3 THEN price * 100 ELSE price END AS pct FROM company")
def m01_numbers(spark, d):
    m, p = F.col("mcap_cr"), F.col("price")
    return D.company(spark, d).select("ticker", num.js_round(m, 1).alias("r1"), num.js_round(-m).alias("r0"), num.clamp(m, 0, 100).alias("clamped"), num.mcap_cr(p * 1e6).alias("mcap"), num.js_round(num.saturate(F.abs(m), 70, 6000), 4).alias("saturated"), num.pct_from_decimal(p).alias("pct"))


@query(f"""WITH t AS (SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS amount, o_orderdate AS opened, 100 + o_custkey % 50 AS entry, CASE WHEN o_orderkey % 4 <> 0 THEN 100 + o_orderkey % 70 END AS mark FROM orders),
p AS (SELECT *, {_r('amount / entry', 4)} AS qty FROM t), v AS (SELECT *, CASE WHEN mark IS NULL THEN amount ELSE qty * mark END AS market_value FROM p)
SELECT count(*) AS n, {_r('sum(amount::DECIMAL(18,2))::DOUBLE', 2)} AS invested, {_r(f"sum(({_r('market_value', 2)})::DECIMAL(38,2))::DOUBLE", 2)} AS market_value,
 {_r(f"(sum(({_r('market_value', 2)})::DECIMAL(38,2))::DOUBLE / sum(amount::DECIMAL(18,2))::DOUBLE - 1) * 100", 2)} AS pnl_pct FROM v""")
def a26_paper_summary(spark, d):
    from equiloom.operators import portfolio as P

    return P.summary(P.positions(_paper(spark, d)))


def _paper(spark, d):
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("opened"), (100 + F.col("o_custkey") % 50).alias("entry"), F.when(k % 4 != 0, 100 + k % 70).alias("mark"))


@query("SELECT o_orderkey AS id, greatest(0, date_diff('day', (o_orderdate + INTERVAL 330 MINUTE)::DATE, DATE '2001-01-01'))::INT AS held_days FROM orders")
def d08_held_days(spark, d):
    o = D.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), dates.held_days(F.col("o_orderdate").cast("timestamp"), F.lit("2001-01-01").cast("timestamp")).alias("held_days"))


@query(_FEAT + f""", b AS (SELECT f.*, CASE WHEN c.mcap_cr >= 20000 THEN 'large' WHEN c.mcap_cr >= 5000 THEN 'mid' ELSE 'small' END AS bucket FROM feat f JOIN ({D.SQL['company']}) c ON c.ticker = f.symbol)
SELECT bucket, symbol, day_change_pct FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY abs(day_change_pct) DESC NULLS LAST, symbol) <= 5""")
def o08_topk_bucket(spark, d):
    c = D.company(spark, d).select(F.col("ticker").alias("symbol"), num.cap_bucket(num.cap_tier(F.col("mcap_cr"))).alias("bucket"))
    f = S.features(D.bars(spark, d)).join(c, "symbol")
    w = Window.partitionBy("bucket").orderBy(F.abs("day_change_pct").desc_nulls_last(), "symbol")
    return f.withColumn("r", F.row_number().over(w)).where("r <= 5").select("bucket", "symbol", "day_change_pct")
