"""Queries on deals, holdings, scores and incremental state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from equiloom.functions import dates, num, text
from equiloom.operators import deals as T
from equiloom.operators import holdings as H
from equiloom.operators import portfolio as P
from equiloom.operators import scores as X
from equiloom.operators import signals as S
from equiloom.operators import state as U
from equiloom.plans.base import query
from equiloom.plans.market import _FEAT, _QL, _VAL, _YOY, _r
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

# The watched investors and the client patterns that stand for them.
INVESTORS = {"alder": ["#0000000?1[0-9]$", "alder"], "birch": ["[02468]7$"], "cedar": ["99"], "elm": ["elm fund"]}
PRIMARY = ("alder", "birch")
_IDS = "list_filter([{}], x -> x IS NOT NULL)"


def _tag() -> str:
    cells = ", ".join(f"CASE WHEN regexp_matches(client, '(?i){'|'.join(ps)}') THEN '{i}' END" for i, ps in INVESTORS.items())
    return f"[x FOR x IN [{cells}] IF x IS NOT NULL]"


_DEALS = W("deals", "company") + f""", twice AS (SELECT * FROM deals UNION ALL SELECT * REPLACE (upper(client) AS client, o + 1000000000 AS o) FROM deals WHERE o % 3 = 0),
dd AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY trade_date, symbol, lower(client), side, deal_type, quantity, price ORDER BY o, l) = 1),
sme AS (SELECT ticker AS symbol FROM company WHERE market = 'NSE SME'),
en AS (SELECT *, {_tag()} AS investor_ids, symbol IN (SELECT symbol FROM sme) AS in_sme_universe, {_r('quantity * price / 1e7', 1)} AS value_cr, list_has_any({_tag()}, ['alder', 'birch']) AS primary_hit FROM dd)"""


def _deduped(spark, d):
    x = D.deals(spark, d)
    again = x.where("o % 3 = 0").withColumn("client", F.upper("client")).withColumn("o", F.col("o") + 1000000000)
    return T.dedup(x.unionByName(again), "o", "l")


def _tagged(spark, d):
    sme = D.company(spark, d).where("market = 'NSE SME'").select(F.col("ticker").alias("symbol"))
    return T.enrich(_deduped(spark, d), INVESTORS, sme, PRIMARY)


@query(_DEALS + f" SELECT trade_date, symbol, client, side, quantity, {_r('price', 4)} AS price FROM dd")
def u01_deal_dedup(spark, d):
    return _deduped(spark, d).select("trade_date", "symbol", "client", "side", "quantity", num.js_round(F.col("price"), 4).alias("price"))


@query(_DEALS + " SELECT o, l, symbol, array_to_string(investor_ids, ',') AS investors, in_sme_universe, value_cr FROM en WHERE len(investor_ids) > 0")
def j11_tag_investors(spark, d):
    return _tagged(spark, d).where(F.size("investor_ids") > 0).select("o", "l", "symbol", F.array_join("investor_ids", ",").alias("investors"), "in_sme_universe", "value_cr")


@query(_DEALS + ", ids AS (SELECT unnest(['" + "', '".join(INVESTORS) + "']) AS investor), x AS (SELECT unnest(investor_ids) AS investor, side, in_sme_universe FROM en) SELECT ids.investor, count(side) AS deals, count(*) FILTER (WHERE side = 'BUY') AS buys, count(*) FILTER (WHERE in_sme_universe) AS sme FROM ids LEFT JOIN x USING (investor) GROUP BY 1")
def a14_investor_stats(spark, d):
    return T.investor_stats(_tagged(spark, d), list(INVESTORS))


@query(_DEALS + " SELECT symbol, count(*) AS n, (SELECT string_agg(DISTINCT i, ',' ORDER BY i) FROM (SELECT unnest(investor_ids) AS i, symbol AS s FROM en e2 WHERE in_sme_universe AND primary_hit) q WHERE q.s = en.symbol) AS investors, max(trade_date) AS last_date, last(side ORDER BY trade_date, o, l) AS last_side FROM en WHERE in_sme_universe AND primary_hit GROUP BY symbol")
def a15_sme_hits(spark, d):
    return T.symbol_hits(_tagged(spark, d), "o", "l")


@query(_DEALS + " SELECT o, l, symbol, value_cr FROM en WHERE in_sme_universe AND side = 'BUY' AND value_cr >= 0.5 ORDER BY value_cr DESC, o, l LIMIT 40")
def o05_whale_buys(spark, d):
    return _tagged(spark, d).where("in_sme_universe and side = 'BUY' and value_cr >= 0.5").orderBy(F.desc("value_cr"), "o", "l").limit(40).select("o", "l", "symbol", "value_cr")


@query(_DEALS + " SELECT o, l, symbol, side, value_cr FROM en WHERE primary_hit AND in_sme_universe AND side = 'BUY'")
def f28_radar(spark, d):
    return T.radar(_tagged(spark, d), sme=True, buys=True).select("o", "l", "symbol", "side", "value_cr")


@query(W("deals") + " SELECT count(*) AS n, count(*) FILTER (WHERE side = 'BUY') AS buys, count(*) FILTER (WHERE deal_type = 'block') AS blocks, max(trade_date) AS last_date, count(DISTINCT symbol) AS symbols FROM deals")
def a13_deal_stats(spark, d):
    return T.stats(D.deals(spark, d))


@query(W("deals") + ", w AS (SELECT * FROM deals WHERE trade_date > DATE '2000-06-30' - 30 AND trade_date <= DATE '2000-06-30' ORDER BY trade_date DESC, o, l LIMIT 200) SELECT trade_date, symbol, client, side FROM w WHERE symbol LIKE 'S1%'")
def s11_deals_window(spark, d):
    x = D.deals(spark, d).where("trade_date > date_sub(date '2000-06-30', 30) and trade_date <= date '2000-06-30'")
    return x.orderBy(F.desc("trade_date"), "o", "l").limit(200).where(F.col("symbol").startswith("S1")).select("trade_date", "symbol", "client", "side")


@query(W("company") + ", s AS (SELECT ticker, k FROM company), q AS (SELECT ticker AS p FROM company WHERE k <= 12) SELECT q.p AS prefix, count(*) AS n FROM s JOIN q ON starts_with(s.ticker, q.p) OR starts_with(q.p, s.ticker) GROUP BY 1")
def j12_prefix_join(spark, d):
    c = D.company(spark, d)
    q = c.where("k <= 12").select(F.col("ticker").alias("p"))  # twelve rows by definition
    return c.select("ticker").join(F.broadcast(q), text.symbols_match(F.col("ticker"), F.col("p"))).groupBy(F.col("p").alias("prefix")).agg(F.count("*").alias("n"))


# --- holdings ---

_H = W("holdings") + """, hp AS (SELECT h.*, floor(shares / all_shares * 10000 + 0.5) / 100 AS pct FROM holdings h JOIN (SELECT symbol, sum(shares::DECIMAL(18,2))::DOUBLE AS all_shares FROM holdings GROUP BY 1) USING (symbol))"""


def _held(spark, d):
    return H.with_pct(D.holdings(spark, d))


@query(_H + " SELECT symbol, count(DISTINCT investor) AS investors, max(pct) AS max_pct, sum(value::DECIMAL(18,2))::DOUBLE AS total_value, count(*) FILTER (WHERE change_type = 'new') AS new_count, count(*) FILTER (WHERE change_type = 'increased') AS increased_count, last(change_type ORDER BY value, pct, investor) AS top_change, last(investor ORDER BY value, pct, investor) AS top_investor FROM hp GROUP BY symbol HAVING count(DISTINCT investor) >= 2")
def a17_consensus(spark, d):
    return H.consensus(_held(spark, d))


@query(_H + " SELECT investor, count(*) AS holdings, count(*) FILTER (WHERE change_type IN ('new', 'disclosed')) AS new_n, count(*) FILTER (WHERE change_type = 'increased') AS increased_n, count(*) FILTER (WHERE change_type = 'decreased') AS decreased_n FROM hp GROUP BY 1")
def a16_investor_summary(spark, d):
    return H.investor_summary(_held(spark, d))


@query(_H + ", m AS (SELECT *, substr(symbol, 1, 7) AS house FROM hp) SELECT investor, house, max(value) AS value, max(pct) AS pct, ['unchanged', 'decreased', 'increased', 'new'][max(CASE change_type WHEN 'new' THEN 4 WHEN 'increased' THEN 3 WHEN 'decreased' THEN 2 ELSE 1 END)] AS change_type, string_agg(DISTINCT symbol, ', ' ORDER BY symbol) AS entities FROM m GROUP BY 1, 2")
def a19_merge(spark, d):
    h = _held(spark, d).withColumn("house", F.substring("symbol", 1, 7)).withColumn("entity", F.col("symbol"))
    return H.merge(h, "house")


@query(_H + ", picks AS (SELECT DISTINCT investor, 'Brand#' || (length(investor) + 10) AS symbol FROM hp) SELECT investor, symbol, value, change_type FROM hp WHERE value >= 100000 UNION ALL SELECT investor, symbol, 0, 'disclosed' FROM picks p WHERE NOT EXISTS (SELECT 1 FROM hp h WHERE h.value >= 100000 AND h.investor = p.investor AND h.symbol = p.symbol)")
def u06_disclosed(spark, d):
    h = _held(spark, d)
    picks = h.select("investor").distinct().select("investor", F.concat(F.lit("Brand#"), (F.length("investor") + 10).cast("string")).alias("symbol"))
    return H.append_missing(h.where("value >= 100000").select("investor", "symbol", "value", "change_type"), picks, "investor", "symbol")


@query(_H + " SELECT investor, symbol, pct, value, CASE change_type WHEN 'new' THEN 'NEW' WHEN 'increased' THEN '↑' WHEN 'decreased' THEN '↓' ELSE '' END AS badge FROM hp WHERE change_type IN ('new', 'increased') AND pct >= 0.5 AND lower(investor) LIKE '%auto%' AND value >= 50000")
def f19_holdings_filter(spark, d):
    h = _held(spark, d).where(F.col("change_type").isin("new", "increased") & (F.col("pct") >= 0.5) & F.lower("investor").contains("auto") & (F.col("value") >= 50000))
    badge = F.when(F.col("change_type") == "new", "NEW").when(F.col("change_type") == "increased", "↑").when(F.col("change_type") == "decreased", "↓").otherwise("")
    return h.select("investor", "symbol", "pct", "value", badge.alias("badge"))


@query(_H + " SELECT investor, symbol, value FROM hp ORDER BY coalesce(value, -1) DESC, coalesce(pct, -1) DESC, investor, symbol LIMIT 50")
def s14_holdings_scan(spark, d):
    return _held(spark, d).orderBy(F.coalesce("value", F.lit(-1.0)).desc(), F.coalesce("pct", F.lit(-1.0)).desc(), "investor", "symbol").limit(50).select("investor", "symbol", "value")


@query(W("company") + """, n AS (SELECT name, CASE WHEN k % 3 = 0 THEN lower(name) || 's' WHEN k % 3 = 1 THEN lower(name) ELSE 'unknown ' || k END AS key FROM company),
l AS (SELECT lower(name) AS key, ticker AS symbol, 0 AS rank FROM company WHERE k % 2 = 0 UNION ALL SELECT lower(name), ticker || '.X', 1 FROM company),
f AS (SELECT name, 0 AS form, key FROM n UNION ALL SELECT name, 1, regexp_replace(key, 's$', '') FROM n WHERE regexp_matches(key, 's$') UNION ALL SELECT name, CASE WHEN regexp_matches(key, 's$') THEN 2 ELSE 1 END, key || 's' FROM n),
h AS (SELECT f.name, l.symbol, l.rank FROM f JOIN l USING (key) QUALIFY row_number() OVER (PARTITION BY f.name ORDER BY rank, form, symbol) = 1)
SELECT n.name, h.symbol, h.rank FROM n LEFT JOIN h USING (name)""")
def j19_resolve(spark, d):
    c = D.company(spark, d)
    low, k = F.lower("name"), F.col("k")
    names = c.select("name", F.when(k % 3 == 0, F.concat(low, F.lit("s"))).when(k % 3 == 1, low).otherwise(F.concat(F.lit("unknown "), k.cast("string"))).alias("key"))
    first = c.where("k % 2 = 0").select(low.alias("key"), F.col("ticker").alias("symbol"))
    return H.resolve(names, [first, c.select(low.alias("key"), F.concat("ticker", F.lit(".X")).alias("symbol"))])


# --- scores ---

_DIST = f""", dm AS (SELECT f.symbol AS ticker, k % 17 = 0 AS seed, pct_from_high AS drawdown_pct, f.bounce_pct, return_3m AS returns_pct, eps_yoy, sales_yoy, forward_pe AS pe, NULL::DOUBLE AS pb, mcap_cr, CASE WHEN k % 19 = 0 THEN (k % 5)::INT END AS stage
 FROM feat f JOIN company c ON c.ticker = f.symbol LEFT JOIN yoy ON yoy.ticker = f.symbol LEFT JOIN val ON val.ticker = f.symbol),
ds AS (SELECT *, coalesce(eps_yoy < 0, false) OR coalesce(pe >= 80, false) OR coalesce(drawdown_pct <= -20, false) OR coalesce(sales_yoy < -15, false) OR stage IS NOT NULL AS core,
 CASE WHEN seed THEN 30 ELSE 22 END + CASE WHEN drawdown_pct BETWEEN -70 AND -20 THEN 18 WHEN drawdown_pct >= -85 AND drawdown_pct < -70 THEN 10 WHEN drawdown_pct > -20 AND drawdown_pct <= -10 THEN 6 ELSE 0 END
 + CASE WHEN bounce_pct >= 80 THEN 22 WHEN bounce_pct >= 40 THEN 16 WHEN bounce_pct >= 15 THEN 10 WHEN bounce_pct >= 5 THEN 5 ELSE 0 END
 + CASE WHEN sales_yoy > eps_yoy + 10 THEN 18 WHEN sales_yoy >= 0 THEN 10 WHEN sales_yoy > -15 THEN 5 ELSE 0 END
 + CASE WHEN returns_pct <= -25 THEN -6 WHEN returns_pct >= 40 THEN 22 WHEN returns_pct >= 10 THEN 12 WHEN returns_pct >= 0 THEN 5 ELSE 0 END
 + CASE WHEN pe >= 900 THEN 6 WHEN pe >= 80 THEN 4 WHEN pe > 0 AND pe <= 18 THEN 8 ELSE 0 END
 + CASE WHEN mcap_cr <= 500 THEN 8 WHEN mcap_cr <= 2000 THEN 4 WHEN mcap_cr >= 10000 THEN -4 ELSE 0 END - coalesce(stage, 0) AS raw FROM dm)"""
_ALLQ = _FEAT + ", company AS (" + D.SQL["company"] + "), quarters AS (" + D.SQL["quarters"] + ")" + _YOY + _VAL
_FLAG = ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in (("seed", "seed"), ("neg_eps_yoy", "eps_yoy < 0"), ("stressed_pe", "pe >= 80"), ("drawdown", "drawdown_pct <= -20"), ("sales_pressure", "sales_yoy < -15"), ("surveillance", "stage IS NOT NULL"), ("sales_gt_eps", "sales_yoy > eps_yoy + 10"), ("bounce", "bounce_pct >= 15"), ("cheap_pe", "pe > 0 AND pe <= 18"), ("small_cap", "mcap_cr <= 500")))


def _distress_input(spark, d):
    from equiloom.operators import fundamentals as Q

    q, c = D.quarters(spark, d), D.company(spark, d)
    f = S.features(D.bars(spark, d)).withColumnRenamed("symbol", "ticker")
    j = f.join(c.select("ticker", "mcap_cr", "k"), "ticker").join(Q.figures(q, c), "ticker", "left")
    k = F.col("k")
    return j.select(
        "ticker", (k % 17 == 0).alias("seed"), F.col("pct_from_high").alias("drawdown_pct"), "bounce_pct", F.col("return_3m").alias("returns_pct"), "eps_yoy", "sales_yoy",
        F.col("forward_pe").alias("pe"), F.lit(None).cast("double").alias("pb"), "mcap_cr", F.when(k % 19 == 0, (k % 5).cast("int")).alias("stage"),
    )


@query(_ALLQ + _DIST + f", fl AS (SELECT ticker, CASE WHEN NOT core AND NOT seed THEN 0 ELSE floor(greatest(0, least(100, raw)) * 10 + 0.5) / 10 END AS distress_score, core, seed, [x FOR x IN [{_FLAG}] IF x IS NOT NULL] AS f FROM ds) SELECT ticker, distress_score, array_to_string(f, ',') AS distress_flags, CASE WHEN NOT core AND NOT seed THEN 'no_distress' ELSE array_to_string(f[1:4], '|') END AS distress_reason FROM fl")
def x02_distress(spark, d):
    return X.distress(_distress_input(spark, d)).select("ticker", "distress_score", "distress_flags", "distress_reason")


@query(W("company") + " SELECT ticker, least(200, 10 + 10 * (k % 3) + 20 * (k % 4) + CASE WHEN k % 5 = 0 THEN 50 ELSE 0 END + CASE WHEN mcap_cr < 100 THEN 15 ELSE 0 END)::BIGINT AS alpha FROM company")
def x03_alpha(spark, d):
    k = F.col("k")
    return D.company(spark, d).select("ticker", X.alpha(k % 3, k % 4, k % 5 == 0, F.col("mcap_cr")).cast("long").alias("alpha"))


_EV = _FEAT + f""", company AS ({D.SQL['company']}), ev AS (SELECT f.*, (k % 40 - 10)::DOUBLE AS upside_pct, (k % 60 + 40)::DOUBLE AS buy_pct, (k % 30)::DOUBLE AS sell_pct, k % 5 AS positive, k % 4 AS negative, k % 7 AS headlines FROM feat f JOIN company c ON c.ticker = f.symbol),
pn AS (SELECT *,
 50 + CASE WHEN rvol >= 3 THEN 25 WHEN rvol >= 1.5 THEN 12 WHEN rvol < 1 THEN -10 ELSE 0 END + CASE WHEN position_pct >= 85 THEN 15 ELSE 0 END + CASE WHEN price_vs_sma_pct > 1 THEN 10 WHEN price_vs_sma_pct < -1 THEN -12 ELSE 0 END + CASE WHEN day_range_position_pct >= 70 THEN 8 ELSE 0 END AS t,
 50 + CASE WHEN upside_pct >= 15 THEN 25 WHEN upside_pct >= 8 THEN 15 WHEN upside_pct <= 0 THEN -15 ELSE 0 END + CASE WHEN buy_pct >= 70 THEN 12 WHEN buy_pct < 45 THEN -10 ELSE 0 END AS fu,
 50 + CASE WHEN positive - negative >= 2 THEN 20 WHEN positive - negative <= -2 THEN -20 ELSE 0 END + CASE WHEN headlines = 0 THEN -5 ELSE 0 END AS nw,
 40 + CASE WHEN rvol >= 1.5 THEN least(20, floor(rvol * 5 + 0.5)) ELSE 0 END + CASE WHEN position_pct >= 85 THEN 18 ELSE 0 END + CASE WHEN price_vs_sma_pct > 0 THEN 8 ELSE 0 END + CASE WHEN day_range_position_pct >= 65 THEN 8 ELSE 0 END
 + CASE WHEN upside_pct >= 10 THEN 12 ELSE 0 END + CASE WHEN buy_pct >= 80 THEN 10 ELSE 0 END + CASE WHEN positive > negative THEN 6 ELSE 0 END + CASE WHEN window_return_pct > 0 THEN least(10, floor(window_return_pct / 2 + 0.5)) ELSE 0 END AS bu,
 35 + CASE WHEN rvol < 1 THEN 12 ELSE 0 END + CASE WHEN position_pct < 30 THEN 18 ELSE 0 END + CASE WHEN price_vs_sma_pct < -1 THEN 12 ELSE 0 END + CASE WHEN upside_pct <= 0 THEN 15 ELSE 0 END + CASE WHEN buy_pct < 55 THEN 10 ELSE 0 END
 + CASE WHEN pct_from_high <= -20 THEN 10 ELSE 0 END + CASE WHEN sell_pct >= 25 THEN 8 ELSE 0 END + CASE WHEN positive < negative THEN 8 ELSE 0 END + CASE WHEN day_range_position_pct < 35 THEN 8 ELSE 0 END AS be FROM ev),
pc AS (SELECT *, greatest(0, least(100, t))::DOUBLE AS technician, greatest(0, least(100, fu))::DOUBLE AS fundamentalist, greatest(0, least(100, nw))::DOUBLE AS newsdesk, greatest(0, least(100, bu))::DOUBLE AS bull, greatest(0, least(100, be))::DOUBLE AS bear FROM pn),
jd AS (SELECT *, CASE WHEN bull - bear >= 25 AND (position_pct >= 60 OR rvol >= 3) THEN 'BUY' WHEN bull - bear <= -15 THEN 'AVOID' ELSE 'WATCH' END AS verdict, greatest(1, least(10, floor(4 + (bull - bear) / 15 + 0.5))) AS base FROM pc),
jc AS (SELECT *, (CASE WHEN verdict = 'BUY' THEN greatest(base, 7) ELSE least(base, 6) END)::INT AS confidence FROM jd)"""


def _evidence(spark, d):
    c = D.company(spark, d)
    f = S.features(D.bars(spark, d)).join(c.select(F.col("ticker").alias("symbol"), "k"), "symbol")
    k = F.col("k")
    return f.select("*", (k % 40 - 10).cast("double").alias("upside_pct"), (k % 60 + 40).cast("double").alias("buy_pct"), (k % 30).cast("double").alias("sell_pct"), (k % 5).alias("positive"), (k % 4).alias("negative"), (k % 7).alias("headlines"))


@query(_EV + " SELECT symbol, technician, fundamentalist, newsdesk, bull, bear FROM pc")
def x04_panel(spark, d):
    return X.panels(_evidence(spark, d)).select("symbol", "technician", "fundamentalist", "newsdesk", "bull", "bear")


@query(_EV + " SELECT symbol, verdict, confidence, CASE WHEN bull > bear THEN 'bull' WHEN bull < bear THEN 'bear' ELSE 'tie' END AS winner, verdict = 'BUY' AND confidence >= 7 AS fired FROM jc")
def x09_judge(spark, d):
    return X.judge(X.panels(_evidence(spark, d))).select("symbol", "verdict", "confidence", "winner", "fired")


@query(_EV + f" SELECT count(*) AS n, {_r('avg(bull)', 3)} AS avg_bull, {_r('avg(bear)', 3)} AS avg_bear, sum(headlines)::BIGINT AS headlines, count(*) FILTER (WHERE verdict = 'BUY') AS buys, last(symbol ORDER BY confidence, symbol) AS top_pick FROM jc")
def a27_run_kpis(spark, d):
    j = X.judge(X.panels(_evidence(spark, d)))
    return j.agg(F.count("*").alias("n"), num.js_round(F.avg("bull"), 3).alias("avg_bull"), num.js_round(F.avg("bear"), 3).alias("avg_bear"), F.sum("headlines").alias("headlines"), F.count_if(F.col("verdict") == "BUY").alias("buys"), F.max_by("symbol", F.struct("confidence", "symbol")).alias("top_pick"))


@query(_ALLQ + _DIST + ", c AS (SELECT ticker, least(200, 10 + 10 * (k % 3))::BIGINT AS alpha FROM company) SELECT '| ' || ticker || ' | ' || alpha || ' |' AS line FROM c ORDER BY alpha DESC, ticker LIMIT 25")
def k03_report(spark, d):
    k = F.col("k")
    a = D.company(spark, d).select("ticker", X.alpha(k % 3, F.lit(0), F.lit(False), F.lit(None).cast("double")).cast("long").alias("alpha"))
    return a.orderBy(F.desc("alpha"), "ticker").limit(25).select(F.concat(F.lit("| "), "ticker", F.lit(" | "), F.col("alpha").cast("string"), F.lit(" |")).alias("line"))


# --- state over events ---

_ES = "WITH old AS (SELECT user_id, event_type, max(ts) AS ts, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT user_id, event_type, max(ts) AS ts, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1, 2)"


def _old_new(spark, d):
    e = D.table(spark, d, "events")
    last = lambda x: x.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    return last(e.where("event_id % 2 = 0")), last(e.where("event_id % 2 = 1 and user_id % 3 <> 0"))


@query(_ES + " SELECT user_id, event_type, event_id FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, n DESC) = 1")
def i01_upsert(spark, d):
    old, new = _old_new(spark, d)
    return U.upsert(old, new, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query(_ES + " SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, coalesce(CASE WHEN n.event_id % 3 <> 0 THEN n.event_id END, o.event_id) AS event_id FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.event_type = n.event_type")
def i02_coalesce_upsert(spark, d):
    old, new = _old_new(spark, d)
    new = new.withColumn("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return U.coalesce_upsert(old.drop("ts"), new.drop("ts"), ["user_id", "event_type"])


@query("WITH o AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE event_id % 7 = 0 GROUP BY 1), n AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE event_id % 7 = 1 GROUP BY 1) SELECT coalesce(o.user_id, n.user_id) AS user_id, array_to_string(list_concat(coalesce(o.s, []), [x FOR x IN coalesce(n.s, []) IF NOT list_contains(coalesce(o.s, []), x)]), ',') AS sources FROM o FULL JOIN n ON o.user_id = n.user_id")
def i03_list_merge(spark, d):
    e = D.table(spark, d, "events")
    s = lambda r: e.where(f"event_id % 7 = {r}").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return U.list_merge(s(0), s(1), ["user_id"], "s").select("user_id", F.array_join("s", ",").alias("sources"))


@query(_ES + " SELECT user_id, event_type, event_id FROM old WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT user_id, event_type, event_id FROM new")
def i05_replace(spark, d):
    old, new = _old_new(spark, d)
    return U.replace_part(old, new, ["user_id"]).select("user_id", "event_type", "event_id")


@query(_ES + " SELECT user_id, event_type FROM old WHERE user_id NOT IN (SELECT user_id FROM new WHERE event_id % 2 = 1)")
def i21_delete(spark, d):
    old, new = _old_new(spark, d)
    return U.delete_keys(old, new, ["user_id"]).select("user_id", "event_type")


@query("WITH w AS (SELECT DISTINCT user_id FROM events), f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) SELECT user_id FROM w WHERE user_id NOT IN (SELECT user_id FROM f) ORDER BY user_id LIMIT 80")
def j14_pending_anti(spark, d):
    e = D.table(spark, d, "events")
    done = e.where("event_type = 'purchase' and ts > timestamp_ntz '2024-01-30' - interval 24 hours")
    return U.pending(e.select("user_id").distinct(), done, ["user_id"], 80, "user_id")


@query("WITH w AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, max(value) AS best FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0 GROUP BY 1) SELECT w.user_id, r.best FROM w LEFT JOIN r USING (user_id)")
def i16_tombstone(spark, d):
    e = D.table(spark, d, "events")
    return U.with_tombstones(e, e.where("event_type = 'purchase' and user_id % 4 <> 0").groupBy("user_id").agg(F.max("value").alias("best")), ["user_id"])


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id")
def f24_fresh(spark, d):
    e = D.table(spark, d, "events")
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    return e.where((F.col("ts") > at - F.expr("interval 168 hours")) & (F.col("ts") <= at)).groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS without, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a39_scan_counters(spark, d):
    return D.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("without"), F.countDistinct("user_id").alias("users"))


@query("WITH t AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS buy, count(*) FILTER (WHERE event_type = 'click') AS hold FROM events GROUP BY 1) SELECT user_id, " + _r("100 * buy / total", 1) + " AS buy_pct, " + _r("100 * hold / total", 1) + " AS hold_pct FROM t")
def a29_analyst_pct(spark, d):
    t = D.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("buy"), F.count_if(F.col("event_type") == "click").alias("hold"))
    pct = lambda c: num.js_round(100 * F.col(c) / F.col("total"), 1)
    return t.select("user_id", pct("buy").alias("buy_pct"), pct("hold").alias("hold_pct"))


@query("WITH p AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS k, props FROM events) SELECT event_id, k, length(props)::INT AS n FROM p")
def s21_json_props(spark, d):
    e = D.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


@query("SELECT event_id, o, b FROM (SELECT o_orderkey AS event_id, CASE WHEN o_totalprice BETWEEN 100 AND 1e7 THEN floor(o_totalprice / 120 * 10000 + 0.5) / 10000 END AS o, o_orderstatus AS b FROM orders)")
def i12_open_trades(spark, d):
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), P.open_trade(F.col("o_totalprice"), F.lit(120)).alias("o"), F.col("o_orderstatus").alias("b"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st01_signal_windows(spark, d):
    from equiloom.streaming.seats import signal_counts

    e = D.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return signal_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


assert dates and Window
