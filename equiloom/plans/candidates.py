"""Catalysts, candidates, distress rows and the export of gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from equiloom.operators import candidates as K
from equiloom.operators import scores as X
from equiloom.operators import screener as S
from equiloom.plans.base import query
from equiloom.plans.company import _GAP
from equiloom.plans.screener import _NO_SECTOR, _UNIVERSE, _universe
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

#: A company's feed: the turns of the conversations whose number ends like its own, up to thirty.
_NAME = "Steel Works {0} Limited"
_FEED_SQL = """, i AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey AS k, conv_id, turn, row_number() OVER (PARTITION BY s_suppkey ORDER BY conv_id, turn) - 1 AS place FROM supplier JOIN conversations ON conv_id % 97 = s_suppkey % 97 WHERE text IS NOT NULL QUALIFY place < 30),
t AS (SELECT *, CASE WHEN place % 3 = 0 THEN 'steel works ' || k || ' limited' WHEN place % 3 = 1 THEN 'Shares of S' || k || 'XXXXX' ELSE 'others' END || CASE WHEN turn % 4 = 1 THEN ' new plant and order BOOK' WHEN turn % 4 = 2 THEN ' patent with Fund A' ELSE '' END AS title,
 CASE turn % 4 WHEN 1 THEN ['New plant', 'Order book'] WHEN 2 THEN ['Patent', 'Fund A'] ELSE [] END AS matched FROM i),
r AS (SELECT * FROM t WHERE place < 20 AND place % 3 <> 2),
n AS (SELECT ticker, count(*) FILTER (WHERE len(matched) > 0) AS n_news, coalesce(bool_or(turn % 4 = 1), false) AS plant, coalesce(bool_or(turn % 4 = 2), false) AS patent, coalesce(first(title ORDER BY place) FILTER (WHERE len(matched) > 0), first(title ORDER BY place)) AS top_headline FROM r GROUP BY ticker)"""


def _items(spark, d):

    # A feed is the same for all companies of one ending: its turns are ranked once, before they meet the companies.
    c = D.table(spark, d, "conversations").where("text is not null").select((F.col("conv_id") % 97).alias("end"), "conv_id", "turn")
    feeds = c.withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy("conv_id", "turn"))).where("r <= 30").select("end", "turn", (F.col("r") - 1).alias("place"))
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    x = s.join(F.broadcast(feeds), F.col("end") == F.col("k") % 97)  # 97 endings and their signs, thirty turns each: bounded
    k, m, t = F.col("k").cast("string"), F.col("place") % 3, F.col("turn") % 4
    about = F.when(m == 0, F.concat(F.lit("steel works "), k, F.lit(" limited"))).when(m == 1, F.concat(F.lit("Shares of S"), k, F.lit("XXXXX"))).otherwise("others")
    said = F.when(t == 1, " new plant and order BOOK").when(t == 2, " patent with Fund A").otherwise("")
    return x.select(F.concat(F.lit("S"), k, F.lit("XXXXX.NS")).alias("ticker"), F.concat(F.lit("Steel Works "), k, F.lit(" Limited")).alias("name"), "place", F.concat(about, said).alias("title"), F.lit("l").alias("link"), F.lit(None).cast("timestamp").alias("published"))


def _news(spark, d):
    return K.catalysts(_items(spark, d), K.themes(("Fund A", "Fund B"))).withColumn("ticker", F.replace("ticker", F.lit("XXXXX.NS"), F.lit("")))


@query("WITH z AS (SELECT 1)" + _FEED_SQL + " SELECT ticker, n_news, CASE WHEN plant AND patent THEN 'both' WHEN plant THEN 'New plant' WHEN patent THEN 'Patent' ELSE '' END AS moat, CASE WHEN plant THEN 'Order book' ELSE '' END AS growth, CASE WHEN patent THEN 'Fund A' ELSE '' END AS smart, top_headline FROM n")
def a37_catalysts(spark, d):
    """Headlines about a company, by its name or its code in a market's words."""
    moat = F.array_join(F.array_sort("moat_keywords"), ",")
    return _news(spark, d).select("ticker", F.size("news").cast("long").alias("n_news"), F.when(moat == "New plant,Patent", "both").otherwise(moat).alias("moat"), F.array_join("growth_keywords", ",").alias("growth"), F.array_join("smart_money_keywords", ",").alias("smart"), "top_headline")


_CUT = "1998-07-20"
_DEALS_SQL = f""", m AS (SELECT s.symbol AS c, x.* FROM (SELECT DISTINCT ticker AS symbol FROM company) s JOIN deals x ON (starts_with(x.symbol, s.symbol) OR starts_with(s.symbol, x.symbol)) WHERE trade_date >= DATE '{_CUT}' - 90 AND trade_date <= DATE '{_CUT}'),
l AS (SELECT c, string_agg(o::VARCHAR, ',' ORDER BY trade_date DESC, o DESC, l DESC) AS orders FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY trade_date DESC, o DESC, l DESC, quantity DESC, client DESC) <= 5) GROUP BY c),
w AS (SELECT c, count(DISTINCT client) AS n_names FROM m WHERE o % 50 = 7 GROUP BY c)"""


def _deals(spark, d):
    x = D.deals(spark, d).where(F.col("trade_date") <= _CUT).withColumns({"smart_money": F.col("o") % 50 == 7, "pattern": F.lit(None).cast("string")})
    symbols = D.company(spark, d).select(F.col("ticker").alias("symbol"))
    return K.recent_deals(symbols, x.withColumn("deal_type", F.col("o").cast("string")), _CUT, "o", "l", "quantity", "client")


@query(W("company", "deals") + _DEALS_SQL + " SELECT ticker AS symbol, orders, coalesce(n_names, 0) AS n_names FROM company LEFT JOIN l ON l.c = ticker LEFT JOIN w ON w.c = ticker")
def p21_recent_deals(spark, d):
    """The last five deals under any symbol that begins alike, and the names of
    smart money among all of them."""
    return _deals(spark, d).select("symbol", F.array_join(F.transform("bulk_deals", lambda x: x["deal_type"]), ",").alias("orders"), F.coalesce(F.size("deal_keywords").cast("long"), F.lit(0).cast("long")).alias("n_names"))


@query(W("company", "deals") + _FEED_SQL + _DEALS_SQL + " SELECT company.ticker AS symbol, least(200, 10 + 10 * (coalesce(plant, false)::INT + coalesce(patent, false)::INT) + 20 * coalesce(plant, false)::INT + CASE WHEN coalesce(patent, false) OR coalesce(n_names, 0) > 0 THEN 50 ELSE 0 END + CASE WHEN mcap_cr < 100 THEN 15 ELSE 0 END)::BIGINT AS alpha_score, coalesce(patent, false) OR coalesce(n_names, 0) > 0 AS smart_money_flag, top_headline FROM company LEFT JOIN n ON n.ticker = company.ticker LEFT JOIN w ON w.c = company.ticker")
def p21_candidates(spark, d):
    figures = D.company(spark, d).select(F.col("ticker").alias("symbol"), "name", "sector", "price", "mcap_cr")
    out = K.assemble(figures, _news(spark, d), _deals(spark, d))
    return out.select("symbol", F.col("alpha_score").cast("long").alias("alpha_score"), "smart_money_flag", "top_headline")


@query(_UNIVERSE + f" SELECT ticker FROM u WHERE ((NOT stub AND market = 'NSE SME') OR has_fund_a OR has_fund_b) AND {_NO_SECTOR}")
def j26_missing_universe(spark, d):
    return S.missing_rows(_universe(spark, d), "NSE SME", "sector").select("ticker")


_Q = lambda x: f"CASE WHEN regexp_matches({x}, '[\",\\n\\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE coalesce({x}, '') END"
_LINE = " || ',' || ".join([_Q("ticker"), _Q("name || ', \"Ltd\"'"), _Q("market"), _Q("sector"), _Q("sub_sector"), "coalesce(price::DECIMAL(18,3)::VARCHAR, '')", "coalesce(mcap_cr::DECIMAL(18,3)::VARCHAR, '')", _Q("website"), *[f"CASE WHEN {_GAP[g]} THEN '1' ELSE '0' END" for g in ("price", "mcap", "sector", "sub_sector", "about", "web")], "'https://s.example/' || ticker", "'https://t.example/' || ticker"])


@query(_UNIVERSE + f" SELECT 'ticker,name,market,sector,sub_sector,price,mcap_cr,website,missing_price,missing_mcap,missing_sector,missing_sub_sector,missing_about,missing_web,screener,tradingview' AS line UNION ALL SELECT {_LINE} FROM u WHERE (NOT stub OR has_fund_a OR has_fund_b) AND (price IS NULL OR mcap_cr IS NULL)")
def k01_full_export(spark, d):
    """The full layout; names with commas and quotes."""
    u = S.missing_rows(_universe(spark, d), "All", "metrics").withColumns({"name": F.concat("name", F.lit(', "Ltd"')), "price": F.col("price").cast("decimal(18,3)"), "mcap_cr": F.col("mcap_cr").cast("decimal(18,3)")})
    link = lambda host: F.concat(F.lit(f"https://{host}.example/"), F.col("ticker"))
    return S.export_lines(u, True, F.col("website"), link("s"), link("t")).select("line")


@query(_UNIVERSE + f" SELECT 'company name,symbol,website' AS line UNION ALL SELECT name || ',' || ticker || ',' || coalesce(website, '') FROM u WHERE (NOT stub OR has_fund_a OR has_fund_b) AND ({_GAP['web']})")
def k01_basic_export(spark, d):
    u = S.missing_rows(_universe(spark, d), "All", "web")
    return S.export_lines(u, False, F.col("website"), F.lit(""), F.lit("")).select("line")


_FLAGS = [("drawdown", "k % 3 = 0"), ("neg_np_yoy", "k % 4 = 1"), ("own_flag", "k % 5 = 2")]
_LABEL = ", ".join(f"CASE WHEN {c} THEN '{X.FLAG_LABELS.get(f, f)}' END" for f, c in _FLAGS)


@query(W("company") + f" SELECT ticker, CASE WHEN k % 2 = 0 THEN 'Held ' || k ELSE name END AS name, market, CASE WHEN k % 6 = 0 THEN 'Own' ELSE sector END AS sector, k % 2 = 0 AS has_hold, k % 7 = 0 AS has_distress, CASE WHEN k % 5 = 0 THEN k::DOUBLE ELSE mcap_cr END AS mcap_cr, price, array_to_string([x FOR x IN [{_LABEL}] IF x IS NOT NULL], '|') AS flag_labels, CASE WHEN k % 3 = 1 AND k % 4 = 2 THEN 'a,b' WHEN k % 3 = 1 THEN 'a' WHEN k % 4 = 2 THEN 'b' ELSE '' END AS funds FROM company")
def j25_distress_rows(spark, d):
    c, k = D.company(spark, d), F.col("k")
    flags = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(f)) for f, cond in _FLAGS]))
    scored = c.select("ticker", F.lit(50.0).alias("distress_score"), flags.alias("distress_flags"), F.when(k % 5 == 0, k.cast("double")).alias("mcap_cr"), F.lit(None).cast("double").alias("price"))
    held = c.where("k % 2 = 0").select("ticker", F.concat(F.lit("Held "), k.cast("string")).alias("name"), F.lit("BSE").alias("market"), F.when(k % 6 == 0, "Own").alias("sector"))
    funds = c.where("k % 3 = 1").select("ticker", F.lit("a").alias("list")).unionByName(c.where("k % 4 = 2").select("ticker", F.lit("b").alias("list")))
    out = X.distress_rows(scored, held, c, c.where("k % 7 = 0"), funds)
    return out.select("ticker", "name", "market", "sector", "has_hold", "has_distress", "mcap_cr", "price", F.array_join("flag_labels", "|").alias("flag_labels"), F.array_join("fund_lists", ",").alias("funds"))


@query(W("company") + " SELECT 'seeds' AS kind, ticker FROM company WHERE k % 7 = 0 UNION ALL SELECT 'holdings', ticker FROM company WHERE k % 7 = 0 AND k % 2 = 0 UNION ALL SELECT 'nse-sme', ticker FROM company WHERE market = 'NSE SME'")
def s39_distress_lists(spark, d):
    c = D.company(spark, d)
    seeds, held = c.where("k % 7 = 0").select(F.lower("ticker").alias("ticker")), c.where("k % 2 = 0").select("ticker")
    out = [X.distress_list(c, kind, seeds, held).select(F.lit(kind).alias("kind"), "ticker") for kind in ("seeds", "holdings", "nse-sme")]
    return out[0].unionByName(out[1]).unionByName(out[2])
