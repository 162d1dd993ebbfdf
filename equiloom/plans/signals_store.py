"""Shareholders, stored signals, cached candidates and how figures are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.functions import num
from equiloom.operators import signals_store as N
from equiloom.plans.base import query
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

_HOLD = W("holdings") + ", h AS (SELECT symbol, investor, shares, value FROM holdings WHERE investor LIKE '%-1' OR investor LIKE '%-12')"


@query(_HOLD + " SELECT symbol, investor AS holder_name, CASE WHEN investor LIKE 'AUTO%' THEN 'auto' WHEN investor LIKE 'MACH%' THEN 'mach' ELSE 'other' END AS ids, investor LIKE 'MACH%' AS primary_hit, shares, right(symbol, 1) = '3' AS in_sme_universe FROM h")
def s12_shareholders(spark, d):
    """Filings of a symbol: followed holders at several depths, each again
    deeper with other figures, among others."""
    h = D.holdings(spark, d)
    record = lambda name, shares: F.struct(name.alias("shareholderName"), F.format_number(shares, 2).alias("noOfShares"), F.lit("1.5").alias("pct"))
    own = F.struct(F.col("investor").alias("holderName"), F.format_number("shares", 6).alias("shares"), F.lit("{2024}").alias("period"), F.struct(F.array(record(F.col("investor"), F.lit(1.0))).alias("again")).alias("more"))
    docs = h.groupBy("symbol").agg(F.to_json(F.struct(F.struct(F.collect_list(own).alias("rows")).alias("data"), F.array(F.lit("x")).alias("notes"))).alias("v"))
    followed = lambda n: F.when(n.rlike("-12?$"), F.array(F.when(n.startswith("AUTO"), "auto").when(n.startswith("MACH"), "mach").otherwise("other"))).otherwise(F.array().cast("array<string>"))
    names = D.table(spark, d, "part").select(F.upper("p_brand").alias("symbol"), F.col("p_brand").alias("own")).distinct()  # all that may be held
    sme = names.where(F.col("own").endswith("3")).select("symbol")
    out = N.shareholders(docs, "v", "symbol", followed, ("mach",), sme)
    return out.join(names, "symbol").select(F.col("own").alias("symbol"), "holder_name", F.array_join("investor_ids", ",").alias("ids"), "primary_hit", "shares", "in_sme_universe")


_NEWS = """WITH n AS (SELECT event_type AS headline, 'l' || user_id % 7 AS link, ts AS fetched_at, value, CASE WHEN user_id % 3 = 0 THEN 'big' ELSE 'small' END AS who, event_id % 5 = 0 AS fresh FROM events WHERE user_id < 30),
u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY headline, link ORDER BY fresh DESC, fetched_at DESC) = 1)"""


def _news(spark, d):
    e = D.table(spark, d, "events").where("user_id < 30")
    x = e.select(F.col("event_type").alias("headline"), F.concat(F.lit("l"), (F.col("user_id") % 7).cast("string")).alias("link"), F.col("ts").alias("fetched_at"), "value", F.array(F.when(F.col("user_id") % 3 == 0, "big").otherwise("small")).alias("investor_ids"), (F.col("event_id") % 5 == 0).alias("fresh"))
    return N.upsert_news(x.where("not fresh").drop("fresh"), x.where("fresh").drop("fresh"), "fetched_at")


@query(_NEWS + " SELECT headline, link, value, fetched_at FROM u")
def i20_news_upsert(spark, d):
    return _news(spark, d).select("headline", "link", "value", "fetched_at")


@query(_NEWS + ", t AS (SELECT * FROM u ORDER BY fetched_at DESC, headline, link LIMIT 20) SELECT headline, link FROM t WHERE who = 'big'")
def s13_news_signals(spark, d):
    """The last twenty, then those of primary investors."""
    return N.list_news(_news(spark, d), ("big",), 20).select("headline", "link")


@query("WITH c AS (SELECT 'S' || user_id AS symbol, max(value) AS alpha_score, max(ts) AS fetched_at, count(*) AS n FROM events GROUP BY 1), t AS (SELECT * FROM c WHERE alpha_score >= 50 ORDER BY alpha_score DESC, symbol LIMIT 40) SELECT symbol, alpha_score, n, 'Name ' || symbol AS name FROM t WHERE fetched_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 96 HOUR AND n % 4 <> 1")
def s16_cached_candidates(spark, d):
    c = D.table(spark, d, "events").groupBy(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol")).agg(F.max("value").alias("alpha_score"), F.max("ts").alias("fetched_at"), F.count("*").alias("n"))
    whole = F.to_json(F.struct("n", F.concat(F.lit("Name "), "symbol").alias("name")))
    c = c.withColumn("payload", F.when(F.col("n") % 4 == 1, F.lit('{"n": 1, "name')).otherwise(whole))
    return N.cached_candidates(c, "n long, name string", "2024-01-30 12:00:00", 96, 50, 40)


@query(W("company") + " SELECT 'S' || user_id AS symbol, event_id, coalesce(market, 'NSE') AS market, website AS web, about, sub_sector AS headquarters FROM events LEFT JOIN company ON ticker = 'S' || user_id WHERE event_type = 'purchase'")
def j27_verdict_meta(spark, d):
    v = D.table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("symbol"), "event_id", F.lit("NSE").alias("market"))
    return N.verdict_meta(v, D.company(spark, d).withColumnRenamed("sub_sector", "headquarters")).withColumn("symbol", F.upper("symbol"))


_PART = {"Sector": "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE ' ' END", "IGroup": "CASE WHEN p_size % 3 = 0 THEN p_name END", "IndustryNew": "CASE WHEN p_size % 5 = 0 THEN p_type END", "Industry": "CASE WHEN p_size % 7 <> 0 THEN p_type END", "ISubGroup": "CASE WHEN p_size % 4 = 0 THEN p_name END"}


@query("WITH h AS (SELECT p_partkey, " + ", ".join(f"nullif(trim({v}), '') AS {k}" for k, v in _PART.items()) + " FROM part) SELECT p_partkey, Sector AS sector, coalesce(IGroup, IndustryNew, Industry) AS industry, coalesce(ISubGroup, Industry, IGroup, IndustryNew) AS sub_sector FROM h")
def p27_taxonomy(spark, d):
    return D.table(spark, d, "part").select("p_partkey", *N.taxonomy({k: F.expr(v) for k, v in _PART.items()}))


@query("SELECT c_custkey, nullif(concat_ws(', ', CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 > 2 THEN c_name END, CASE WHEN c_custkey % 2 = 1 THEN 'India' END), '') AS hq FROM customer")
def t23_headquarters(spark, d):
    k = F.col("c_custkey")
    c = D.table(spark, d, "customer")
    return c.select("c_custkey", N.headquarters(F.when(k % 3 > 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" "), F.when(k % 5 > 2, F.col("c_name")), F.when(k % 2 == 1, "India").otherwise("")).alias("hq"))


@query("SELECT DISTINCT p_type, CASE WHEN p_type LIKE '%STEEL' THEN 'theme steel' WHEN p_type LIKE '%TIN' THEN 'a soft metal' WHEN p_type LIKE '%BRASS' THEN 'an alloy' ELSE 'see elsewhere' END AS tip FROM part")
def p23_glossary(spark, d):
    p = D.table(spark, d, "part").select("p_type").distinct()
    word = F.substring_index("p_type", " ", -1)
    asked = F.when(word == "TIN", "  Tins").when(word == "BRASS", "yellow  METALS").otherwise(word)
    return p.select("p_type", N.explained(asked, [{"steel": "theme steel"}, {"steel": "plain", "tin": "a soft metal", "brass": "an alloy"}], {"yellow metal": "brass"}, "see elsewhere").alias("tip"))


_G = lambda v: f"CASE WHEN {v} < 1000 THEN ({v})::VARCHAR WHEN {v} < 100000 THEN ({v} // 1000)::VARCHAR || ',' || lpad(({v} % 1000)::VARCHAR, 3, '0') ELSE CASE WHEN {v} < 10000000 THEN ({v} // 100000)::VARCHAR ELSE ({v} // 10000000)::VARCHAR || ',' || lpad(({v} // 100000 % 100)::VARCHAR, 2, '0') END || ',' || lpad(({v} // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad(({v} % 1000)::VARCHAR, 3, '0') END"


@query(f"WITH o AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v, floor(o_totalprice)::BIGINT AS w FROM orders) SELECT o_orderkey, {_G('w')} || '.' || right(v::VARCHAR, 2) AS quarter, '₹' || {_G('w')} || CASE WHEN right(v::VARCHAR, 2) = '00' THEN '' ELSE '.' || rtrim(right(v::VARCHAR, 2), '0') END AS inr, CASE WHEN o_orderkey % 3 = 0 THEN '—' WHEN o_totalprice >= 500 THEN 'N/M' ELSE 'low' END AS pe, CASE WHEN o_orderkey % 3 = 0 THEN 'N/M' ELSE '+' || {_G('w')} || '%' END AS yoy  FROM o JOIN orders USING (o_orderkey)")
def t20_formatters(spark, d):
    o = D.table(spark, d, "orders")
    some = lambda c: F.when(F.col("o_orderkey") % 3 > 0, c)
    v = F.col("o_totalprice")
    return o.select("o_orderkey", num.quarter_value(v, 2).alias("quarter"), num.rupees(v).alias("inr"), num.pe_shown(some(v)).alias("pe"), num.yoy_shown(some(F.floor(v).cast("double"))).alias("yoy"))
