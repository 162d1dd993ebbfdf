"""Queries on scan lists, governance filters, orders and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.functions import dates, num, text
from equiloom.operators import governance as G
from equiloom.operators import holdings as H
from equiloom.operators import lists as L
from equiloom.plans.base import query
from equiloom.plans.company import _ROWS, _SCORED, _board
from equiloom.plans.flows import _H, _held
from equiloom.plans.texts import _pattern
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

_COMPANY = W("company")


@query(_COMPANY + ", r AS (SELECT ticker AS symbol, CASE WHEN k % 3 = 0 THEN '—' WHEN k % 3 = 1 THEN 'Own' END AS sector, CAST(NULL AS VARCHAR) AS sub_sector FROM company), c AS (SELECT ticker, sector, sub_sector FROM company WHERE k % 4 <> 0) SELECT symbol, CASE WHEN coalesce(trim(r.sector), '') IN ('', '—') AND c.ticker IS NOT NULL THEN coalesce(c.sector, r.sector) ELSE r.sector END AS sector, CASE WHEN coalesce(trim(r.sector), '') IN ('', '—') AND c.ticker IS NOT NULL THEN coalesce(c.sub_sector, r.sub_sector) ELSE r.sub_sector END AS sub_sector FROM r LEFT JOIN c ON c.ticker = r.symbol")
def j17_fill_sector(spark, d):
    c, k = D.company(spark, d), F.col("k")
    rows = c.select(F.col("ticker").alias("symbol"), F.when(k % 3 == 0, "—").when(k % 3 == 1, "Own").alias("sector"), F.lit(None).cast("string").alias("sub_sector"))
    return L.fill_sector(rows, c.where("k % 4 <> 0"), "symbol")


@query(_COMPANY + " SELECT c.ticker, h.website FROM company c LEFT JOIN (SELECT ticker, website FROM company WHERE k % 2 = 0) h USING (ticker)")
def j18_websites(spark, d):
    c = D.company(spark, d)
    return c.select("ticker").join(c.where("k % 2 = 0").select("ticker", "website"), "ticker", "left")


@query(_COMPANY + " SELECT DISTINCT ticker FROM company WHERE k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0")
def u07_priority_symbols(spark, d):
    c = D.company(spark, d)
    part = lambda n: c.where(f"k % {n} = 0").select(F.lower("ticker").alias("ticker") if n == 7 else F.col("ticker"))
    return L.distinct_sources(part(5), part(7), part(11))


@query(_COMPANY + " SELECT ticker, about FROM company WHERE k % 4 = 0 UNION ALL SELECT ticker, NULL FROM company WHERE k % 6 = 0 AND k % 4 <> 0")
def u08_notes(spark, d):
    c = D.company(spark, d)
    some = c.where("k % 6 = 0").select("ticker")
    return L.notes(c.where("k % 4 = 0").select("ticker", "about"), some.unionByName(some))


@query(_COMPANY + ", f AS (SELECT ticker, 'a' AS list_key FROM company WHERE k % 2 = 0 UNION ALL SELECT ticker, 'b' FROM company WHERE k % 3 = 0) SELECT ticker, min(list_key) AS list_key FROM f GROUP BY ticker")
def u09_fund_rows(spark, d):
    from equiloom.operators.company import first_per_key

    c = D.company(spark, d)
    f = c.where("k % 2 = 0").select("ticker", F.lit("a").alias("list_key")).unionByName(c.where("k % 3 = 0").select("ticker", F.lit("b").alias("list_key")))
    return first_per_key(f, "ticker", "list_key")


@query(_COMPANY + ", f AS (SELECT ticker, 'a' AS list_key FROM company WHERE k % 2 = 0 UNION ALL SELECT ticker, 'b' FROM company WHERE k % 3 = 0) SELECT list_key, count(*) AS n FROM f GROUP BY 1")
def a33_fund_counts(spark, d):
    c = D.company(spark, d)
    f = c.where("k % 2 = 0").select(F.lit("a").alias("list_key")).unionByName(c.where("k % 3 = 0").select(F.lit("b").alias("list_key")))
    return f.groupBy("list_key").agg(F.count("*").alias("n"))


@query(_H + ", m AS (SELECT symbol, substr(investor, 1, 4) AS house, pct, value, investor AS name, change_type AS entity FROM hp) SELECT symbol, house, max(pct) AS pct, max(value) AS value, last(name ORDER BY length(name), name) AS name, string_agg(DISTINCT entity, ', ' ORDER BY entity) AS entities FROM m GROUP BY 1, 2")
def a20_collapse(spark, d):
    h = _held(spark, d).select("symbol", F.substring("investor", 1, 4).alias("house"), "pct", "value", F.col("investor").alias("name"), F.col("change_type").alias("entity"))
    return L.collapse(h, "symbol", "house")


@query(_H + " SELECT symbol, investor, value FROM hp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY coalesce(value, 0) DESC, investor DESC) = 1")
def a21_greatest_row(spark, d):
    return L.greatest_rows(_held(spark, d), ["symbol"], "value", "investor").select("symbol", "investor", "value")


@query(_H + ", c AS (SELECT symbol, count(DISTINCT investor) AS investors, count(*) FILTER (WHERE change_type = 'new') AS new_count, count(*) FILTER (WHERE change_type = 'increased') AS increased_count, sum(value::DECIMAL(18,2))::DOUBLE AS total_value FROM hp GROUP BY symbol) SELECT symbol, investors, new_count, increased_count, row_number() OVER (ORDER BY investors DESC, new_count DESC, increased_count DESC, total_value DESC, symbol) AS place FROM c WHERE investors >= 2 QUALIFY place <= 25")
def o06_consensus_order(spark, d):
    from pyspark.sql import Window

    top = H.consensus(_held(spark, d)).orderBy(*L.consensus_order()).limit(25)  # a report's length
    return top.select("symbol", "investors", "new_count", "increased_count", F.row_number().over(Window.orderBy(*L.consensus_order())).cast("long").alias("place"))


_CURATED = {"MACHINERY-3": 0, "AUTOMOBILE-1": 1}


@query(_H + ", s AS (SELECT investor, count(*) AS holdings FROM hp GROUP BY 1) SELECT investor, holdings, row_number() OVER (ORDER BY CASE investor WHEN 'MACHINERY-3' THEN 0 WHEN 'AUTOMOBILE-1' THEN 1 END NULLS LAST, holdings DESC, investor) AS place FROM s QUALIFY place <= 25")
def o07_investor_order(spark, d):
    from pyspark.sql import Window

    s = H.investor_summary(_held(spark, d)).select("investor", "holdings")
    order = L.curated_order(s, _CURATED)
    return s.orderBy(*order).limit(25).select("investor", "holdings", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(_SCORED + " SELECT person_id, score, board_count FROM scored WHERE score >= 40 AND board_count >= 3 AND din IS NOT NULL AND NOT name_collision AND bridge AND tiny_bridge")
def f18_director_filters(spark, d):
    s = G.director_scores(_board(spark, d))
    return L.director_filter(s, 40, 3, hide_collision=True, din_only=True, bridge=True, tiny_bridge=True).select("person_id", "score", "board_count")


@query(_SCORED + " SELECT person_id, row_number() OVER (ORDER BY board_count DESC, score DESC, director, person_id) AS place FROM scored QUALIFY place <= 40")
def o03_director_order(spark, d):
    from pyspark.sql import Window

    order = L.director_order("boards")
    return G.director_scores(_board(spark, d)).orderBy(*order).limit(40).select("person_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


_SEAT = "copper + chairperson | independent director"


def _seat_rows(spark, d):
    r = G.seat_rows(D.seats(spark, d), D.company(spark, d))
    return r.withColumns({"cap_code": num.cap_code(F.col("mcap_cr")), "seat_text": F.concat_ws(" ", "designation", "company")})


_CODE = "CASE WHEN mcap_cr > 0 THEN CASE WHEN mcap_cr < 100 THEN 'TI' WHEN mcap_cr < 500 THEN 'MIC' WHEN mcap_cr < 5000 THEN 'SC' WHEN mcap_cr < 20000 THEN 'MC' ELSE 'LC' END END"
_HITS = "coalesce(" + _pattern("designation || ' ' || company", _SEAT) + ", false)"


@query(_ROWS + f" SELECT person_id, ticker FROM rows_ WHERE {_HITS} AND coalesce({_CODE}, 'NC') = 'SC'")
def f36_seat_filter(spark, d):
    return L.seat_filter(_seat_rows(spark, d), "sc", pattern=_SEAT).select("person_id", "ticker")


@query(_ROWS + f", h AS (SELECT *, {_HITS} AS theme_hit FROM rows_) SELECT person_id, ticker, theme_hit, row_number() OVER (PARTITION BY person_id ORDER BY theme_hit DESC, ticker) AS place FROM h QUALIFY bool_or(theme_hit) OVER (PARTITION BY person_id) AND bool_or(market = 'NSE SME') OVER (PARTITION BY person_id)")
def o16_theme_first(spark, d):
    from pyspark.sql import Window

    r = _seat_rows(spark, d).withColumn("flag", F.col("market") == "NSE SME")
    hit = L.seat_filter(L.seat_filter(r, any_flag=("flag",)), pattern=_SEAT, show_all=True)
    place = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("theme_hit"), "ticker"))
    return hit.select("person_id", "ticker", "theme_hit", place.cast("long").alias("place"))


# --- dates and numbers ---


@query("SELECT DISTINCT upper(strftime(o_orderdate, '%-d-%b-%Y')) AS raw, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def d02_quarter_end(spark, d):
    raw = F.upper(F.date_format("o_orderdate", "d-MMM-yyyy"))
    return D.table(spark, d, "orders").select(raw.alias("raw")).distinct().select("raw", dates.quarter_end_iso(F.col("raw")).alias("iso"))


@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms FROM events")
def d07_broadcast(spark, d):
    raw = F.upper(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss"))
    return D.table(spark, d, "events").select("event_id", dates.broadcast_ms(raw).alias("ms"))


@query("SELECT p_partkey, coalesce(try_cast(regexp_extract(p_brand, '\\d+$') AS DOUBLE), p_retailprice) AS figure FROM part")
def m11_pick_first(spark, d):
    p = D.table(spark, d, "part")
    return p.select("p_partkey", num.first_number(F.col("p_name"), F.regexp_extract("p_brand", "\\d+$", 0), F.col("p_retailprice").cast("string")).alias("figure"))


# --- incremental state ---


@query(_COMPANY + " SELECT ticker || '.NS' AS ticker, 1 AS at FROM company WHERE k % 2 = 1 UNION ALL SELECT 'NSE:' || ticker, 2 FROM company WHERE k % 2 = 0")
def i11_alias_upsert(spark, d):
    c = D.company(spark, d)
    old = c.select(F.concat("ticker", F.lit(".NS")).alias("ticker"), F.lit(1).alias("at"))
    return L.alias_upsert(old, c.where("k % 2 = 0").select(F.concat(F.lit("NSE:"), "ticker").alias("ticker"), F.lit(2).alias("at")), "ticker")


@query(_COMPANY + " SELECT ticker FROM company WHERE k % 3 <> 0")
def i18_invalidate(spark, d):
    c = D.company(spark, d).select("ticker", "k")
    return L.invalidate(c, c.where("k % 3 = 0").select(F.concat(F.lower("ticker"), F.lit(".bo")).alias("ticker")), "ticker").select("ticker")


@query(_COMPANY + ", f AS (SELECT ticker, 'found ' || ticker AS about, 'w' AS website FROM company WHERE k % 2 = 0 UNION ALL SELECT 'N' || k, 'new', 'w' FROM company WHERE k % 40 = 0) SELECT coalesce(c.ticker, f.ticker) AS ticker, coalesce(nullif(trim(c.about), ''), f.about) AS about, coalesce(c.website, f.website) AS website FROM company c FULL JOIN f USING (ticker)")
def i14_backfill(spark, d):
    c = D.company(spark, d)
    f = c.where("k % 2 = 0").select("ticker", F.concat(F.lit("found "), "ticker").alias("about"), F.lit("w").alias("website"))
    f = f.unionByName(c.where("k % 40 = 0").select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("ticker"), F.lit("new").alias("about"), F.lit("w").alias("website")))
    return L.backfill(c.select("ticker", "about", "website"), f, ["ticker"])


@query("SELECT user_id AS run_id, max(ts) FILTER (WHERE event_type = 'click') AS started, max(ts) FILTER (WHERE event_type = 'purchase') AS finished, count(*) FILTER (WHERE event_type = 'view') AS verdicts FROM events GROUP BY 1")
def i13_runs(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "click", "start").when(e == "purchase", "finish").when(e == "view", "verdict")
    return L.runs(D.table(spark, d, "events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), F.col("ts").alias("at")))


@query("WITH c AS (SELECT 'S' || user_id AS ticker, max(ts) AS cached_at, max(value) AS score FROM events GROUP BY 1) SELECT ticker, score FROM c WHERE ticker IN (SELECT 'S' || s_suppkey FROM supplier) AND cached_at > TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 72 HOUR AND score >= 10 ORDER BY score DESC, ticker LIMIT 50")
def s15_distress_cache(spark, d):
    e = D.table(spark, d, "events").groupBy(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("ticker")).agg(F.max("ts").alias("cached_at"), F.max("value").alias("score"))
    return L.ttl_scan(e, D.company(spark, d), "2024-01-28 00:00:00", 72, 10, 50).select("ticker", "score")


@query("SELECT conv_id, turn, array_to_string([x FOR x IN ['order', 'export', 'wind'] IF contains(lower(text), x) AND x IN ('order', 'wind')], ',') AS smart FROM conversations WHERE text IS NOT NULL")
def p26_smart_evidence(spark, d):
    c = D.table(spark, d, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.array_join(F.array_intersect(text.keyword_hits(F.col("text"), ["order", "export", "wind"]), F.array(F.lit("order"), F.lit("wind"))), ",").alias("smart"))


_SHORTS = {f"{s}-{i}": ("Big " + s[:3] if i == 0 else "") for s in ("AUTOMOBILE", "BUILDING", "MACHINERY") for i in range(3)}
_SHORT = "CASE " + " ".join(f"WHEN investor = '{k}' THEN '{v or ' '.join(k.split()[:2])}'" for k, v in _SHORTS.items()) + " ELSE investor END"
_CONS = _H + f""", z AS (SELECT upper(symbol) AS symbol, investor, {_SHORT} AS short, change_type, CASE WHEN shares::BIGINT % 3 > 0 THEN pct * 1.0101 * CASE WHEN change_type = 'decreased' THEN -1 ELSE 1 END END AS change, pct, value,
 row_number() OVER (PARTITION BY symbol ORDER BY value DESC, investor) AS place FROM hp),
b AS (SELECT *, CASE change_type WHEN 'new' THEN ' NEW' WHEN 'increased' THEN ' ↑' || coalesce('+' || printf('%.2f', change) || '%', '') WHEN 'decreased' THEN ' ↓' || coalesce(printf('%.2f', change) || '%', '') ELSE '' END AS badge FROM z),
cons AS (SELECT symbol, 'Name ' || first(investor ORDER BY place) AS company_name, count(DISTINCT investor) AS investor_count, count(*) FILTER (WHERE change_type = 'new') AS new_count, count(*) FILTER (WHERE change_type = 'increased') AS increased_count, max(pct) AS holding_percent,
 floor(sum((value / 1000)::DECIMAL(38,6))::DOUBLE * 100 + 0.5) / 100 AS combined_value_cr, string_agg(short || badge, ' · ' ORDER BY investor) AS activity, string_agg(short, ', ' ORDER BY investor) AS shorts FROM b GROUP BY symbol)"""


def _consensus(spark, d):
    from pyspark.sql import Window

    h = _held(spark, d)
    change = F.when(F.col("shares").cast("long") % 3 > 0, F.col("pct") * 1.0101 * F.when(F.col("change_type") == "decreased", -1).otherwise(1))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("value"), "investor"))
    rows = h.select(F.lower("symbol").alias("symbol"), "investor", "change_type", change.alias("change"), "pct", (F.col("value") / 1000).alias("value_cr"), place.alias("place"), F.concat(F.lit("Name "), "investor").alias("company_name"), F.lit("").alias("exchange"), F.lit(None).cast("string").alias("sector"), F.col("pct").alias("price"))
    return H.consensus_rows(rows, 2, _SHORTS)


@query(_CONS + " SELECT symbol, company_name, investor_count::INT AS investor_count, new_count, increased_count, holding_percent, combined_value_cr, activity, shorts FROM cons WHERE investor_count >= 2")
def a17_consensus_rows(spark, d):
    return _consensus(spark, d).select("symbol", "company_name", "investor_count", "new_count", "increased_count", "holding_percent", "combined_value_cr", "activity", F.array_join("investor_shorts", ", ").alias("shorts"))


@query(_CONS + " SELECT symbol, row_number() OVER (ORDER BY investor_count DESC, new_count DESC, increased_count DESC, combined_value_cr DESC, symbol) AS place FROM cons WHERE investor_count >= 2 AND contains(lower(activity), 'big mac') AND combined_value_cr >= 50 QUALIFY place <= 200")
def o12_consensus_list(spark, d):
    from pyspark.sql import Window

    rows = H.consensus_filter(_consensus(spark, d), search=" Big MAC ", min_value=50)
    return rows.orderBy(*H.consensus_order()).limit(200).select("symbol", F.row_number().over(Window.orderBy(*H.consensus_order())).cast("long").alias("place"))
