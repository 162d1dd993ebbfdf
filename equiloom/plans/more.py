"""Further queries: list sources, row projections, filters and name functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from equiloom.functions import num, text
from equiloom.operators import company as C
from equiloom.operators import fundamentals as Q
from equiloom.operators import indicators as I
from equiloom.operators import themes as TH
from equiloom.plans.base import query
from equiloom.plans.company import _ROWS
from equiloom.plans.market import _VAL, _YOY, _r
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W


@query(W("company") + ", own AS (SELECT ticker FROM company WHERE k % 1000 = 999), alt AS (SELECT ticker FROM company WHERE k % 9 = 0) SELECT ticker FROM own UNION ALL SELECT ticker FROM alt WHERE NOT EXISTS (SELECT 1 FROM own)")
def s08_list_fallback(spark, d):
    """A list, or another where it is empty."""
    c = D.company(spark, d)
    own, alt = c.where("k % 1000 = 999").select("ticker"), c.where("k % 9 = 0").select("ticker")
    some = own.limit(1).select(F.lit(1).alias("one"))
    return own.unionByName(alt.join(some, F.lit(True), "left_anti"))


@query("WITH h AS (SELECT conv_id, turn, role FROM conversations WHERE length(text) > 40 ORDER BY turn DESC, conv_id, role LIMIT 200) SELECT * FROM h WHERE role = 'assistant'")
def s12_list_hits(spark, d):
    """Ordered and cut before the last filter, as the source does."""
    c = D.table(spark, d, "conversations").where(F.length("text") > 40)
    return c.orderBy(F.desc("turn"), "conv_id", "role").limit(200).where("role = 'assistant'").select("conv_id", "turn", "role")


@query("SELECT user_id, max(ts) AS at, max(value) AS score FROM events WHERE value >= 10 GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-25' ORDER BY score DESC, user_id LIMIT 50")
def s15_ttl_scan(spark, d):
    e = D.table(spark, d, "events").where("value >= 10").groupBy("user_id").agg(F.max("ts").alias("at"), F.max("value").alias("score"))
    return e.where("at > timestamp_ntz '2024-01-25'").orderBy(F.desc("score"), "user_id").limit(50)


@query(W("bars") + ", a AS (SELECT 'S' || (substr(symbol, 2)::INT % 10) AS ticker, symbol AS alias, count(*) AS n FROM bars GROUP BY ALL) SELECT ticker, alias, n FROM a QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY (alias = ticker AND n >= 5) DESC, n DESC, alias) = 1")
def s26_best_series(spark, d):
    """The primary alias if it has five bars, or else the longest."""
    b = D.bars(spark, d).groupBy(F.concat(F.lit("S"), (F.substring("symbol", 2, 9).cast("int") % 10).cast("string")).alias("ticker"), F.col("symbol").alias("alias")).agg(F.count("*").alias("n"))
    return C.first_per_key(b, "ticker", F.desc((F.col("alias") == F.col("ticker")) & (F.col("n") >= 5)), F.desc("n"), "alias")


@query("SELECT user_id, first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL AND event_type = 'click') AS click_value, first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL) AS any_value, coalesce(first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL AND event_type = 'click'), first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL)) AS value FROM events GROUP BY user_id")
def s36_quote_merge(spark, d):
    """The first known figure over aliases in order of rank."""
    v = F.col("value").isNotNull()
    e = D.table(spark, d, "events").groupBy("user_id").agg(
        F.min_by("value", F.when(v & (F.col("event_type") == "click"), F.col("event_id"))).alias("click_value"), F.min_by("value", F.when(v, F.col("event_id"))).alias("any_value")
    )
    return e.select("*", F.coalesce("click_value", "any_value").alias("value"))


_MENU_TEXT = "About Us Investor Relations Board of Directors Career and a line of further words to make it long enough"


@query(W("company") + f", t AS (SELECT ticker, CASE WHEN k % 4 = 0 THEN '{_MENU_TEXT}' ELSE about END AS a, CASE WHEN k % 3 = 0 THEN 'Scraped ' || name WHEN k % 5 = 0 THEN '{_MENU_TEXT}' END AS s, CASE WHEN k % 2 = 0 THEN 'Yahoo ' || name END AS y FROM company), j AS (SELECT *, a = '{_MENU_TEXT}' AS ja, s = '{_MENU_TEXT}' AS js FROM t) SELECT ticker, coalesce(CASE WHEN ja THEN y END, CASE WHEN NOT ja THEN a END, CASE WHEN NOT js THEN s END, y, a, s) AS about FROM j")
def p04_about_text(spark, d):
    k = F.col("k")
    menu = F.lit(_MENU_TEXT)
    t = D.company(spark, d).select("ticker", F.when(k % 4 == 0, menu).otherwise(F.col("about")).alias("a"), F.when(k % 3 == 0, F.concat(F.lit("Scraped "), "name")).when(k % 5 == 0, menu).alias("s"), F.when(k % 2 == 0, F.concat(F.lit("Yahoo "), "name")).alias("y"))
    return t.select("ticker", text.pick_about(F.col("a"), F.col("y"), F.col("s")).alias("about"))


@query(_ROWS + " SELECT person_id, ticker, company, CASE WHEN mcap_cr > 0 THEN CASE WHEN mcap_cr < 100 THEN 'TI' WHEN mcap_cr < 500 THEN 'MIC' WHEN mcap_cr < 5000 THEN 'SC' WHEN mcap_cr < 20000 THEN 'MC' ELSE 'LC' END END AS cap_code, market = 'NSE SME' AS is_sme, designation || ' @ ' || company AS about_search FROM rows_")
def p13_seat_projection(spark, d):
    from equiloom.operators import governance as G

    r = G.seat_rows(D.seats(spark, d), D.company(spark, d))
    return r.select("person_id", "ticker", "company", num.cap_code(F.col("mcap_cr")).alias("cap_code"), (F.col("market") == "NSE SME").alias("is_sme"), F.concat_ws(" @ ", "designation", "company").alias("about_search"))


@query(W("quarters", "company") + _YOY + _VAL + " SELECT ticker, CASE WHEN forward_pe IS NULL THEN 'na' WHEN forward_pe > 40 THEN 'bad' WHEN forward_pe > 20 THEN 'mid' ELSE 'good' END AS pe_dot, CASE WHEN eps_yoy IS NULL THEN 'na' WHEN eps_yoy > 0 THEN 'good' WHEN eps_yoy < 0 THEN 'bad' ELSE 'mid' END AS eps_dot FROM val JOIN yoy USING (ticker)")
def p22_dots(spark, d):
    q = D.quarters(spark, d)
    v = Q.valuation(q, D.company(spark, d).select("ticker", "price")).join(Q.yoy(q), "ticker")
    pe, y = F.col("forward_pe"), F.col("eps_yoy")
    return v.select("ticker", F.when(pe.isNull(), "na").when(pe > 40, "bad").when(pe > 20, "mid").otherwise("good").alias("pe_dot"), F.when(y.isNull(), "na").when(y > 0, "good").when(y < 0, "bad").otherwise("mid").alias("eps_dot"))


@query("SELECT c_custkey, CASE WHEN e IN ('BSE SME', 'BSE') THEN e WHEN contains(e, 'SME') THEN 'NSE SME' ELSE 'NSE' END AS market, upper(left(c_mktsegment, 2)) AS initials FROM (SELECT *, ['BSE SME', 'BSE', 'NSE SME', 'NSE', ''][c_custkey % 5 + 1] AS e FROM customer)")
def p19_market(spark, d):
    e = F.element_at(F.array(*[F.lit(x) for x in ("bse sme", "BSE ", "nse sme", "NSE", "")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return D.table(spark, d, "customer").select("c_custkey", text.market_of(e).alias("market"), text.initials(F.col("c_mktsegment")).alias("initials"))


_ODD = "CASE k % 5 WHEN 0 THEN ticker || '-RE' WHEN 1 THEN ticker || '-w' WHEN 2 THEN '0P' || ticker ELSE ticker END"


@query(W("company") + f", t AS (SELECT {_ODD} AS ticker FROM company) SELECT ticker FROM t WHERE length(trim(ticker)) >= 2 AND NOT contains(upper(ticker), '-RE') AND NOT regexp_matches(upper(ticker), '-W$|^0P')")
def f21_skippable(spark, d):
    """Rights, warrants and fund codes have no bars."""
    k, t = F.col("k") % 5, F.col("ticker")
    c = D.company(spark, d).select(F.when(k == 0, F.concat(t, F.lit("-RE"))).when(k == 1, F.concat(t, F.lit("-w"))).when(k == 2, F.concat(F.lit("0P"), t)).otherwise(t).alias("ticker"))
    up = F.upper(F.trim("ticker"))
    return c.where((F.length(up) >= 2) & ~up.contains("-RE") & ~up.rlike("-W$|^0P"))


@query(W("company", "bars") + ", v AS (SELECT symbol, avg(volume) AS vol FROM bars GROUP BY 1) SELECT ticker, CASE WHEN price IS NULL AND mcap_cr IS NULL THEN 'no quote' WHEN mcap_cr IS NULL OR mcap_cr < 20 OR mcap_cr > 200 THEN 'mcap' WHEN vol IS NULL OR vol < 1000 THEN 'volume' ELSE 'ok' END AS reason FROM company LEFT JOIN v ON symbol = ticker")
def f25_fundamentals_gate(spark, d):
    v = D.bars(spark, d).groupBy(F.col("symbol").alias("ticker")).agg(F.avg("volume").alias("vol"))
    return D.company(spark, d).join(v, "ticker", "left").select("ticker", C.fundamentals_gate(F.col("price"), F.col("mcap_cr"), F.col("vol")).alias("reason"))


_NAMES = [("Export Order Services Limited", "EXPORT.NS"), ("Tion Wind Energy India Limited", "TION"), ("Acquire Capex Holdings Ltd", "ACQUIREC-SM.NS")]
_PHRASES = [["export order services limited", "export order", "export", "order"], ["tion wind energy india limited", "tion wind energy", "tion wind", "energy"], ["acquire capex holdings ltd", "acquire capex", "acquire", "capex"]]


def _names(i: int) -> str:
    name, symbol = _NAMES[i]
    bare = symbol.replace("-SM.NS", "").replace(".NS", "").lower()
    by = [f"contains(lower(text), '{p}')" for p in _PHRASES[i] if len(p) >= 8]
    context = "" if len(bare) >= 7 else f" AND regexp_matches(lower(text), '{text.STOCK_CONTEXT}')"
    return "coalesce(" + " OR ".join([*by, f"(contains(lower(text), '{bare}'){context})"]) + ", false)"


@query("SELECT conv_id, turn, " + ", ".join(f"{_names(i)} AS about_{i}" for i in range(3)) + r", coalesce(regexp_matches(text, '" + text.NEWS_NOISE + "'), false) AS noise FROM conversations")
def f26_headline(spark, d):
    t = F.coalesce("text", F.lit(""))
    return D.table(spark, d, "conversations").select("conv_id", "turn", *[text.headline_names(t, F.lit(n), F.lit(s)).alias(f"about_{i}") for i, (n, s) in enumerate(_NAMES)], t.rlike(text.NEWS_NOISE).alias("noise"))


@query(W("company") + ", m AS (SELECT ticker, market, name FROM company UNION ALL SELECT ticker, 'BSE', name || ' (B)' FROM company WHERE k % 2 = 0) SELECT ticker, name FROM m QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY (market = 'BSE') DESC, name) = 1")
def j22_meta_pick(spark, d):
    """A ticker's row of the preferred market, or else the first."""
    c = D.company(spark, d)
    both = c.select("ticker", "market", "name").unionByName(c.where("k % 2 = 0").select("ticker", F.lit("BSE").alias("market"), F.concat("name", F.lit(" (B)")).alias("name")))
    return C.first_per_key(both, "ticker", F.desc(F.col("market") == "BSE"), "name").select("ticker", "name")


@query(W("company") + ", b AS (SELECT ticker, 'B ' || name AS about, 'https://b.example/' || ticker AS website FROM company WHERE k % 2 = 1) SELECT c.ticker, coalesce(c.about, b.about) AS about, coalesce(c.website, b.website) AS website FROM company c LEFT JOIN b USING (ticker)")
def j28_hydrate(spark, d):
    c = D.company(spark, d)
    b = c.where("k % 2 = 1").select("ticker", F.concat(F.lit("B "), "name").alias("a2"), F.concat(F.lit("https://b.example/"), "ticker").alias("w2"))
    return c.join(b, "ticker", "left").select("ticker", F.coalesce("about", "a2").alias("about"), F.coalesce("website", "w2").alias("website"))


@query(W("seats", "company") + " SELECT s.ticker, s.person_id, c.name, CASE WHEN c.mcap_cr > 0 THEN floor(c.mcap_cr * 10 + 0.5) / 10 END AS mcap, s.din IN ('00000002', '00000004', '00000010') AS watched FROM seats s LEFT JOIN company c USING (ticker) WHERE s.din IS NOT NULL")
def j08_watched(spark, d):
    c = D.company(spark, d).select("ticker", "name", "mcap_cr")
    s = D.seats(spark, d).where("din is not null").join(c, "ticker", "left")
    return s.select("ticker", "person_id", "name", F.when(F.col("mcap_cr") > 0, num.js_round(F.col("mcap_cr"), 1)).alias("mcap"), F.col("din").isin("00000002", "00000004", "00000010").alias("watched"))


@query(W("holdings") + " SELECT count(*) AS n, count(DISTINCT investor) AS investors, count(DISTINCT symbol) AS symbols, " + _r("sum(value::DECIMAL(18,2))::DOUBLE", 2) + " AS value FROM holdings")
def a18_holding_stats(spark, d):
    return D.holdings(spark, d).agg(F.count("*").alias("n"), F.countDistinct("investor").alias("investors"), F.countDistinct("symbol").alias("symbols"), num.js_round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("value"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM documents GROUP BY lang")
def a22_theme_groups(spark, d):
    return D.table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT doc_id FROM documents), f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT count(*) AS total, count(f.doc_id) AS fresh, count(*) - count(f.doc_id) AS pending FROM w LEFT JOIN f USING (doc_id)")
def a31_pending(spark, d):
    w = D.table(spark, d, "documents").select("doc_id").distinct()
    f = D.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("f", F.lit(1))
    return w.join(f, "doc_id", "left").agg(F.count("*").alias("total"), F.count("f").alias("fresh"), (F.count("*") - F.count("f")).alias("pending"))


@query(W("company") + ", p AS (SELECT DISTINCT 'S' || (doc_id + 1) AS ticker FROM labels WHERE toxic = 1) SELECT ticker, ticker IN (SELECT ticker FROM p) AS first FROM company ORDER BY first DESC, ticker LIMIT 30")
def o17_priority_order(spark, d):
    p = D.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("S"), (F.col("doc_id") + 1).cast("string")).alias("ticker")).distinct().withColumn("f", F.lit(True))
    c = D.company(spark, d).select("ticker").join(p, "ticker", "left").select("ticker", F.coalesce("f", F.lit(False)).alias("first"))
    return c.orderBy(F.desc("first"), "ticker").limit(30)


@query(W("company") + " SELECT ticker FROM company ORDER BY (mcap_cr IS NULL) DESC, (price IS NULL) DESC, ticker LIMIT 25")
def o11_fill_order(spark, d):
    return D.company(spark, d).orderBy(F.desc(F.col("mcap_cr").isNull()), F.desc(F.col("price").isNull()), "ticker").limit(25).select("ticker")


@query(W("company") + ", csv AS (SELECT ticker, name FROM company WHERE k % 3 = 0), m AS (SELECT ticker, name || ' m' AS name FROM company WHERE market = 'NSE SME' OR mcap_cr BETWEEN 20 AND 200) SELECT ticker, name, 'csv' AS origin FROM csv UNION ALL SELECT ticker, name, 'master' FROM m WHERE ticker NOT IN (SELECT ticker FROM csv)")
def u04_universe(spark, d):
    """The listed file first, then companies of its kind it lacks."""
    c = D.company(spark, d)
    csv = c.where("k % 3 = 0").select("ticker", "name", F.lit("csv").alias("origin"))
    m = c.where("market = 'NSE SME' or mcap_cr between 20 and 200").select("ticker", F.concat("name", F.lit(" m")).alias("name"), F.lit("master").alias("origin"))
    return csv.unionByName(m.join(csv, "ticker", "left_anti"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(upper(trim('nse:' || p_brand || '.ns')), '^(NSE|BSE):', ''), '\.(NS|BO)$', '') AS bare, right(lpad(regexp_replace(p_brand, '\D', '', 'g'), 8, '0'), 8) AS din, CASE WHEN lower(p_type) LIKE '%independent%' THEN 'Independent' WHEN regexp_matches(lower(p_type), 'executive|managing|ceo|md|whole') THEN 'Executive' ELSE '' END AS category FROM part")
def t07_symbols(spark, d):
    p = D.table(spark, d, "part")
    return p.select("p_partkey", text.bare_symbol(F.concat(F.lit("nse:"), "p_brand", F.lit(".ns"))).alias("bare"), text.norm_din(F.col("p_brand")).alias("din"), text.infer_category(F.col("p_type")).alias("category"))


@query(W("company") + " SELECT ticker, lower(name) || ' / ' || lower(market) AS joined, regexp_replace(name, '(?i)(supplier)', '[\\1]', 'g') AS marked FROM company")
def t21_highlight(spark, d):
    c = D.company(spark, d)
    return c.select("ticker", F.array_join(F.array_distinct(F.array(F.lower("name"), F.lower("market"))), " / ").alias("joined"), F.regexp_replace("name", "(?i)(supplier)", "[$1]").alias("marked"))


@query("WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN regexp_matches(event_type, 'click|view') THEN 'watch' END AS tag FROM events) SELECT tag, count(*) AS n, max(event_id) AS last_id FROM e GROUP BY tag")
def i10_retag(spark, d):
    """Tags are recomputed as a projection when patterns change."""
    e = D.table(spark, d, "events").withColumn("tag", F.when(F.col("event_type").rlike("click|view"), "watch"))
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query(W("company") + ", n AS (SELECT ticker, CASE WHEN k % 3 = 0 THEN '500' || k ELSE name || ' new' END AS name FROM company WHERE k % 2 = 0) SELECT c.ticker, CASE WHEN n.name IS NULL OR (regexp_matches(n.name, '^[0-9]') AND length(n.name) <= 6) THEN c.name ELSE n.name END AS name FROM company c LEFT JOIN n USING (ticker)")
def i04_conditional(spark, d):
    """A new name is kept unless it is a numeric code."""
    c = D.company(spark, d)
    k = F.col("k")
    n = c.where("k % 2 = 0").select("ticker", F.when(k % 3 == 0, F.concat(F.lit("500"), k.cast("string"))).otherwise(F.concat("name", F.lit(" new"))).alias("n"))
    code = F.col("n").isNull() | (F.col("n").rlike("^[0-9]") & (F.length("n") <= 6))
    return c.join(n, "ticker", "left").select("ticker", F.when(code, F.col("name")).otherwise(F.col("n")).alias("name"))


@query(W("bars", "bench") + " SELECT symbol, count(*) AS n, max(b.date) AS last_date, max(b.date) = (SELECT max(date) FROM bench) AS current FROM bars b JOIN bench USING (date) GROUP BY symbol HAVING count(*) >= 65")
def j10_aligned(spark, d):
    bench = D.benchmark_bars(spark, d)
    top = bench.agg(F.max("date").alias("top"))
    a = I.aligned(D.bars(spark, d), bench).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))
    return a.crossJoin(F.broadcast(top)).select("symbol", "n", "last_date", (F.col("last_date") == F.col("top")).alias("current"))  # one row


@query(W("company") + " SELECT ticker, coalesce(mcap_cr <= 500, true) AS nanocap, coalesce(mcap_cr <= 6000, true) AS venture, true AS other FROM company")
def f13_cap_gate(spark, d):
    m = F.col("mcap_cr")
    return D.company(spark, d).select("ticker", *[TH.cap_passes(g, m).alias(a) for g, a in (("Nanocap Champs", "nanocap"), ("Listed Venture Capital", "venture"), ("Other", "other"))])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Director' WHEN c_custkey % 4 = 1 THEN 'Chairperson · ' || c_mktsegment ELSE c_mktsegment END AS designation FROM customer")
def t12_designation(spark, d):
    m = F.col("c_custkey") % 4
    seg = F.when(m > 0, F.col("c_mktsegment"))
    return D.table(spark, d, "customer").select("c_custkey", text.designation_of(F.when(m == 1, "Chairperson").otherwise("NA"), seg, F.lower(seg)).alias("designation"))


@query(W("company") + """ SELECT ticker, CASE k % 4 WHEN 0 THEN '"' || name || '" (stock OR shares OR NSE)' WHEN 1 THEN '("Acme" OR LONGER' || k || ') (stock OR shares OR NSE)'
 WHEN 2 THEN CASE WHEN length(ticker) >= 6 THEN '("' || ticker || '" OR ' || ticker || ') (stock OR shares OR NSE)' ELSE '"' || ticker || '" (stock OR shares OR NSE OR SME OR crore)' END
 ELSE '"solar power grid works ' || k || '" (stock OR shares OR NSE OR order OR revenue)' END AS query FROM company""")
def t24_news_query(spark, d):
    c, k, n = D.company(spark, d), F.col("k") % 4, F.col("k").cast("string")
    name = F.when(k == 0, F.col("name")).when(k == 1, F.lit('"Acme"')).when(k == 3, F.concat(F.lit('Solar Power "Grid" Works '), n))
    symbol = F.when(k == 1, F.concat(F.lit("Longer"), n, F.lit("-SM.NS"))).otherwise(F.concat("ticker", F.lit(".NS")))
    return c.select("ticker", text.news_query(name, symbol).alias("query"))


@query("SELECT DISTINCT p_type, CASE WHEN p_type LIKE '%TIN%' THEN 'Executive' WHEN p_type LIKE '%BRASS%' THEN 'Independent' ELSE '' END AS category FROM part")
def t11_written_category(spark, d):
    p = F.col("p_type")
    said = F.when(p.contains("TIN"), F.concat(F.lit("CTO "), p)).when(p.contains("BRASS"), F.concat(F.lit("independent managing "), p)).otherwise(F.lit("MD in charge"))
    return D.table(spark, d, "part").select("p_type", text.infer_category(said, True).alias("category")).distinct()


@query("SELECT o_orderkey, o_custkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey)::DOUBLE AS invested FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def s18_open_positions(spark, d):
    o = D.table(spark, d, "orders").where("o_orderstatus = 'O'")
    w = Window.partitionBy("o_custkey")
    x = o.select("o_orderkey", "o_custkey", "o_orderdate", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("invested"))
    return x.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).drop("o_orderdate")


@query("WITH n AS (SELECT lower(trim(c_mktsegment)) AS name, c_nationkey % 3 AS scope, max(c_custkey) AS id FROM customer GROUP BY 1, 2) SELECT name, scope, id FROM n")
def i15_saved_search(spark, d):
    """Saved searches by name in any case and scope, the last written kept."""
    c = D.table(spark, d, "customer")
    return c.groupBy(F.lower(F.trim("c_mktsegment")).alias("name"), (F.col("c_nationkey") % 3).alias("scope")).agg(F.max("c_custkey").alias("id"))
