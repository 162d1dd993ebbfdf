"""Queries on the company master, screener and board graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from equiloom.functions import num, text
from equiloom.operators import company as C
from equiloom.operators import governance as G
from equiloom.plans.base import query
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W

R1 = "floor({0} * 10 + 0.5) / 10"
TIER = "CASE WHEN mcap_cr IS NULL THEN 'NC' WHEN mcap_cr < 100 THEN 'TI' WHEN mcap_cr < 500 THEN 'MIC' WHEN mcap_cr < 5000 THEN 'SC' WHEN mcap_cr < 20000 THEN 'MC' ELSE 'LC' END"


@query("SELECT DISTINCT upper(trim(ticker)) AS ticker, first(name ORDER BY name, market) OVER (PARTITION BY upper(trim(ticker))) AS name FROM ("
       + W("company") + " SELECT ticker, name, market FROM company UNION ALL SELECT lower(ticker), name || ' dup', market FROM company WHERE k % 2 = 0)")
def s01_scan_dedup(spark, d):
    c = D.company(spark, d)
    both = c.select("ticker", "name", "market").unionByName(c.where("k % 2 = 0").select(F.lower("ticker").alias("ticker"), F.concat("name", F.lit(" dup")).alias("name"), "market"))
    return C.dedup_master(both).select("ticker", "name")


_ENRICH = ("company", )
_ENRICHED = """, cls AS (SELECT ticker, market, CASE WHEN k % 2 = 0 THEN sector || ' x' END AS sector, CASE WHEN k % 4 = 0 THEN ' ' ELSE sub_sector END AS sub_sector FROM company WHERE k % 3 = 0
 UNION ALL SELECT ticker, 'OTHER', 'fallback', NULL FROM company WHERE k % 9 = 1),
e AS (SELECT c.ticker, c.name, c.market, coalesce(nullif(trim(a.sector), ''), nullif(trim(b.sector), ''), nullif(trim(c.sector), '')) AS sector,
 coalesce(nullif(trim(a.sub_sector), ''), nullif(trim(b.sub_sector), ''), nullif(trim(c.sub_sector), '')) AS sub_sector, c.mcap_cr, c.price, c.website, c.about
 FROM company c LEFT JOIN cls a ON a.ticker = c.ticker AND a.market = c.market
 LEFT JOIN (SELECT ticker, first(sector ORDER BY market) AS sector, first(sub_sector ORDER BY market) AS sub_sector FROM cls GROUP BY ticker) b ON b.ticker = c.ticker)"""


def _enriched(spark, d):
    c = D.company(spark, d)
    sub = F.when(F.col("k") % 4 == 0, " ").otherwise(F.col("sub_sector"))
    cls = c.where("k % 3 = 0").select("ticker", "market", F.when(F.col("k") % 2 == 0, F.concat("sector", F.lit(" x"))).alias("sector"), sub.alias("sub_sector")).unionByName(
        c.where("k % 9 = 1").select("ticker", F.lit("OTHER").alias("market"), F.lit("fallback").alias("sector"), F.lit(None).cast("string").alias("sub_sector"))
    )
    return C.enrich(c.drop("mcap_cr", "price"), cls, c.select("ticker", "mcap_cr", "price"))


@query(W("company") + _ENRICHED + " SELECT * FROM e")
def p01_company_enriched(spark, d):
    return _enriched(spark, d)


@query(W("company") + _ENRICHED + f", n AS (SELECT *, {TIER} AS t FROM e) SELECT ticker, t AS tier, CASE WHEN mcap_cr > 0 THEN t END AS code, CASE WHEN t = 'LC' THEN 'large' WHEN t = 'MC' THEN 'mid' ELSE 'small' END AS bucket FROM n")
def p08_cap_tiers(spark, d):
    tier = C.board_tier()
    return _enriched(spark, d).select("ticker", tier.alias("tier"), num.cap_code(F.col("mcap_cr")).alias("code"), num.cap_bucket(tier).alias("bucket"))


@query(W("company") + " SELECT ticker, concat_ws(chr(32) || chr(10) || chr(32), nullif(trim(name), ''), nullif(trim(ticker), ''), nullif(trim(about), ''), nullif(trim(sector), ''), nullif(trim(sub_sector), '')) AS search_text FROM company")
def p02_search_text(spark, d):
    return D.company(spark, d).select("ticker", C.search_text("name", "ticker", "about", "sector", "sub_sector").alias("search_text"))


@query(W("company") + r""" , b AS (SELECT ticker, CASE WHEN k % 2 = 0 THEN replace(about, 'makes', 'Manufactures') ELSE about END AS about, CASE WHEN k % 3 = 0 THEN (500000 + k)::VARCHAR ELSE name END AS name FROM company)
SELECT ticker, coalesce(CASE WHEN NOT regexp_full_match(name, '\d{1,6}') THEN name END, nullif(regexp_extract(about, '(?i)^(.{3,120}?)\s+(?:designs|engages|operates|provides|manufactures|develops|offers|is an|is a|specializes|focuses|distributes|produces|supplies|markets|trades in)\b', 1), ''), name, ticker) AS name FROM b""")
def p03_resolve_name(spark, d):
    c = D.company(spark, d).withColumn("name", F.when(F.col("k") % 3 == 0, (F.col("k") + 500000).cast("string")).otherwise(F.col("name")))
    c = c.withColumn("about", F.when(F.col("k") % 2 == 0, F.replace("about", F.lit("makes"), F.lit("Manufactures"))).otherwise(F.col("about")))
    return c.select("ticker", C.resolve_name().alias("name"))


@query(W("company") + " SELECT market, count(*) AS n FROM company GROUP BY market")
def a01_market_counts(spark, d):
    return D.company(spark, d).groupBy("market").agg(F.count("*").alias("n"))


@query(W("company") + " SELECT DISTINCT sector FROM company WHERE sector IS NOT NULL")
def a02_sectors(spark, d):
    return D.company(spark, d).select("sector").where("sector is not null").distinct()


_GAP = {"price": "price IS NULL", "mcap": "mcap_cr IS NULL", "sector": "coalesce(trim(sector), '') = ''", "sub_sector": "coalesce(trim(sub_sector), '') = ''", "about": "coalesce(trim(about), '') = ''", "web": "coalesce(trim(website), '') = ''"}
_ANY = " OR ".join(f"({v})" for v in _GAP.values())
_KINDS = {"any": _ANY, **_GAP, "sector": f"({_GAP['sector']}) OR ({_GAP['sub_sector']})", "metrics": "price IS NULL OR mcap_cr IS NULL"}


@query(W("company") + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS missing_{k}" for k, v in _KINDS.items()) + " FROM company")
def a04_gap_summary(spark, d):
    return C.gap_summary(D.company(spark, d))


@query(W("company") + f" SELECT ticker, name FROM company WHERE {_KINDS['sector']}")
def f04_gap_filter(spark, d):
    return C.gap_flags(D.company(spark, d)).where(C.gap_filter("sector")).select("ticker", "name")


_SIG = ", sig AS (SELECT *, k % 3 = 0 AS has_bb, k % 4 = 0 AS has_tq, k % 5 = 1 AS has_ema FROM company)"


def _signals(spark, d):
    k = F.col("k")
    return D.company(spark, d).select("*", (k % 3 == 0).alias("has_bb"), (k % 4 == 0).alias("has_tq"), (k % 5 == 1).alias("has_ema"))


@query(W("company") + _SIG + " SELECT ticker FROM sig WHERE (has_bb AND has_tq AND has_ema) OR NOT (SELECT coalesce(bool_or(has_bb AND has_tq AND has_ema), false) FROM sig)")
def f15_prefer(spark, d):
    s = _signals(spark, d).withColumn("f", C.signal_filter(True, True, True, True))
    return C.prefer(s, "f").select("ticker")


@query(W("company") + " SELECT ticker, name FROM company WHERE starts_with(lower(ticker), 's1') OR regexp_matches(lower(about), '(^|[^a-z0-9_-])china([^a-z0-9_]|$)')")
def f05_keyword_search(spark, d):
    c = D.company(spark, d).withColumn("search_text", F.coalesce("about", F.lit("")))
    return c.where(C.keyword_search("s1|china")).select("ticker", "name")


@query(W("company") + ", w AS (SELECT DISTINCT 'S' || doc_id AS ticker FROM labels WHERE quality = 1), x AS (SELECT DISTINCT 'S' || doc_id AS ticker FROM labels WHERE toxic = 1) SELECT c.ticker, w.ticker IS NOT NULL AS on_hold, x.ticker IS NOT NULL AS excluded FROM company c LEFT JOIN w USING (ticker) LEFT JOIN x ON x.ticker = c.ticker")
def j04_watch_flags(spark, d):
    lab = D.table(spark, d, "labels")
    of = lambda c, a: lab.where(f"{c} = 1").select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("ticker")).distinct().withColumn(a, F.lit(True))
    c = D.company(spark, d).select("ticker").join(of("quality", "h"), "ticker", "left").join(of("toxic", "x"), "ticker", "left")
    return c.select("ticker", F.col("h").isNotNull().alias("on_hold"), F.col("x").isNotNull().alias("excluded"))


@query(W("company") + ", l AS (SELECT DISTINCT 'S' || doc_id AS ticker FROM labels) SELECT ticker, name, market FROM company UNION ALL SELECT ticker, NULL, NULL FROM l WHERE ticker NOT IN (SELECT ticker FROM company)")
def j16_stub_append(spark, d):
    l = D.table(spark, d, "labels").select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("ticker"))
    return C.stubs(l, D.company(spark, d).select("ticker", "name", "market"))


@query("SELECT DISTINCT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def u02_list_intersect(spark, d):
    l = D.table(spark, d, "labels")
    return l.where("quality = 1").select("doc_id").intersect(l.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def u03_list_union(spark, d):
    l = D.table(spark, d, "labels")
    return l.where("quality = 1").select("doc_id").union(l.where("toxic = 1").select("doc_id")).distinct()


@query("SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def u10_excluded(spark, d):
    l = D.table(spark, d, "labels")
    return l.where("quality = 1").select("doc_id").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(W("company") + """, f AS (SELECT *, '"' || replace(name, '"', '""') || '"' AS q FROM company)
SELECT ticker || ',' || CASE WHEN regexp_matches(name || ',x', '[",\n\r]') THEN '"' || replace(name || ',x', '"', '""') || '"' ELSE name END || ',' || coalesce(sub_sector, '') AS line FROM f""")
def k01_gap_export(spark, d):
    e = text.csv_escape
    return D.company(spark, d).select(F.concat_ws(",", e(F.col("ticker")), e(F.concat("name", F.lit(",x"))), e(F.col("sub_sector"))).alias("line"))


@query(W("company") + " SELECT ticker, 'https://finance.example/quote/' || upper(ticker) || CASE WHEN market LIKE 'BSE%' THEN '.BO' ELSE '.NS' END AS quote_link, 'https://search.example/?q=' || replace(name, '#', '%23') AS search_link FROM company")
def p06_links(spark, d):
    c = D.company(spark, d)
    return c.select("ticker", F.concat(F.lit("https://finance.example/quote/"), text.yahoo_symbol(F.col("ticker"), F.col("market"))).alias("quote_link"), F.concat(F.lit("https://search.example/?q="), F.url_encode("name")).alias("search_link"))


# --- boards ---

_ROWS = W("company", "seats") + """, rows_ AS (SELECT s.*, c.name AS company, c.market, c.sector, c.mcap_cr FROM seats s JOIN company c USING (ticker)),
many AS (SELECT person_id FROM seats GROUP BY person_id HAVING count(DISTINCT ticker) >= 2)"""
_WEIGHT = """(CASE WHEN mcap_cr > 0 THEN log10(1 + mcap_cr) ELSE 0.5::DOUBLE END) * (CASE WHEN din IS NOT NULL THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END)
 * (CASE WHEN lower(designation) LIKE '%chair%' THEN 1.25::DOUBLE WHEN lower(designation) LIKE '%managing%' OR lower(designation) LIKE '%whole-time%' OR lower(designation) LIKE '%whole time%' OR lower(designation) LIKE '%ceo%' OR lower(designation) LIKE '%md%' THEN 1.2::DOUBLE
 WHEN lower(designation) LIKE '%independent%' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)"""
_SCORED = _ROWS + f""", g AS (SELECT person_id, din, director, count(DISTINCT ticker) AS board_count,
 sum((floor({_WEIGHT} * 1000000 + 0.5) / 1000000)::DECIMAL(38,6))::DOUBLE AS raw,
 count(*) FILTER (WHERE mcap_cr >= 5000) AS big_n, count(*) FILTER (WHERE mcap_cr > 0 AND mcap_cr < 5000) AS small_n, count(*) FILTER (WHERE mcap_cr > 0 AND mcap_cr < 500) AS tiny_n,
 count(*) FILTER (WHERE mcap_cr > 0 AND mcap_cr < 100) AS ti_n, count(*) FILTER (WHERE mcap_cr >= 20000) AS lc_n, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers
 FROM rows_ WHERE person_id IN (SELECT person_id FROM many) GROUP BY ALL),
scored AS (SELECT person_id, din, director, board_count, tickers, big_n > 0 AND small_n > 0 AS bridge, big_n > 0 AND tiny_n > 0 AS tiny_bridge, big_n > 0 AND ti_n > 0 AS ti_bridge,
 lc_n >= 2 AS multi_lc, lc_n, din IS NULL AND board_count >= 5 AS name_collision,
 floor(greatest(0, least(100, 70 * (1 - exp(-raw / 6)) + (CASE WHEN big_n > 0 AND small_n > 0 THEN 15 WHEN lc_n >= 2 THEN 12 WHEN big_n > 0 THEN 8 ELSE 0 END) - 4 * greatest(0, board_count - 5))) * 10 + 0.5) / 10 AS score FROM g)"""


def _board(spark, d):
    return G.seat_rows(G.multi_board(D.seats(spark, d)), D.company(spark, d))


@query(_SCORED + " SELECT * FROM scored")
def x01_director_score(spark, d):
    return G.director_scores(_board(spark, d)).orderBy(F.desc("score"), F.desc("board_count"), "director", "person_id")


@query(_SCORED + """ SELECT count(*) AS directors, (SELECT count(DISTINCT ticker) FROM rows_ WHERE person_id IN (SELECT person_id FROM many)) AS companies,
 count(*) FILTER (WHERE bridge) AS bridges, count(*) FILTER (WHERE tiny_bridge) AS tiny_bridges, count(*) FILTER (WHERE multi_lc) AS multi_lc, count(*) FILTER (WHERE din IS NULL) AS by_name, max(board_count) AS most_boards FROM scored""")
def a09_gov_stats(spark, d):
    rows = _board(spark, d)
    n = lambda c, a: F.count_if(c).alias(a)
    stats = G.director_scores(rows).agg(F.count("*").alias("directors"), n(F.col("bridge"), "bridges"), n(F.col("tiny_bridge"), "tiny_bridges"), n(F.col("multi_lc"), "multi_lc"), n(F.col("din").isNull(), "by_name"), F.max("board_count").alias("most_boards"))
    return stats.crossJoin(rows.agg(F.countDistinct("ticker").alias("companies")))  # one row each


@query(_ROWS + " SELECT ticker, first(company) AS company, count(DISTINCT person_id) AS n, string_agg(director, '; ' ORDER BY director, person_id) AS directors FROM rows_ WHERE person_id IN (SELECT person_id FROM many) GROUP BY ticker")
def a10_company_view(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("director", "person_id"))), lambda x: x["director"])
    return _board(spark, d).groupBy("ticker").agg(F.first("company").alias("company"), F.countDistinct("person_id").alias("n"), F.array_join(names, "; ").alias("directors"))


_CAT = "CASE WHEN lower(designation) LIKE '%independent%' THEN 'Independent' WHEN lower(designation) LIKE '%managing%' OR lower(designation) LIKE '%whole%' OR lower(designation) LIKE '%executive%' OR lower(designation) LIKE '%ceo%' OR lower(designation) LIKE '%md%' THEN 'Executive' ELSE '' END"


@query(_ROWS + f", v AS (SELECT designation || ' · ' || {_CAT} AS role, person_id, director FROM rows_), n AS (SELECT role, count(*) AS n FROM v GROUP BY role), p AS (SELECT role, director, person_id, row_number() OVER (PARTITION BY role ORDER BY director, person_id) AS i FROM (SELECT DISTINCT role, director, person_id FROM v)) SELECT n.role, n.n, string_agg(p.director, '; ' ORDER BY i) AS first_directors FROM n JOIN p ON n.role = p.role AND i <= 8 GROUP BY n.role, n.n")
def a11_role_view(spark, d):
    rows = G.seat_rows(D.seats(spark, d), D.company(spark, d))
    v = rows.select(F.concat("designation", F.lit(" · "), text.infer_category(F.col("designation"))).alias("role"), "person_id", "director")
    top = v.distinct().withColumn("i", F.row_number().over(Window.partitionBy("role").orderBy("director", "person_id"))).where("i <= 8")
    first = top.groupBy("role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "director"))), lambda x: x["director"]), "; ").alias("first_directors"))
    return v.groupBy("role").agg(F.count("*").alias("n")).join(first, "role")


@query(_ROWS + " SELECT person_id, director, ticker, designation FROM rows_ WHERE person_id IN (SELECT person_id FROM rows_ WHERE lower(director) LIKE '%12%' OR lower(company) LIKE '%12%' OR lower(ticker) LIKE '%12%' OR lower(designation) LIKE '%12%')")
def s09_search_seats(spark, d):
    rows = G.seat_rows(D.seats(spark, d), D.company(spark, d))
    hit = rows.where(F.lower("director").contains("12") | F.lower("company").contains("12") | F.lower("ticker").contains("12") | F.lower("designation").contains("12"))
    return rows.join(hit.select("person_id").distinct(), "person_id", "left_semi").select("person_id", "director", "ticker", "designation")


@query(_SCORED + " SELECT person_id, score, board_count FROM scored WHERE bridge AND din IS NOT NULL AND board_count BETWEEN 2 AND 8 AND person_id IN (SELECT person_id FROM rows_ WHERE designation LIKE '%Independent%')")
def f18_gov_filter(spark, d):
    rows = _board(spark, d)
    some = rows.where(F.col("designation").contains("Independent")).select("person_id").distinct()
    s = G.director_scores(rows).where("bridge and din is not null and board_count between 2 and 8")
    return s.join(some, "person_id", "left_semi").select("person_id", "score", "board_count")


_EVENTS = W("company", "seats", "old_seats") + """, ok AS (SELECT o.ticker FROM (SELECT ticker, count(din) AS a FROM old_seats GROUP BY 1) o LEFT JOIN (SELECT ticker, count(din) AS b FROM seats GROUP BY 1) n USING (ticker) WHERE NOT (a > 0 AND coalesce(b, 0) = 0)),
ev AS (SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.person_id, n.person_id) AS person_id,
 CASE WHEN o.ticker IS NULL THEN 'joined' WHEN n.ticker IS NULL THEN 'resigned' WHEN lower(trim(o.designation)) <> lower(trim(n.designation)) THEN 'role_changed' END AS event_type,
 o.designation AS old_designation, n.designation AS new_designation FROM old_seats o FULL JOIN (SELECT * FROM seats WHERE ticker <> 'S7') n ON o.ticker = n.ticker AND o.person_id = n.person_id),
events_ AS (SELECT * FROM ev WHERE event_type IS NOT NULL AND ticker IN (SELECT ticker FROM ok))"""


def _events(spark, d):
    new = D.seats(spark, d)
    old = D.seats(spark, d, D.CUT)
    return G.seat_events(old, new.where("ticker <> 'S7'"), keep_dins=False)


@query(_EVENTS.replace(" AND ticker IN (SELECT ticker FROM ok)", " AND ticker IN (SELECT ticker FROM old_seats)") + " SELECT * FROM events_")
def j13_seat_events(spark, d):
    return _events(spark, d)


@query(_EVENTS.replace(" AND ticker IN (SELECT ticker FROM ok)", " AND ticker IN (SELECT ticker FROM old_seats)") + " SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'joined') AS joined, count(*) FILTER (WHERE event_type = 'resigned') AS resigned, count(*) FILTER (WHERE event_type = 'role_changed') AS role_changed, count(DISTINCT ticker) AS companies, count(DISTINCT person_id) AS people FROM events_")
def a12_event_summary(spark, d):
    return G.event_summary(_events(spark, d))


@query(W("seats", "old_seats") + " SELECT (SELECT count(*) FROM (SELECT DISTINCT person_id FROM seats EXCEPT SELECT person_id FROM old_seats)) AS new_people, (SELECT count(*) FROM (SELECT DISTINCT din FROM seats WHERE din IS NOT NULL EXCEPT SELECT din FROM old_seats)) AS new_dins, (SELECT count(*) FROM (SELECT ticker, person_id FROM seats EXCEPT SELECT ticker, person_id FROM old_seats)) AS new_seats")
def j15_identity_diff(spark, d):
    new, old = D.seats(spark, d), D.seats(spark, d, D.CUT)
    n = lambda keys, a: new.select(*keys).dropna().distinct().join(old.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias(a))
    return n(["person_id"], "new_people").crossJoin(n(["din"], "new_dins")).crossJoin(n(["ticker", "person_id"], "new_seats"))  # one row each


@query(_ROWS + " SELECT DISTINCT ticker FROM seats WHERE din IS NOT NULL")
def f38_din_boards(spark, d):
    return D.seats(spark, d).where("din is not null").select("ticker").distinct()


@query(_SCORED + " SELECT director || ',' || score || ',' || (SELECT string_agg(ticker || ':' || designation, ' | ' ORDER BY ticker || ':' || designation) FROM rows_ r WHERE r.person_id = s.person_id) AS line FROM scored s")
def k02_director_csv(spark, d):
    rows = _board(spark, d)
    cells = rows.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "ticker", "designation"))), " | ").alias("cell"))
    return G.director_scores(rows).join(cells, "person_id").select(F.concat_ws(",", "director", F.col("score").cast("string"), "cell").alias("line"))
