"""Screener requests over companies, lists, signals and quarters."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.operators import fundamentals as Q
from equiloom.operators import screener as S
from equiloom.plans.base import query
from equiloom.plans.company import _GAP
from equiloom.plans.market import _VAL, _YOY
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W


def _lists(spark, d):
    lab, c = D.table(spark, d, "labels"), D.company(spark, d)
    own = lambda cond, name, mark="": c.where(cond).select(F.concat(F.lit("X"), F.col("k").cast("string")).alias("ticker") if mark else F.col("ticker"), F.lit(name).alias("list"))
    of = lambda cond, name: lab.where(cond).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("ticker"), F.lit(name).alias("list"))
    parts = [of("quality = 1", "hold"), of("toxic = 1", "distress"), own("k % 5 = 2", "edge"), own("k % 6 = 0", "note"), own("k % 4 = 0", "fund_a"), own("k % 3 = 0", "fund_b"), own("k % 50 = 0", "fund_a", "X"), own("k % 25 = 0", "fund_b", "X")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _universe(spark, d):
    c, q, k = D.company(spark, d), D.quarters(spark, d), F.col("k")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (k % n).cast("int"))
    kinds = F.array(*[F.when(cond, F.struct(F.lit(name).alias("kind"), day(n).alias("signal_date"), F.col("price").alias("value"))) for name, cond, n in (("bb", k % 3 == 0, 5), ("tq", k % 4 == 0, 7), ("ema", k % 5 == 1, 9))])
    signals = c.select("ticker", F.explode(F.array_compact(kinds)).alias("s")).select("ticker", "s.*")
    quarter = Q.figures(q, c).where(F.pmod(F.substring("ticker", 2, 9).cast("long"), F.lit(10)) != 9).select("ticker", "forward_pe", "eps_yoy", "sales_yoy")
    live = c.where(k % 8 == 0).select("ticker", F.lit(7.5).alias("price"), F.col("mcap_cr"))
    return S.universe(c.withColumn("search_text", F.coalesce("about", F.lit(""))), signals, _lists(spark, d), quarter, live)


_ON = lambda k: f"coalesce(bool_or(list = '{k}'), false) AS has_{k}"
_SIGS = {"bb": ("k % 3 = 0", 5), "tq": ("k % 4 = 0", 7), "ema": ("k % 5 = 1", 9)}
_UNIVERSE = (
    W("company", "quarters") + _YOY + _VAL + f""",
l AS (SELECT 'S' || doc_id AS ticker, 'hold' AS list FROM labels WHERE quality = 1 UNION ALL SELECT 'S' || doc_id, 'distress' FROM labels WHERE toxic = 1
  UNION ALL SELECT ticker, 'edge' FROM company WHERE k % 5 = 2 UNION ALL SELECT ticker, 'note' FROM company WHERE k % 6 = 0 UNION ALL SELECT ticker, 'fund_a' FROM company WHERE k % 4 = 0
  UNION ALL SELECT ticker, 'fund_b' FROM company WHERE k % 3 = 0 UNION ALL SELECT 'X' || k, 'fund_a' FROM company WHERE k % 50 = 0 UNION ALL SELECT 'X' || k, 'fund_b' FROM company WHERE k % 25 = 0),
h AS (SELECT ticker, {", ".join(map(_ON, S.LISTS))} FROM l GROUP BY ticker),
fig AS (SELECT ticker, forward_pe, eps_yoy, sales_yoy, coalesce(forward_pe > 0 AND forward_pe <= 20 AND eps_yoy > 0 AND sales_yoy > 0, false) AS green FROM val JOIN yoy USING (ticker) WHERE substr(ticker, 2)::BIGINT % 10 <> 9),
u AS (SELECT coalesce(c.ticker, h.ticker) AS ticker, coalesce(c.name, h.ticker) AS name, c.market, c.sector, c.sub_sector, c.mcap_cr, c.price, c.website, c.about, c.k, c.ticker IS NULL AS stub, coalesce(c.about, CASE WHEN c.ticker IS NULL THEN lower(h.ticker || ' ' || h.ticker) END, '') AS search_text,
  {", ".join(f"coalesce(h.has_{k}, false) AS has_{k}" for k in S.LISTS)}, {", ".join(f"coalesce({c}, false) AS has_{k}, CASE WHEN {c} THEN DATE '2024-01-01' + (k % {n})::INT END AS {k}_date" for k, (c, n) in _SIGS.items())},
  coalesce(c.market = 'NSE SME', false) AS sme, coalesce(f.green, false) AS green, f.ticker IS NULL AS pending, f.forward_pe, f.eps_yoy, f.sales_yoy, CASE WHEN k % 8 = 0 THEN 7.5 ELSE c.price END AS shown_price
  FROM company c FULL JOIN h USING (ticker) LEFT JOIN fig f ON f.ticker = c.ticker WHERE c.ticker IS NOT NULL OR h.has_fund_a OR h.has_fund_b)"""
)


def _page_sql(hit: str, order: str, number: int, size: int) -> str:
    """The rows of a page, clamped to the last one."""
    return f""", hit AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place, count(*) OVER () AS total FROM u WHERE {hit}),
page AS (SELECT *, greatest(1, ceil(total / {size}))::INT AS pages, least({number}, greatest(1, ceil(total / {size})))::INT AS page FROM hit),
shown AS (SELECT * FROM page WHERE place > (page - 1) * {size} AND place <= page * {size})"""


_COLUMNS = ("place", "total", "pages", "page", "ticker", "name", "price", "has_hold", "has_bb", "bb_date", "forward_pe", "gap_price", "gap_sub_sector", "dots_pending")
_SHOWN = " SELECT place, total, pages, page, ticker, name, shown_price AS price, has_hold, has_bb, bb_date, forward_pe, coalesce(shown_price IS NULL, false) AS gap_price, coalesce(trim(sub_sector), '') = '' AS gap_sub_sector, pending AS dots_pending FROM shown"


def _rows(response):
    r = F.col("r")
    return response.select("total", "pages", "page", F.explode("rows").alias("r")).select(
        r["place"].alias("place"), "total", "pages", "page", r["ticker"].alias("ticker"), r["name"].alias("name"), r["price"].alias("price"), r["has_hold"].alias("has_hold"), r["has_bb"].alias("has_bb"),
        r["bb"]["signal_date"].alias("bb_date"), r["forward_pe"].alias("forward_pe"), r["missing"]["price"].alias("gap_price"), r["missing"]["sub_sector"].alias("gap_sub_sector"), r["missing"]["dots_pending"].alias("dots_pending"),
    )


@query(_UNIVERSE + _page_sql("NOT stub AND market = 'NSE' AND (has_bb OR has_tq)", "coalesce(mcap_cr, 0) DESC, ticker", 1, 20) + _SHOWN)
def j03_screener_rows(spark, d):
    r = S.Request(market="NSE", signals=frozenset(["bb", "tq"]), sort="mcap_cr", descending=True, size=20)
    return _rows(S.respond(_universe(spark, d), r))


@query(_UNIVERSE + _page_sql("NOT stub AND has_hold", "name, ticker", 99, 10) + _SHOWN)
def o01_screener_page(spark, d):
    return _rows(S.respond(_universe(spark, d), S.Request(market="NSE", chips=frozenset(["hold"]), sort="name", page=99, size=10)))


@query(_UNIVERSE + _page_sql("has_fund_a AND has_fund_b AND (has_note OR NOT has_note)", "coalesce(sector, ''), ticker", 1, 200) + _SHOWN)
def f16_chips(spark, d):
    return _rows(S.respond(_universe(spark, d), S.Request(market="NSE SME", chips=frozenset(["fund_a", "fund_b", "sme"]), size=200)))


_NO_SECTOR = "(" + _GAP["sector"] + " OR " + _GAP["sub_sector"] + ")"


@query(_UNIVERSE + _page_sql(f"((NOT stub AND market = 'NSE') OR has_fund_a OR has_fund_b) AND {_NO_SECTOR}", "coalesce(price, 0) DESC, ticker", 2, 10) + _SHOWN)
def p12_missing_page(spark, d):
    return _rows(S.respond(_universe(spark, d), S.Request(market="NSE", missing="sector", sort="price", descending=True, page=2, size=10)))


_THEME = {"east": {"pattern": "goods in+NATION_4|NATION_7", "group": "Other"}}
_EAST = "(regexp_matches(search_text, '(?i)\\bgoods in\\b') AND regexp_matches(search_text, '\\bNATION_4\\b') OR regexp_matches(search_text, '\\bNATION_7\\b') OR regexp_matches(search_text, '(?i)\\bnation_1\\b'))"
_BASE_EAST = f"NOT stub AND market IN ('NSE', 'NSE SME') AND {_EAST}"


@query(_UNIVERSE + _page_sql(f"{_BASE_EAST} AND ((has_bb OR has_tq OR has_ema) OR NOT (SELECT bool_or(has_bb OR has_tq OR has_ema) FROM u WHERE {_BASE_EAST}))", "CASE WHEN has_hold THEN 0 ELSE 1 END, coalesce(sector, ''), ticker", 1, 50) + _SHOWN)
def j23_theme_page(spark, d):
    return _rows(S.respond(_universe(spark, d), S.Request(market="NSE", scan=True, prefer=True, themes=_THEME, custom="nation_1", size=50)))


_FACETS = {"bb": "has_bb", "tq": "has_tq", "ema": "has_ema", "hold": "has_hold", "edge": "has_edge", "sme": "sme", "note": "has_note", "distress": "has_distress", "green": "green", "dots_pending": "pending"}
_GAPS = {"any": " OR ".join(f"({v})" for v in _GAP.values()), **_GAP, "sector": _NO_SECTOR, "metrics": "price IS NULL OR mcap_cr IS NULL"}


def _counts_sql(pool: str, hit: str) -> str:
    facets = ", ".join(f"count(*) FILTER (WHERE {pool} AND {c}) AS {k}" for k, c in _FACETS.items())
    return f" SELECT {facets}, count(*) FILTER (WHERE has_fund_a) AS fund_a, count(*) FILTER (WHERE has_fund_b) AS fund_b, " + ", ".join(f"count(*) FILTER (WHERE {hit} AND ({c})) AS gap_{k}" for k, c in _GAPS.items()) + " FROM u"


@query(_UNIVERSE + _counts_sql("NOT stub AND market IN ('NSE', 'NSE SME') AND sector = 'ASIA'", "NOT stub AND market = 'NSE' AND sector = 'ASIA' AND has_bb"))
def a03_facets(spark, d):
    r = S.respond(_universe(spark, d), S.Request(market="NSE", sector="ASIA", signals=frozenset(["bb"])))
    return r.select("signals.*", *[F.col("gaps")[k].alias(f"gap_{k}") for k in S.GAP_KINDS])


@query(_UNIVERSE + _page_sql("NOT stub AND market = 'NSE' AND has_ema AND has_tq", "coalesce(sector, ''), ticker", 1, 10) + " SELECT '{\"total\":' || coalesce(any_value(total), 0) || ',\"page\":' || coalesce(any_value(page), 1) || ',\"rows\":[' || coalesce(string_agg('{\"ticker\":\"' || ticker || '\",\"name\":\"' || name || '\",\"has_hold\":' || has_hold || '}', ',' ORDER BY place), '') || ']}' AS json FROM shown")
def k04_page_json(spark, d):
    r = S.respond(_universe(spark, d), S.Request(market="NSE", signals=frozenset(["ema", "tq"]), every=True, size=10))
    return S.page_json(r.select("total", "page", F.transform("rows", lambda x: F.struct(x["ticker"].alias("ticker"), x["name"].alias("name"), x["has_hold"].alias("has_hold"))).alias("rows")))


@query(_UNIVERSE + " SELECT ticker, name FROM u WHERE has_fund_a")
def f02_scan_list(spark, d):
    r = S.Request(market="fund_a")
    return _universe(spark, d).where(S._market(r)).select("ticker", "name")


@query(_UNIVERSE + " SELECT ticker, name FROM u WHERE has_hold AND NOT stub")
def f02_held_list(spark, d):
    return _universe(spark, d).where(S._market(S.Request(market="hold"))).select("ticker", "name")
