"""Requests on the map of directors."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.functions import num
from equiloom.operators import gov_map as M
from equiloom.plans.base import query
from equiloom.plans.company import _SCORED
from equiloom.sources import domain as D

_CODE = "CASE WHEN mcap_cr > 0 THEN CASE " + " ".join(f"WHEN mcap_cr < {b} THEN '{c}'" for b, c in num.CAP_BANDS) + " ELSE 'LC' END END"


def _companies(spark, d):
    c, k = D.company(spark, d), F.col("k")
    flag = {"bb": k % 3 == 0, "tq": k % 4 == 0, "hold": k % 5 == 0, "edge": k % 6 == 0, "fund_a": k % 7 == 0, "fund_b": F.lit(False)}
    return c.select("ticker", "name", "market", "sector", "mcap_cr", num.cap_code(F.col("mcap_cr")).alias("cap_code"), F.coalesce("about", F.lit("")).alias("text"), *[v.alias(f"has_{n}") for n, v in flag.items()])


def _rows(spark, d, r):
    rows = M.narrowed(M.directors(D.seats(spark, d), _companies(spark, d), r), r)
    return rows.select("person_id", "score", "board_count", "tickers", "theme_matched")


def _map_sql(seats: str, seat: str, person: str = "true", have: str = "true", theme: str = "false", order: str = "lower(name), ticker", many: str = "person_id IN (SELECT person_id FROM many)") -> str:
    """Seats s of the scored directors with what the company has; those that
    stay meet `seat`, their director `person` and, over all seats, `have`."""
    base = _SCORED.replace("FROM rows_ WHERE person_id IN (SELECT person_id FROM many) GROUP BY ALL", f"FROM rows_ WHERE {many} GROUP BY ALL")
    return base + f""", c AS (SELECT r.person_id, r.director, r.din, r.ticker, company AS name, r.designation, r.market, {_CODE.replace('mcap_cr', 'r.mcap_cr')} AS cap_code, k, coalesce(about, '') AS txt FROM rows_ r JOIN (SELECT ticker, k, about FROM company) USING (ticker) WHERE {many}),
s AS (SELECT c.*, {theme} AS theme_hit, scored.score, scored.bridge, scored.din IS NOT NULL AS din_backed FROM c JOIN scored USING (person_id)),
p AS (SELECT *, bool_or(market = 'NSE SME') OVER w AND bool_or(market <> 'NSE SME') OVER w AS sme_cross, count(*) FILTER (WHERE theme_hit) OVER w AS theme_matched, {seats} AS extra FROM s WINDOW w AS (PARTITION BY person_id)),
q AS (SELECT *, bool_or({have}) OVER (PARTITION BY person_id) AS has_some FROM p WHERE {seat} AND {person})
SELECT person_id, any_value(score) AS score, count(DISTINCT ticker) AS board_count, string_agg(ticker, ', ' ORDER BY {order}) AS tickers, any_value(theme_matched)::INT AS theme_matched FROM q WHERE has_some GROUP BY person_id"""


_EAST = r"regexp_matches(txt, '(?i)\bgoods in\b') AND regexp_matches(txt, '(?i)\bnation_1[0-9]\b')"
_PATTERN = "|".join(f"goods in+nation_1{i}" for i in range(10))


@query(_map_sql("0", "theme_hit AND cap_code = 'SC'", "score >= 10 AND din_backed AND theme_matched > 0", "k % 3 = 0 OR k % 4 = 0", _EAST))
def f18_map_browse(spark, d):
    """Boards within a theme and a cap band, of directors with a signal."""
    r = M.MapRequest(flags=frozenset(["din_only"]), signals=frozenset(["bb", "tq"]), min_score=10, theme=_PATTERN, cap="SC")
    return _rows(spark, d, r)


@query(_map_sql("0", "true", "sme_cross AND theme_matched > 0", "k % 5 = 0 OR k % 7 = 0", _EAST, "CASE WHEN theme_hit THEN 0 ELSE 1 END, lower(name), ticker"))
def f18_map_show_all(spark, d):
    """All boards of a theme's directors, the theme's first."""
    r = M.MapRequest(flags=frozenset(["sme_cross"]), lists=frozenset(["hold", "fund_a"]), theme=_PATTERN, show_all=True)
    return _rows(spark, d, r)


_FOUND = "(lower(director) LIKE '%07%' OR lower(coalesce(din, '')) LIKE '%07%')"
_SEAT_FOUND = "(lower(ticker) LIKE '%07%' OR lower(name) LIKE '%07%' OR lower(designation) LIKE '%07%')"


@query(_map_sql("0", f"({_FOUND} OR {_SEAT_FOUND})", many="person_id IN (SELECT person_id FROM rows_ WHERE lower(director) LIKE '%07%' OR lower(coalesce(din, '')) LIKE '%07%' OR lower(ticker) LIKE '%07%' OR lower(company) LIKE '%07%')"))
def s37_map_search(spark, d):
    """A search takes those on one board too; of a company found, only its own
    seats."""
    return _rows(spark, d, M.MapRequest(search=" 07 ", narrow=True))
