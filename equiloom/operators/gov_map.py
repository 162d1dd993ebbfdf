"""The map of directors and boards: browsing and searching, filters inside a
director's seats, and counts anew of what is left.

A director's seats travel as one array, bounded by the boards a person can sit
on; themes are matched once a company, not once a seat.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.operators import governance as G
from equiloom.operators import themes as TH

FLAGS = ("din_only", "bridge", "tiny_bridge", "ti_bridge", "multi_lc", "sme_cross", "hide_collision")
SEAT_FLAGS = ("bb", "tq")
SEAT_LISTS = ("hold", "edge", "fund_a", "fund_b")
SEAT = ("ticker", "name", "market", "designation", "cap_code", "is_sme", "theme_hit", "highlights", *(f"has_{x}" for x in (*SEAT_FLAGS, *SEAT_LISTS)))


@dataclass(frozen=True)
class MapRequest:
    """What is asked for: `flags` of FLAGS, `signals` and `lists` of which some
    seat must have one, and how a theme narrows a director's seats."""

    search: str = ""
    flags: frozenset = frozenset()
    signals: frozenset = frozenset()
    lists: frozenset = frozenset()
    min_score: float = 0
    min_boards: int = 2
    theme: str = ""
    show_all: bool = False
    cap: str = "All"
    sme: bool = False
    narrow: bool = False


def _holds(c: Column, term: str) -> Column:
    return F.coalesce(F.lower(c).contains(term), F.lit(False))


def chosen(rows: DataFrame, r: MapRequest) -> DataFrame:
    """Seats to begin with: a search takes all boards of whom it finds by name,
    number, code or company; else those on enough boards."""
    q = r.search.strip().lower()
    if not q:
        return G.multi_board(rows, r.min_boards)
    hit = rows.where(reduce(lambda a, b: a | b, [_holds(F.col(c), q) for c in ("director", "din", "ticker", "name")]))
    return rows.join(hit.select("person_id").distinct(), "person_id", "left_semi")


def directors(seats: DataFrame, companies: DataFrame, r: MapRequest) -> DataFrame:
    """A row a director with the seats as `companies`, by company name. Expects
    seats (person_id, din, director, ticker, designation) and companies (ticker,
    name, market, mcap_cr, cap_code, text, has_*)."""
    sme = F.coalesce(F.col("market").rlike("(?i)\\bSME\\b"), F.lit(False))
    c = companies.withColumns({"is_sme": sme})
    if r.theme.strip():
        c = TH.theme_columns(c, "text", {}, r.theme)
    else:
        c = c.drop("text").withColumns({"theme_hit": F.lit(False), "highlights": F.array().cast("array<string>")})
    rows = chosen(seats.join(c, "ticker"), r)
    scores = G.director_scores(rows)
    held = rows.groupBy("person_id", "din", "director").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("by"), "ticker", F.struct(*SEAT).alias("seat")))), lambda x: x["seat"]).alias("companies"),
        ((F.count_if("is_sme") > 0) & (F.count_if(~F.col("is_sme")) > 0)).alias("sme_cross"),
    )
    same = [F.col(f"s.{x}").eqNullSafe(F.col(f"h.{x}")) for x in ("person_id", "din", "director")]
    j = scores.alias("s").join(held.alias("h"), reduce(lambda a, b: a & b, same))
    backed = G.din_backed(F.col("s.person_id"), F.col("s.din"))
    return j.select("s.*", "h.companies", "h.sme_cross", backed.alias("din_backed"))


def narrowed(rows: DataFrame, r: MapRequest) -> DataFrame:
    """Rows of `directors` that pass, with what is left of their seats:
    board_count and tickers are of those, theme_matched of the theme's."""
    col, q = F.col, r.search.strip().lower()
    need = {"din_only": col("din_backed"), "hide_collision": ~col("name_collision")}
    out = rows.where(col("score") >= r.min_score)
    for f in FLAGS:
        if f in r.flags:
            out = out.where(need.get(f, col(f) if f not in need else need[f]))
    if not q:
        out = out.where(col("board_count") >= r.min_boards)

    def keep(df: DataFrame, test) -> DataFrame:
        return df.withColumn("companies", F.filter("companies", test)).where(F.size("companies") > 0)

    def some(df: DataFrame, names) -> DataFrame:
        return df.where(F.exists("companies", lambda s: reduce(lambda a, b: a | b, [F.coalesce(s[f"has_{x}"], F.lit(False)) for x in sorted(names)]))) if names else df

    theme = bool(r.theme.strip())
    out = out.withColumn("theme_matched", F.size(F.filter("companies", lambda s: s["theme_hit"])))
    if theme:
        out = out.where("theme_matched > 0")
        out = out if r.show_all else keep(out, lambda s: s["theme_hit"])
    cap = (r.cap or "All").upper()
    if cap != "ALL":
        out = keep(out, lambda s: s["cap_code"].isNull() if cap == "NC" else F.upper(s["cap_code"]) == cap)
    if r.sme:
        out = keep(out, lambda s: s["is_sme"])
    out = some(some(out, r.signals), r.lists)
    if q:
        own = _holds(col("director"), q) | _holds(col("din"), q)
        found = F.filter("companies", lambda s: _holds(s["ticker"], q) | _holds(s["name"], q) | _holds(s["designation"], q))
        out = out.withColumns({"_own": own, "_found": found}).where(col("_own") | (F.size("_found") > 0))
        if r.narrow:
            out = out.withColumn("companies", F.when(~col("_own"), col("_found")).otherwise(col("companies")))
        out = out.drop("_own", "_found")
    if theme and r.show_all:
        out = out.withColumn("companies", F.concat(F.filter("companies", lambda s: s["theme_hit"]), F.filter("companies", lambda s: ~s["theme_hit"])))
    tickers = F.transform("companies", lambda s: s["ticker"])
    return out.withColumns({"board_count": F.size(F.array_distinct(F.transform(tickers, F.upper))).cast("long"), "tickers": F.array_join(tickers, ", ")})
