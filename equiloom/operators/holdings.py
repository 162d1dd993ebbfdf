"""Investor holdings: merging, resolution, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num

#: Order of change types when rows of a company are merged.
RANK = {"new": 4, "increased": 3, "decreased": 2, "unchanged": 1}


def _rank(c: str):
    out = F.lit(0)
    for k, v in RANK.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def with_pct(h: DataFrame) -> DataFrame:
    total = h.groupBy("symbol").agg(F.sum(F.col("shares").cast("decimal(18,2)")).cast("double").alias("all_shares"))
    return h.join(total, "symbol").withColumn("pct", F.floor(F.col("shares") / F.col("all_shares") * 10000 + 0.5) / 100).drop("all_shares")


def merge(h: DataFrame, key: str) -> DataFrame:
    """By investor and key: greatest value and share, strongest change, all entities."""
    return h.groupBy("investor", key).agg(F.max("value").alias("value"), F.max("pct").alias("pct"), F.max_by("change_type", _rank("change_type")).alias("change_type"), F.array_join(F.array_sort(F.collect_set("entity")), ", ").alias("entities"))


def consensus(h: DataFrame, least: int = 2) -> DataFrame:
    """Per symbol held by so many investors: counts, greatest share, total
    value, and the change and holder of the largest position."""
    g = h.groupBy("symbol").agg(
        F.countDistinct("investor").alias("investors"), F.max("pct").alias("max_pct"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"),
        F.count_if(F.col("change_type") == "new").alias("new_count"), F.count_if(F.col("change_type") == "increased").alias("increased_count"),
        F.max_by("change_type", F.struct("value", "pct", "investor")).alias("top_change"), F.max_by("investor", F.struct("value", "pct", "investor")).alias("top_investor"),
    )
    return g.where(F.col("investors") >= least)


def investor_summary(h: DataFrame) -> DataFrame:
    n = lambda *k: F.count_if(F.col("change_type").isin(*k))
    return h.groupBy("investor").agg(F.count("*").alias("holdings"), n("new", "disclosed").alias("new_n"), n("increased").alias("increased_n"), n("decreased").alias("decreased_n"))


def append_missing(h: DataFrame, picks: DataFrame, *keys: str) -> DataFrame:
    """Disclosed picks whose key is absent, with their defaults."""
    extra = picks.join(h, list(keys), "left_anti")
    return h.unionByName(extra.select("*", F.lit("disclosed").alias("change_type"), F.lit(0.0).alias("value")), allowMissingColumns=True)


def resolve(names: DataFrame, lookups: list[DataFrame]) -> DataFrame:
    """Symbols by the first lookup (key, symbol) that knows a name: its forms
    are ranked, joined by equality, and the least rank wins."""
    ranked = None
    for i, t in enumerate(lookups):
        x = t.select("key", "symbol", F.lit(i).alias("rank"))
        ranked = x if ranked is None else ranked.unionByName(x)
    forms = names.select("name", F.posexplode(F.array_distinct(F.array(F.col("key"), F.regexp_replace("key", "s$", ""), F.concat("key", F.lit("s"))))).alias("form", "key"))
    w = Window.partitionBy("name").orderBy("rank", "form", "symbol")
    hit = forms.join(ranked, "key").withColumn("r", F.row_number().over(w)).where("r = 1").select("name", "symbol", "rank")
    return names.select("name").join(hit, "name", "left")


def short_name(investor: Column, shorts: dict[str, str]) -> Column:
    """The short form that is given, or of a name in `shorts` without one its
    first two words; other names as they are."""
    table = F.create_map(*[F.lit(x) for k, v in shorts.items() for x in (k, v or " ".join(k.split()[:2]))]) if shorts else None
    return F.coalesce(F.try_element_at(table, investor), investor) if shorts else investor


def badge(change_type: Column, change: Column) -> Column:
    """What happened to a holding, with the change in percent where known."""
    kind = F.lower(F.coalesce(change_type, F.lit("")))
    known = change.isNotNull() & ~F.isnan(change)
    shown = F.concat(F.format_string("%.2f", change), F.lit("%"))
    up = F.when(known, F.concat(F.lit("↑"), F.when(change >= 0, "+").otherwise(""), shown)).otherwise("↑")
    return F.when(kind == "new", "NEW").when(kind == "disclosed", "DISCLOSED").when(kind == "increased", up).when(kind == "decreased", F.when(known, F.concat(F.lit("↓"), shown)).otherwise("↓")).otherwise("")


def consensus_rows(h: DataFrame, least: int = 2, shorts: dict[str, str] | None = None) -> DataFrame:
    """Per symbol (in any case) that so many investors hold: the first row's name,
    exchange, sector and price (column `place` orders rows), holders and their
    short names, counts of changes, greatest share, value in crore, and what each
    holder did. A symbol's holders are bounded by the investors followed."""
    shorts = shorts or {}
    x = h.where(F.trim("symbol") != "").withColumns({"symbol": F.upper("symbol"), "short": short_name(F.col("investor"), shorts)})
    b = badge(F.col("change_type"), F.col("change"))
    part = F.struct("investor", "place", F.col("short").alias("investor_short"), F.lower(F.coalesce("change_type", F.lit("unchanged"))).alias("change_type"), "change", F.when(b != "", F.concat_ws(" ", "short", b)).otherwise(F.col("short")).alias("label"))
    n = lambda k: F.count_if(F.lower(F.coalesce("change_type", F.lit(""))) == k)
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    g = x.groupBy("symbol").agg(
        F.min_by(F.struct("company_name", "exchange", "sector", "price"), "place").alias("first"), F.array_sort(F.collect_set("investor")).alias("investors"), F.array_sort(F.collect_list(part)).alias("activity_parts"),
        n("new").alias("new_count"), n("increased").alias("increased_count"), F.max(finite("pct")).alias("holding_percent"), F.sum(finite("value_cr").cast("decimal(38,6)")).cast("double").alias("_v"),
    ).where(F.size("investors") >= least)
    return g.select(
        "symbol", "first.company_name", F.coalesce(F.nullif("first.exchange", F.lit("")), F.lit("NSE")).alias("exchange"), "first.sector", "first.price", "holding_percent", F.size("investors").alias("investor_count"), "new_count", "increased_count",
        "investors", F.transform("investors", lambda i: short_name(i, shorts)).alias("investor_shorts"), F.array_join(F.transform("activity_parts", lambda p: p["label"]), " · ").alias("activity"), "activity_parts", num.js_round(F.col("_v"), 2).alias("combined_value_cr"),
    )


def consensus_order() -> list[Column]:
    """More investors, more new ones, more that add, greater value, symbol."""
    return [F.desc("investor_count"), F.desc("new_count"), F.desc("increased_count"), F.coalesce("combined_value_cr", F.lit(0.0)).desc(), F.asc("symbol")]


def consensus_filter(rows: DataFrame, search: str = "", sector: str = "All", min_pct: float | None = None, min_value: float | None = None, min_price: float | None = None, max_price: float | None = None) -> DataFrame:
    """Rows whose symbol, name, sector, holders or activity hold the text, of a
    sector in any case, within bounds; an unknown figure is outside them."""
    q, s = search.strip().lower(), sector.strip().lower()
    out = rows
    if q:
        hay = F.lower(F.concat_ws(" ", "symbol", "company_name", "sector", F.array_join("investors", " "), "activity"))
        out = out.where(hay.contains(q))
    if s and s != "all":
        out = out.where(F.lower(F.trim("sector")) == s)
    for column, bound, above in (("holding_percent", min_pct, True), ("combined_value_cr", min_value, True), ("price", min_price, True), ("price", max_price, False)):
        if bound is not None:
            out = out.where(F.col(column) >= bound if above else F.col(column) <= bound)
    return out
