"""Candidates of a hidden portfolio: catalysts in a company's headlines, its
last deals, and both with its figures and alpha score.

What is gathered for a company is bounded before it is gathered: a feed has
FEED items, of deals the last ones are taken by rank, keywords come from lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import text
from equiloom.operators import scores

FEED, DEALS, DAYS = 20, 5, 90

# Keywords of two themes; those of smart money are names, given.
MOAT = ("API certification", "ISO", "CE mark", "Defense order", "MoU", "Patent", "Export", "Capacity expansion", "New plant", "Niche")
GROWTH = ("Order book", "Bagged order", "Revenue beat", "Margin expansion", "Turnaround", "Capacity utilization")


def themes(smart: tuple[str, ...] = ()) -> dict[str, tuple[str, ...]]:
    return {"moat": MOAT, "growth": GROWTH, "smart_money": smart}


def _hits(title: Column, words: tuple[str, ...]) -> Column:
    """Keywords that a title holds in any case, the longer ones first."""
    return text.keyword_hits(title, sorted(words, key=lambda w: -len(w))) if words else F.array().cast("array<string>")


def catalysts(items: DataFrame, by_theme: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per company of headlines (ticker, name, place, title, link, published):
    `news`, those about it that hold a keyword, with keywords and themes; the
    distinct keywords of each theme, by first mention; the first catalyst or
    else the first headline about it."""
    x = items.where((F.col("place") < FEED) & text.headline_names(F.col("title"), F.col("name"), F.col("ticker")))
    x = x.withColumns({f"_{k}": _hits(F.col("title"), ws) for k, ws in by_theme.items()})
    matched = F.array_distinct(F.concat(*[F.col(f"_{k}") for k in by_theme]))
    said = F.array_compact(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in by_theme]))
    row = F.struct("place", "title", "link", "published", matched.alias("matched"), said.alias("themes"), *[F.col(f"_{k}").alias(k) for k in by_theme])
    g = x.groupBy("ticker").agg(F.array_sort(F.collect_list(row)).alias("r"))  # FEED items at most
    hits = F.filter("r", lambda i: F.size(i["matched"]) > 0)
    top = F.when(F.size("hits") > 0, F.get("hits", F.lit(0))).otherwise(F.get("r", F.lit(0)))
    words = lambda k: F.array_distinct(F.flatten(F.transform("hits", lambda i: i[k]))).alias(f"{k}_keywords")
    return g.withColumn("hits", hits).select(
        "ticker", F.transform("hits", lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["published"].alias("published"), i["matched"].alias("matched"), i["themes"].alias("themes"))).alias("news"),
        *map(words, by_theme), top["title"].alias("top_headline"), top["link"].alias("top_link"),
    )


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(symbol, other) where one begins with the other: each side's beginnings
    meet the other's whole symbols, so that no pair is tried that does not fit."""
    a, b = left.select(F.col("symbol").alias("symbol")).distinct(), right.select(F.col("symbol").alias("other")).distinct()
    begin = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))
    longer = b.where("other <> ''").select("other", F.explode(begin("other")).alias("symbol")).join(a, "symbol").select("symbol", "other")
    shorter = a.where("symbol <> ''").select("symbol", F.explode(begin("symbol")).alias("other")).join(b, "other").select("symbol", "other")
    return longer.unionByName(shorter).distinct()


def recent_deals(symbols: DataFrame, deals: DataFrame, as_of: str, *order: str) -> DataFrame:
    """Per symbol its last DEALS deals of DAYS days under any symbol that fits,
    ties by `order`, and of all of these whether smart money was there and under
    which names."""
    late = deals.where(F.col("trade_date") >= F.date_sub(F.lit(as_of).cast("date"), DAYS))
    pairs = prefix_pairs(symbols, late)
    x = late.withColumnRenamed("symbol", "other").join(pairs, "other")
    last = Window.partitionBy("symbol").orderBy(F.desc("trade_date"), *map(F.desc, order))
    row = F.struct(F.col("_r"), "trade_date", "client", "side", "quantity", "price", "deal_type", "smart_money")
    few = x.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= DEALS).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(row)), lambda d: d.dropFields("_r")).alias("bulk_deals"))
    names = x.where("smart_money").groupBy("symbol").agg(F.array_sort(F.collect_set(F.coalesce(F.nullif("pattern", F.lit("")), F.col("client")))).alias("deal_keywords"))
    return symbols.select("symbol").distinct().join(few, "symbol", "left").join(names, "symbol", "left")


def assemble(figures: DataFrame, news: DataFrame, deals: DataFrame) -> DataFrame:
    """Candidates (symbol and its figures) with catalysts, deals and alpha; by
    alpha, then symbol."""
    none = F.array().cast("array<string>")
    known = lambda c: F.coalesce(F.col(c), none)
    j = figures.join(news.withColumnRenamed("ticker", "symbol"), "symbol", "left").join(deals, "symbol", "left")
    smart = F.array_distinct(F.concat(known("smart_money_keywords"), known("deal_keywords")))
    j = j.withColumns({"moat_keywords": known("moat_keywords"), "growth_keywords": known("growth_keywords"), "smart_money_keywords": smart}).withColumn("smart_money_flag", F.size("smart_money_keywords") > 0)
    score = scores.alpha(F.size("moat_keywords"), F.size("growth_keywords"), F.col("smart_money_flag"), F.col("mcap_cr"))
    return j.withColumn("alpha_score", score).drop("deal_keywords").orderBy(F.desc("alpha_score"), "symbol")
