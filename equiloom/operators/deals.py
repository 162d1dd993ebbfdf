"""Bulk deals: dedup, investor tagging, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num

KEY = ("trade_date", "symbol", "client", "side", "deal_type", "quantity", "price")


def dedup(deals: DataFrame, *order: str) -> DataFrame:
    """Deals by their seven-part key, client in lower case, nulls equal; first kept."""
    w = Window.partitionBy(*[F.lower("client") if k == "client" else F.col(k) for k in KEY]).orderBy(*order)
    return deals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def investors_of(client: Column, patterns: dict[str, list[str]]) -> Column:
    """Ids of all investors one of whose patterns occurs."""
    return F.array_compact(F.array(*[F.when(client.rlike("(?i)" + "|".join(ps)), F.lit(i)) for i, ps in patterns.items()]))


def first_pattern(client: Column, patterns: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(client, f"(?i)({p})", 1), F.lit("")) for ps in patterns.values() for p in ps])


def enrich(deals: DataFrame, patterns: dict[str, list[str]], sme: DataFrame, primary: tuple[str, ...] = ()) -> DataFrame:
    """Investor ids, whether a primary one is among them, the small-company
    flag and value in crore."""
    flag = sme.select("symbol").distinct().withColumn("_s", F.lit(True))
    j = deals.join(flag, "symbol", "left")
    return j.select("*", investors_of(F.col("client"), patterns).alias("investor_ids"), F.coalesce("_s", F.lit(False)).alias("in_sme_universe"), num.js_round(F.col("quantity") * F.col("price") / 1e7, 1).alias("value_cr")).withColumn("primary_hit", F.arrays_overlap("investor_ids", F.array(*[F.lit(p) for p in primary]).cast("array<string>"))).drop("_s")


def radar(enriched: DataFrame, investor: str | None = None, sme: bool = False, buys: bool = False, primary: bool = False, smart: str | None = None) -> DataFrame:
    """Deals of investors: primary ones or smart money unless an investor or
    primary ones alone are asked for; small companies and buys on demand."""
    tagged = F.coalesce(F.col(smart), F.lit(False)) if smart else F.lit(False)
    out = enriched.where((F.size("investor_ids") > 0) | tagged)
    if primary:
        out = out.where("primary_hit")
    elif not investor:
        out = out.where(F.col("primary_hit") | tagged)
    if investor:
        out = out.where(F.array_contains("investor_ids", investor))
    if sme:
        out = out.where("in_sme_universe")
    return out.where("side = 'BUY'") if buys else out


def investor_stats(enriched: DataFrame, ids: list[str]) -> DataFrame:
    """Deals, buys and small-company deals by investor; none is zero."""
    every = enriched.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("investor"))
    s = enriched.select(F.explode("investor_ids").alias("investor"), "side", "in_sme_universe").groupBy("investor").agg(
        F.count("*").alias("deals"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if("in_sme_universe").alias("sme")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(s, "investor", "left").select("investor", zero("deals"), zero("buys"), zero("sme"))


def symbol_hits(enriched: DataFrame, *order: str) -> DataFrame:
    """Per small company with a primary investor's deal: deals, investors, last
    date and its side, ties to the later row."""
    hit = enriched.where(F.col("in_sme_universe") & F.col("primary_hit"))
    return hit.groupBy("symbol").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("investor_ids")))), ",").alias("investors"),
        F.max("trade_date").alias("last_date"), F.max_by("side", F.struct("trade_date", *order)).alias("last_side"),
    )


def stats(deals: DataFrame) -> DataFrame:
    return deals.agg(F.count("*").alias("n"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("deal_type") == "block").alias("blocks"), F.max("trade_date").alias("last_date"), F.countDistinct("symbol").alias("symbols"))
