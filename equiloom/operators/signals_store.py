"""Shareholders found in filings, stored news signals and cached candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num, text
from equiloom.sources import json_walk

# Fields of a shareholder's record, the preferred first.
PCT = ("percentage", "percHolding", "pct", "shareholdingPercentage", "holdingPct")
SHARES = ("noOfShares", "shares", "quantity", "noOfSecurities")
AS_OF = ("date", "asOnDate", "period")
COMPANY = ("companyName", "symbol")


def shareholders(df: DataFrame, column: str, symbol: str, investors: Callable[[Column], Column], primary: tuple[str, ...], sme: DataFrame) -> DataFrame:
    """Shareholders of followed investors in JSON of any shape, one a symbol and
    name: `investors` gives a name's investor ids. Of a document's records of a
    name the outermost counts."""
    found = json_walk.named_objects(df, column, symbol, wanted=lambda n: F.size(investors(n)) > 0, names=json_walk.NAMES[:-1])
    get = lambda fs: F.coalesce(*[F.try_variant_get("object", f"$.{f}", "string") for f in fs])
    ids = investors(F.col("name"))
    x = found.select(
        text.bare_symbol(F.col(symbol)).alias("symbol"), text.nonempty(get(COMPANY)).alias("company_name"), F.col("name").alias("holder_name"), ids.alias("investor_ids"),
        F.arrays_overlap(ids, F.array(*map(F.lit, primary)).cast("array<string>")).alias("primary_hit"), num.parse_num(get(PCT)).alias("pct"), num.parse_num(get(SHARES)).alias("shares"), text.nonempty(get(AS_OF)).alias("as_of_date"), "depth",
    )
    first = Window.partitionBy("symbol", "holder_name").orderBy("depth", F.desc("shares"), F.desc("pct"))
    once = x.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "depth")
    small = sme.select(F.col("symbol").alias("_s")).distinct()
    return once.join(small, F.col("symbol") == F.col("_s"), "left").withColumn("in_sme_universe", F.col("_s").isNotNull()).drop("_s")


def upsert_news(stored: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Signals by headline and link, the last written kept (column `at`)."""
    last = Window.partitionBy("headline", "link").orderBy(F.desc("_new"), F.desc(at))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new")


def list_news(stored: DataFrame, primary: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """The last signals by when they were fetched; primary investors' among them."""
    out = stored.orderBy(F.desc("fetched_at"), "headline", "link").limit(min(limit, 200))
    return out.where(F.arrays_overlap("investor_ids", F.array(*map(F.lit, primary)))) if primary else out


def by_published(news: DataFrame) -> DataFrame:
    """Latest first, undated ones last."""
    return news.orderBy(F.desc_nulls_last("published"), "headline", "link")


def cached_candidates(cache: DataFrame, schema: str, now: str, hours: int = 12, least: float = 0, limit: int = 200) -> DataFrame:
    """Of the best cached candidates those still fresh and readable, their
    payloads opened (symbol, alpha_score, payload: JSON, fetched_at)."""
    best = cache.where(F.col("alpha_score") >= least).orderBy(F.desc("alpha_score"), "symbol").limit(limit)
    fresh = F.col("fetched_at") >= F.expr(f"timestamp_ntz '{now}' - interval {hours} hours")
    opened = best.where(fresh).withColumn("p", F.from_json("payload", schema))
    return opened.where(F.try_parse_json("payload").isNotNull()).select("symbol", "alpha_score", "p.*")


def verdict_meta(verdicts: DataFrame, companies: DataFrame) -> DataFrame:
    """Verdicts with their company's market, website, about and headquarters."""
    c = companies.select(F.upper("ticker").alias("_t"), F.col("market").alias("_m"), F.col("website").alias("web"), text.nonempty(F.col("about")).alias("about"), text.nonempty(F.col("headquarters")).alias("headquarters"))
    return verdicts.join(c, F.upper("symbol") == F.col("_t"), "left").withColumn("market", F.coalesce("_m", "market")).drop("_t", "_m")


def taxonomy(header: dict[str, Column]) -> list[Column]:
    """Sector, industry and sub-sector of an exchange's header record."""
    get = lambda *ks: F.coalesce(*[text.nonempty(header[k]) for k in ks])
    industry = get("IGroup", "IndustryNew", "Industry")
    return [get("Sector").alias("sector"), industry.alias("industry"), F.coalesce(get("ISubGroup", "Industry"), industry).alias("sub_sector")]


def headquarters(*parts: Column) -> Column:
    """City, state and country that are known, joined; none is null."""
    return F.nullif(F.concat_ws(", ", *map(text.nonempty, parts)), F.lit(""))


def explained(keyword: Column, glossaries: list[dict[str, str]], aliases: dict[str, str], fallback: str) -> Column:
    """What a keyword means: in the first glossary that has it, its alias, its
    singular or the alias of that; else the fallback; blank is null."""
    key = F.lower(F.trim(F.regexp_replace(keyword, "\\s+", " ")))
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    single = F.when(key.endswith("s") & (F.length(key) > 3), F.substring(key, F.lit(1), F.length(key) - 1))
    tries = []
    for g in glossaries:
        for k in (key, single):
            tries.append(F.try_element_at(table(g), k))
            if aliases:
                tries.append(F.try_element_at(table(g), F.try_element_at(table(aliases), k)))
    return F.when(key != "", F.coalesce(*tries, F.lit(fallback)))
