"""Parsers of filings, feeds and tables in text columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.functions import dates, num, text


def feed_items(df: DataFrame, column: str, *keep: str, most: int = 20) -> DataFrame:
    """title, link and date of a feed's items, the first of them."""
    get = lambda tag: F.xpath(F.col(column), F.lit(f"//item/{tag}/text()"))
    items = F.slice(F.arrays_zip(get("title").alias("title"), get("link").alias("link"), get("pubDate").alias("published")), 1, most)
    return df.select(*keep, F.explode(items).alias("i")).select(*keep, F.col("i.title").alias("title"), F.col("i.link").alias("link"), F.to_timestamp("i.published", "dd MMM yyyy HH:mm:ss").alias("published"))


def board_json(df: DataFrame, column: str) -> DataFrame:
    """Directors of a composition document, active ones only."""
    schema = "struct<symbol:string, data:array<struct<name:string, din:string, designation:string, status:string>>>"
    d = df.select(F.from_json(column, schema).alias("j")).select("j.symbol", F.explode("j.data").alias("d"))
    gone = F.lower(F.coalesce("d.status", F.lit(""))).rlike("inactive|cessation|^no$")
    return d.where(~gone).select(text.bare_symbol(F.col("symbol")).alias("ticker"), text.person_id(F.col("d.din"), F.col("d.name")).alias("person_id"), F.col("d.name").alias("director"), F.col("d.designation").alias("designation"), text.infer_category(F.col("d.designation")).alias("category"))


def results_json(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Result columns v1..v3 of JSON within JSON, by period; EBIT is revenue
    times the operating margin."""
    inner = F.from_json(F.get_json_object(column, "$.d"), "struct<periods:array<string>, sales:array<double>, opm:array<double>, np:array<double>>")
    z = df.select(*keep, inner.alias("j")).select(*keep, F.explode(F.arrays_zip(F.col("j.periods").alias("p"), F.col("j.sales").alias("s"), F.col("j.opm").alias("o"), F.col("j.np").alias("n"))).alias("z"))
    return z.select(*keep, dates.period_end(F.col("z.p")).alias("period_end"), F.col("z.s").alias("revenue"), num.js_round(F.col("z.s") * F.col("z.o") / 100, 2).alias("ebit"), F.col("z.n").alias("net_income"))


def listings(df: DataFrame, column: str) -> DataFrame:
    """Active small-company listings of the groups M and MT, one a scrip."""
    schema = "array<struct<scrip_id:string, scrip_name:string, status:string, grp:string, mcap:double>>"
    r = df.select(F.explode(F.from_json(column, schema)).alias("r")).select("r.*").where("status = 'Active' and trim(grp) in ('M', 'MT')")
    return r.groupBy(F.upper("scrip_id").alias("ticker")).agg(F.min("scrip_name").alias("name"), F.max(F.when(F.col("mcap") > 0, F.col("mcap"))).alias("mcap_cr"))


def integrated_filings(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Filings of a list, or of one under `data`, that have a document of the
    integrated kind and a quarter's end: (period_end, xbrl, consolidated, place
    in the list)."""
    schema = "array<struct<qe_Date:string, consolidated:string, xbrl:string>>"
    whole = F.when(F.trim(column).startswith("["), F.from_json(column, schema)).otherwise(F.from_json(F.get_json_object(column, "$.data"), schema))
    r = df.select(*keep, F.posexplode(whole).alias("place", "r")).select(*keep, "place", "r.*")
    said = F.lower(F.coalesce("consolidated", F.lit("")))
    end = dates.quarter_end_iso(F.col("qe_Date")).cast("date")
    return r.where(F.trim("xbrl").startswith("http") & F.upper("xbrl").contains("INDAS")).select(*keep, end.alias("period_end"), F.trim("xbrl").alias("xbrl"), (~(said.contains("non") | said.contains("stand"))).alias("consolidated"), "place").where("period_end is not null")


def corporate_filings(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Filings of the older kind: (period_end, from_date, xbrl, consolidated,
    half: of half a year, broadcast_ms)."""
    schema = "array<struct<toDate:string, fromDate:string, consolidated:string, xbrl:string, relatingTo:string, period:string, broadCastDate:string, exchdisstime:string>>"
    r = df.select(*keep, F.explode(F.from_json(column, schema)).alias("r")).select(*keep, "r.*").where(F.trim("xbrl").startswith("http"))
    said, day = F.lower(F.coalesce("consolidated", F.lit(""))), lambda c: dates.quarter_end_iso(F.col(c)).cast("date")
    half = F.lower(F.concat_ws(" ", "relatingTo", "period")).contains("half")
    sent = dates.broadcast_ms(F.coalesce(F.nullif("broadCastDate", F.lit("")), "exchdisstime"))
    return r.select(*keep, day("toDate").alias("period_end"), day("fromDate").alias("from_date"), F.trim("xbrl").alias("xbrl"), (~(said.contains("non") | said.contains("stand"))).alias("consolidated"), half.alias("half"), sent.alias("broadcast_ms")).where("period_end is not null")


def pick_filings(filings: DataFrame, *keys: str) -> DataFrame:
    """Of a quarter the consolidated filing, or else the first of the list."""
    best = F.min_by(F.struct("xbrl", "consolidated"), F.struct(~F.col("consolidated"), "place"))
    return filings.groupBy(*keys, "period_end").agg(best.alias("b")).select(*keys, "period_end", "b.xbrl", "b.consolidated")
