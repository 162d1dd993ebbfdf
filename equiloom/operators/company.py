"""Company master: enrichment, gaps, filters, facets, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num, text


def first_per_key(df: DataFrame, key: str | list[str], *order) -> DataFrame:
    """One row of each key, the first in a total order."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_master(df: DataFrame) -> DataFrame:
    """Companies by upper-cased ticker, the first kept."""
    return first_per_key(df.withColumn("ticker", F.upper(F.trim("ticker"))), "ticker", "name", "market")


def enrich(master: DataFrame, classes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sector and sub-sector from the class of (ticker, market), then of the
    ticker alone, then the master; price and market cap from metrics."""
    exact = classes.select("ticker", "market", F.col("sector").alias("s1"), F.col("sub_sector").alias("b1"))
    loose = first_per_key(classes, "ticker", "market").select("ticker", F.col("sector").alias("s2"), F.col("sub_sector").alias("b2"))
    joined = master.join(exact, ["ticker", "market"], "left").join(loose, "ticker", "left").join(metrics, "ticker", "left")
    return joined.select(
        "ticker", "name", "market",
        text.first_nonempty(F.col("s1"), F.col("s2"), F.col("sector")).alias("sector"),
        text.first_nonempty(F.col("b1"), F.col("b2"), F.col("sub_sector")).alias("sub_sector"),
        "mcap_cr", "price", "website", "about",
    )


def search_text(*columns: str) -> Column:
    return F.concat_ws(" \n ", *[text.nonempty(F.col(c)) for c in columns])


# Verbs that follow a company's name in its description.
NAME_VERBS = "designs|engages|operates|provides|manufactures|develops|offers|is an|is a|specializes|focuses|distributes|produces|supplies|markets|trades in"


def resolve_name() -> Column:
    """A stored name unless it is a code of up to six digits; else the name
    that the prose begins with; else the ticker."""
    prose = F.trim("about")
    parsed = F.when(F.length(prose) >= 20, text.nonempty(F.regexp_extract(prose, f"(?i)^(.{{3,120}}?)\\s+(?:{NAME_VERBS})\\b", 1)))
    stored = text.nonempty(F.col("name"))
    return F.coalesce(F.when(~stored.rlike("^\\d{1,6}$"), stored), parsed, stored, F.col("ticker"))


GAPS = ("price", "mcap", "sector", "sub_sector", "about", "web")


def gap_flags(df: DataFrame) -> DataFrame:
    source = {"price": "price", "mcap": "mcap_cr", "sector": "sector", "sub_sector": "sub_sector", "about": "about", "web": "website"}
    return df.select("*", *[(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"gap_{g}") for g, c in source.items()])


def gap_filter(kind: str) -> Column:
    """any, price, mcap, sector (or sub-sector), sub_sector, about, web, metrics."""
    g = lambda x: F.col(f"gap_{x}")
    if kind == "any":
        return reduce(lambda a, b: a | b, [g(x) for x in GAPS])
    if kind == "sector":
        return g("sector") | g("sub_sector")
    return g(kind) if kind in GAPS else g("price") | g("mcap")


def gap_summary(df: DataFrame) -> DataFrame:
    f = gap_flags(df)
    return f.agg(
        F.count("*").alias("total"),
        *[F.count_if(gap_filter(k)).alias(f"missing_{k}") for k in ("any", "price", "mcap", "sector", "sub_sector", "about", "web", "metrics")],
    )


def market_filter(market: str, widen: bool = False) -> Column:
    """Exact; NSE takes its small-company board in when scanning or searching."""
    return F.col("market").isin("NSE", "NSE SME") if market == "NSE" and widen else F.col("market") == market


def keyword_search(terms: str, every: bool = False) -> Column:
    """Terms parted by `|`: a ticker or its beginning, or a phrase of the text."""
    tests = [F.lower("ticker").startswith(t.lower()) | text.has_term(F.col("search_text"), t) for t in (x.strip() for x in terms.split("|")) if t]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def signal_filter(bb: bool, tq: bool, ema: bool, every: bool) -> Column:
    tests = [F.coalesce(F.col(c), F.lit(False)) for c, on in (("has_bb", bb), ("has_tq", tq), ("has_ema", ema)) if on]
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def prefer(df: DataFrame, flag: str) -> DataFrame:
    """Rows with the flag, or all where none has it."""
    any_ = df.agg(F.max(F.col(flag)).alias("_any"))
    return df.crossJoin(F.broadcast(any_)).where(F.col(flag) | ~F.coalesce("_any", F.lit(False))).drop("_any")  # one row


def stubs(tickers: DataFrame, master: DataFrame) -> DataFrame:
    """Null-padded rows for listed tickers absent from the master, appended."""
    missing = tickers.join(master, "ticker", "left_anti").dropDuplicates(["ticker"])
    return master.unionByName(missing.select("ticker"), allowMissingColumns=True)


def in_sector(allow: list[str], allow_sub: list[str] = (), deny: list[tuple[str, str]] = ()) -> Column:
    """The gate of a theme. Without an allow list all pass; with one, denied
    (sector, sub-sector) pairs fail and allowed sub-sectors or sectors pass."""
    if not allow and not allow_sub:
        return F.lit(True)
    sector, sub = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("sector", "sub_sector"))
    pair = reduce(lambda a, b: a | b, [(sector == s) & (sub == b) for s, b in deny], F.lit(False))
    return ~pair & (((sub != "") & sub.isin(*allow_sub)) | ((sector != "") & sector.isin(*allow)))


def fundamentals_gate(price: Column, mcap: Column, volume: Column, low: float = 20, high: float = 200, least: float = 1000) -> Column:
    """Why a company is passed over: no quote, a cap outside the range in crore,
    or too small a mean volume."""
    return F.when(price.isNull() & mcap.isNull(), "no quote").when(mcap.isNull() | (mcap < low) | (mcap > high), "mcap").when(volume.isNull() | (volume < least), "volume").otherwise("ok")


def board_tier() -> Column:
    return num.cap_tier(F.col("mcap_cr"))
