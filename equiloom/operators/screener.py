"""A screener request as one plan: filters, facet counts, a page, its figures.

Lists, signals and figures meet the master once; every chip is a bit of `tags`.
Totals and counts are taken in shares of the companies, each of which hands on
only the rows that the page may hold, so one scan of the master gives all and no
task gets more than SHARES pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num, text
from equiloom.operators import themes as TH
from equiloom.operators.company import GAPS, gap_filter, gap_flags, keyword_search
from equiloom.operators.fundamentals import all_green

SHARES = 64
KINDS = ("bb", "tq", "ema")
LISTS = ("hold", "edge", "note", "distress", "fund_a", "fund_b")
FUNDS = ("fund_a", "fund_b")
TAGS = (*KINDS, *LISTS, "sme", "green", "dots_pending", "stub")
GAP_KINDS = ("any", "price", "mcap", "sector", "sub_sector", "about", "web", "metrics")


@dataclass(frozen=True)
class Request:
    """What is asked for. `market` may also name a list; `chips` are lists, sme
    and green; `signals` are kinds, any or `every` of them."""

    market: str = "All"
    sector: str = "All"
    cap: str = "All"
    missing: str = ""
    search: str = ""
    search_every: bool = False
    chips: frozenset = frozenset()
    signals: frozenset = frozenset()
    every: bool = False
    prefer: bool = False
    scan: bool = False
    themes: dict = field(default_factory=dict)
    custom: str = ""
    sort: str = "sector"
    descending: bool = False
    page: int = 1
    size: int = 100


def has(tag: str) -> Column:
    return F.col("tags").bitwiseAND(1 << TAGS.index(tag)) != 0


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def universe(master: DataFrame, signals: DataFrame, lists: DataFrame, quarter: DataFrame, live: DataFrame) -> DataFrame:
    """The master (ticker, name, market, sector, sub_sector, mcap_cr, price,
    website, about, search_text) with `tags`; a struct of values for each kind
    of signal (ticker, kind, signal_date, value) or null; the quarter's figures
    (ticker, forward_pe, eps_yoy, sales_yoy); live price and cap (ticker, price,
    mcap_cr); and a row for each ticker of a fund's list (ticker, list) that the
    master lacks."""
    of = lambda k: F.max(F.when(F.col("kind") == k, F.struct("signal_date", "value"))).alias(k)
    sig = signals.groupBy("ticker").agg(*map(of, KINDS))
    bit = reduce(lambda c, k: F.when(F.col("list") == k, 1 << TAGS.index(k)).otherwise(c), LISTS, F.lit(0))
    held = lists.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.bit_or(bit).alias("listed"))
    funds = sum(1 << TAGS.index(k) for k in FUNDS)
    j = master.withColumn("known", F.lit(True)).join(held, "ticker", "full").where(F.col("known") | (F.col("listed").bitwiseAND(funds) != 0))
    j = j.join(sig, "ticker", "left").join(quarter.withColumn("scanned", F.lit(True)), "ticker", "left")
    j = j.join(live.select("ticker", F.col("price").alias("live_price"), F.col("mcap_cr").alias("live_mcap")), "ticker", "left")
    flags = {
        **{k: F.col(k).isNotNull() for k in KINDS}, "sme": F.coalesce(F.col("market").rlike("(?i)\\bSME\\b"), F.lit(False)), "green": all_green(),
        "dots_pending": F.col("scanned").isNull(), "stub": F.col("known").isNull(),
    }
    tags = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << TAGS.index(k)).otherwise(0) for k, c in flags.items()], F.coalesce("listed", F.lit(0)))
    return gap_flags(j.withColumn("tags", tags).withColumns({"name": F.coalesce("name", "ticker"), "search_text": F.coalesce("search_text", F.lower(F.concat_ws(" ", "ticker", "name")))}).drop("known", "listed", "scanned"))


def _market(r: Request) -> Column:
    if r.market in LISTS:
        return has(r.market)
    if r.market == "All":
        return ~has("stub")
    wide = r.market == "NSE" and (r.scan or bool(r.search.strip()))
    return ~has("stub") & (F.col("market").isin("NSE", "NSE SME") if wide else F.col("market") == r.market)


def _slice(r: Request) -> Column:
    some = [F.col("sector") == r.sector] if r.sector != "All" else []
    some += [num.cap_tier(F.col("mcap_cr")) == r.cap] if r.cap != "All" else []
    return F.coalesce(_all(some), F.lit(False))


def hits(r: Request) -> Column:
    """Rows of the request, of a universe with `theme_hit` where it scans."""
    watching = bool(r.chips & {*LISTS, "sme"})
    funds = [k for k in FUNDS if k in r.chips]
    fund = _all(map(has, funds))
    if funds:  # a fund's companies are shown whatever else is asked for but notes
        return F.coalesce(_all([fund, *([has("note")] if "note" in r.chips else [])]), F.lit(False))
    themed = r.scan and bool(r.themes or r.custom.strip())
    anywhere = ~has("stub") if watching and r.market not in LISTS else _market(r)
    out = anywhere & _slice(r)
    if r.missing:
        out = (out | _any(map(has, FUNDS))) & gap_filter(r.missing)
    if r.search.strip():
        out = out & keyword_search(r.search, r.search_every)
    if r.scan:
        out = out & (F.col("theme_hit") if themed else F.lit(False))
    if r.signals:
        out = out & (_all if r.every and len(r.signals) > 1 else _any)([has(k) for k in KINDS if k in r.signals])
    if themed:  # held companies of the themes come back
        out = out | (has("hold") & F.col("theme_hit") & anywhere)
    return F.coalesce(out & _all(has(k) for k in ("green", "sme", "hold", "distress", "edge", "note") if k in r.chips), F.lit(False))


def pool(r: Request) -> Column:
    """Rows whose facets are counted: no chip and no signal applies."""
    watching = bool(r.chips & {*LISTS, "sme"}) and r.market not in LISTS
    wide = F.col("market").isin("NSE", "NSE SME") if r.market == "NSE" else F.col("market") == r.market
    place = ~has("stub") if watching or r.market == "All" else _market(r) if r.market in LISTS else ~has("stub") & wide
    themed = r.scan and bool(r.themes or r.custom.strip())
    return F.coalesce(place & _slice(r) & (F.col("theme_hit") if themed else F.lit(True)), F.lit(False))


def placed(df: DataFrame, key: str, order: list[tuple[str, bool]], number: int, size: int, hit: Column, counts: dict[str, Column]) -> DataFrame:
    """Candidates of a page, with `shown` (whether a row is on it), `place`,
    `total`, `pages`, `page` (clamped to the last) and the counts over all rows.
    The order (column, descending) must be total and free of nulls. A share of
    the rows hands on its first `number` pages and its last one."""
    front = [F.desc("_hit"), *(F.desc(c) if d else F.asc(c) for c, d in order)]
    back = [F.desc("_hit"), *(F.asc(c) if d else F.desc(c) for c, d in order)]
    share = Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(SHARES)))
    every = {"total": F.col("_hit"), **counts}
    x = df.withColumn("_hit", hit)
    x = x.select("*", F.row_number().over(share.orderBy(*front)).alias("_a"), F.row_number().over(share.orderBy(*back)).alias("_b"), *[F.count_if(c).over(share).alias(f"_n_{k}") for k, c in every.items()])
    x = x.where((F.col("_hit") & ((F.col("_a") <= number * size) | (F.col("_b") <= size))) | (F.col("_a") == 1))
    whole = Window.partitionBy(F.lit(0))  # SHARES * (number + 1) * size rows at most
    sums = [F.sum(F.when(F.col("_a") == 1, F.col(f"_n_{k}"))).over(whole).alias(k) for k in every]
    x = x.select(*df.columns, "_hit", *sums, F.row_number().over(whole.orderBy(*front)).alias("_f"), F.row_number().over(whole.orderBy(*back)).alias("_l"))
    x = x.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int"))
    x = x.withColumn("page", F.least(F.lit(number), "pages"))
    x = x.withColumn("place", F.when(F.col("page") == number, F.col("_f")).otherwise(F.col("total") - F.col("_l") + 1).cast("long"))
    start = (F.col("page") - 1) * size
    return x.withColumn("shown", F.col("_hit") & (F.col("place") > start) & (F.col("place") <= start + size)).drop("_hit", "_f", "_l")


def respond(rows: DataFrame, r: Request) -> DataFrame:
    """One row: rows (an array in order), total, page, pages, page_size, counts
    of the facets, gaps, the latest session of each kind of signal and whether
    only rows with signals are shown. `rows` is a universe."""
    number, size = max(1, r.page), min(200, max(10, r.size))
    themed = r.scan and bool(r.themes or r.custom.strip())
    none = F.array().cast("array<string>")
    if themed:
        rows = TH.theme_columns(rows, "search_text", r.themes, r.custom)
    else:
        rows = rows.withColumns({"clauses": none, "highlights": text.matched_terms(F.col("search_text"), r.search) if r.search.strip() else none})
    hit, signal = hits(r), _any(map(has, KINDS))
    if r.prefer and r.scan and not r.signals and not r.chips & {*FUNDS}:
        some = rows.agg(F.coalesce(F.max(hit & signal), F.lit(False)).alias("_some"))
        rows = rows.crossJoin(F.broadcast(some))  # one row
        hit = hit & (signal | ~F.col("_some"))
    sort = {"int": 0, "double": 0.0, "bigint": 0, "string": ""}
    kind = dict(rows.dtypes)[r.sort]
    rows = rows.withColumns({"_sort": F.coalesce(r.sort, F.lit(sort.get(kind, 0.0))), "_held": F.when(has("hold"), 0).otherwise(1) if themed else F.lit(0)})
    gaps = (~has("stub") & F.coalesce(_market(Request(market=r.market)), F.lit(False))) | _any(map(has, FUNDS)) if r.missing else hit
    facets = {f"n_{k}": pool(r) & has(k) for k in (*KINDS, "hold", "edge", "sme", "note", "distress", "green", "dots_pending")} | {f"n_{k}": has(k) for k in FUNDS}
    counts = facets | {f"gap_n_{k}": gaps & gap_filter(k) for k in GAP_KINDS} | {"with_signal": hit & signal}
    x = placed(rows, "ticker", [("_held", False), ("_sort", r.descending), ("ticker", False)], number, size, hit, counts)
    pending = has("dots_pending")
    row = F.struct(
        "place", "ticker", "name", "market", "sector", "sub_sector", F.coalesce("live_price", "price").alias("price"), F.coalesce("live_mcap", "mcap_cr").alias("mcap_cr"), "website", "about",
        F.col("clauses").alias("matched"), "highlights", *[has(k).alias(f"has_{k}") for k in (*KINDS, *LISTS)], *KINDS,
        *[F.when(~pending, F.col(c)).alias(c) for c in ("forward_pe", "eps_yoy", "sales_yoy")],
        F.struct(*[_gap(g).alias(g) for g in GAPS], pending.alias("dots_pending")).alias("missing"),
    )
    one = lambda c: F.max(c).alias(c)
    out = x.agg(
        F.array_sort(F.collect_list(F.when(F.col("shown"), row))).alias("rows"), one("total"), one("page"), one("pages"), F.lit(size).alias("page_size"),
        F.struct(*[F.max(c).alias(c[2:]) for c in facets]).alias("signals"), F.struct(*[F.max(f"gap_n_{k}").alias(k) for k in GAP_KINDS]).alias("gaps"), one("with_signal"),
    )
    preferred = F.lit(r.prefer and r.scan and not r.signals) & (F.col("total") > 0) & (F.col("with_signal") == F.col("total"))
    return out.withColumn("breakouts_preferred", preferred).drop("with_signal").withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (("total", 0), ("page", 1), ("pages", 1))})


def _gap(g: str) -> Column:
    """A gap of the row as shown: live figures count."""
    live = {"price": "live_price", "mcap": "live_mcap"}
    return F.col(f"gap_{g}") & F.col(live[g]).isNull() if g in live else F.col(f"gap_{g}")


def page_json(response: DataFrame) -> DataFrame:
    """The response as one JSON text."""
    return response.select(F.to_json(F.struct(*response.columns)).alias("json"))


def missing_rows(rows: DataFrame, market: str, kind: str) -> DataFrame:
    """Companies of a market, and of the funds' lists wherever they trade, that
    have a gap. `rows` is a universe."""
    here = (~has("stub") if market == "All" else ~has("stub") & (F.col("market") == market)) | _any(map(has, FUNDS))
    return rows.where(F.coalesce(here, F.lit(False)) & gap_filter(kind))


def export_lines(rows: DataFrame, full: bool, web: Column, screener: Column, chart: Column) -> DataFrame:
    """A line of CSV for each row, its heading first; `place` orders them by
    name and code. Links are given, as columns of the rows."""
    one = lambda c: F.when(c, "1").otherwise("0")
    text_of = lambda c: text.csv_escape(c.cast("string"))
    if full:
        heads = ("ticker", "name", "market", "sector", "sub_sector", "price", "mcap_cr", "website", *(f"missing_{g}" for g in GAPS), "screener", "tradingview")
        cells = [*map(F.col, heads[:7]), web, *[one(F.col(f"gap_{g}")) for g in GAPS], screener, chart]
    else:
        heads, cells = ("company name", "symbol", "website"), [F.col("name"), F.col("ticker"), web]
    lines = rows.select(F.lit(1).alias("place"), F.lower("name").alias("by_name"), F.col("ticker").alias("by_ticker"), F.concat_ws(",", *[F.coalesce(text_of(c), F.lit("")) for c in cells]).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit("").alias("by_name"), F.lit("").alias("by_ticker"), F.lit(",".join(heads)).alias("line"))
    return head.unionByName(lines).orderBy("place", "by_name", "by_ticker")
