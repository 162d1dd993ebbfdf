"""The evidence on a company as one record: prices, range, technicals, analysts
and news, each figure guarded, with the list of what is missing.

What is gathered for a company is its bars of five weeks and up to eight
headlines; all else is expressions on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.functions import num, text

DAYS, HEADLINES, RECENT = 35, 8, 6
GAPS = ("quote", "daily_ohlc", "rvol", "sma20", "analyst", "news")


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _pct(a: Column, b: Column, k: int) -> Column:
    """Change from b to a in percent; null unless b is above zero."""
    return F.when(b > 0, num.js_round((a - b) / b * 100, k))


def gather(companies: DataFrame, daily: DataFrame, quotes: DataFrame, analysts: DataFrame, news: DataFrame, as_of: str) -> DataFrame:
    """Companies (ticker, name, market, sector, sub_sector, mcap_cr) with bars of
    five weeks up to a day (symbol, date, open, high, low, close, volume), a quote
    (ticker, price, prev, open, high, low, volume, avg_volume, change_pct), an
    analysts' row (ticker, consensus, targets, counts) and headlines (ticker,
    place, title, link, published)."""
    day = F.lit(as_of).cast("date")
    bars = daily.where((F.col("date") <= day) & (F.col("date") >= F.date_sub(day, DAYS))).groupBy(F.col("symbol").alias("ticker"))
    bars = bars.agg(F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", "volume"))).alias("bars"))
    tone = text.sentiment(F.col("title"))
    said = news.where((F.col("place") < HEADLINES) & (F.trim("title") != "")).groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("place", F.trim("title").alias("title"), "link", "published"))).alias("headlines"),
        F.count_if(tone > 0).alias("positive"), F.count_if(tone < 0).alias("negative"), F.count_if(tone == 0).alias("neutral"),
    )
    one = lambda df, name: df.select("ticker", F.struct(*[c for c in df.columns if c != "ticker"]).alias(name)).dropDuplicates(["ticker"])
    return companies.join(bars, "ticker", "left").join(one(quotes, "quote"), "ticker", "left").join(one(analysts, "panel"), "ticker", "left").join(said, "ticker", "left")


def evidence(gathered: DataFrame, news_known: bool = True) -> DataFrame:
    """One struct by group of figures and `data_gaps`, in order. A quote comes
    before the last bar's close; figures that need both or a history are null
    without."""
    bars = F.coalesce("bars", F.array().cast("array<struct<date:date,open:double,high:double,low:double,close:double,volume:double>>"))
    x = gathered.withColumn("bars", bars).withColumn("n", F.size("bars"))
    enough = F.col("n") >= 2
    last, before = F.try_element_at("bars", F.lit(-1)), F.try_element_at("bars", F.lit(-2))
    when = lambda c: F.when(enough, c)
    q = lambda f: F.col(f"quote.{f}")
    most = lambda f, up: F.array_max(F.transform("bars", lambda b: b[f])) if up else F.array_min(F.transform("bars", lambda b: b[f]))
    x = x.withColumns({
        "live": F.coalesce(q("price"), when(last["close"])), "prev_close": F.coalesce(q("prev"), when(before["close"])), "day_open": F.coalesce(when(last["open"]), q("open")),
        "day_high": F.coalesce(when(last["high"]), q("high")), "day_low": F.coalesce(when(last["low"]), q("low")), "high": when(most("high", True)), "low": when(most("low", False)),
        "volume": F.coalesce(F.when(when(last["volume"]) > 0, last["volume"]), F.when(q("volume") > 0, q("volume")), when(last["volume"]), q("volume")),
        "closes": F.transform("bars", lambda b: b["close"]), "volumes": F.transform("bars", lambda b: b["volume"]),
    })
    own = F.when(F.col("n") >= 21, _mean(F.slice("volumes", F.col("n") - 20, F.lit(20)))).when(F.col("n") > 1, _mean(F.slice("volumes", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))))
    sma = F.when(F.col("n") >= 20, _mean(F.slice("closes", F.greatest(F.col("n") - 19, F.lit(1)), F.lit(20))))
    x = x.withColumns({"avg_volume": F.coalesce(F.when(own > 0, own), F.when(q("avg_volume") > 0, q("avg_volume")), own), "sma20": sma})
    c = F.col
    spread = c("high") > c("low")
    first = F.get("closes", F.lit(0))
    a = lambda f: F.col(f"panel.{f}")
    counts = {f: F.coalesce(a(f), F.lit(0)) for f in ("strong_buy", "buy", "hold", "sell", "strong_sell")}
    total = counts["strong_buy"] + counts["buy"] + counts["hold"] + counts["sell"] + counts["strong_sell"]
    share = lambda *fs: F.when(total > 0, num.js_round(sum((counts[f] for f in fs), F.lit(0)) / total * 100, 1))
    x = x.withColumns({
        "day_change_pct": F.coalesce(_pct(c("live"), c("prev_close"), 2), q("change_pct")),
        "pct_from_high": F.when(spread, num.js_round((c("live") / c("high") - 1) * 100, 1)), "position_pct": F.when(spread, num.js_round((c("live") - c("low")) / (c("high") - c("low")) * 100, 1)),
        "rvol": F.when((c("volume") > 0) & (c("avg_volume") > 0), num.js_round(c("volume") / c("avg_volume"), 2)), "price_vs_sma_pct": _pct(c("live"), c("sma20"), 1),
        "window_return_pct": F.when((c("n") >= 2) & (first > 0), num.js_round((F.try_element_at("closes", F.lit(-1)) / first - 1) * 100, 1)),
        "day_range_position_pct": F.when(c("day_high") > c("day_low"), num.js_round((c("live") - c("day_low")) / (c("day_high") - c("day_low")) * 100, 1)),
        "upside_pct": _pct(a("target_mean"), c("live"), 1),
    })
    trend = F.when(c("price_vs_sma_pct") > 2, "up").when(c("price_vs_sma_pct") < -2, "down").when(c("price_vs_sma_pct").isNotNull(), "sideways")
    two = lambda f, name=None: num.js_round(c(f), 2).alias(name or f)
    zero = lambda f: F.coalesce(f, F.lit(0)).alias(f)
    missing = {"quote": c("quote").isNull(), "daily_ohlc": ~enough, "rvol": c("rvol").isNull(), "sma20": c("price_vs_sma_pct").isNull(), "analyst": c("panel").isNull(), "news": F.lit(not news_known)}
    headlines = F.coalesce("headlines", F.array().cast("array<struct<place:int,title:string,link:string,published:date>>")) if "headlines" in gathered.columns else None
    return x.select(
        F.upper("ticker").alias("symbol"), F.coalesce("name", "ticker").alias("name"), F.lower(num.cap_tier(c("mcap_cr"))).alias("cap_segment"), F.coalesce(F.nullif("sector", F.lit("")), F.nullif("sub_sector", F.lit(""))).alias("sector"),
        F.coalesce("market", F.lit("NSE")).alias("market"),
        F.struct(two("live"), two("day_open"), two("day_high"), two("day_low"), two("prev_close"), "day_change_pct", num.js_round(c("volume"), 0).alias("volume")).alias("price"),
        F.struct(two("high"), two("low"), "pct_from_high", "position_pct").alias("range_52w"),
        F.struct("rvol", "price_vs_sma_pct", "window_return_pct", two("high", "swing_high"), two("low", "swing_low"), "day_range_position_pct", trend.alias("trend")).alias("technicals"),
        F.struct(text.nonempty(a("consensus")).alias("consensus"), F.coalesce(F.when(a("num_analysts") != 0, a("num_analysts")), F.when(total > 0, total)).alias("num_analysts"), share("strong_buy", "buy").alias("buy_pct"), share("hold").alias("hold_pct"),
                 share("sell", "strong_sell").alias("sell_pct"), a("target_mean").alias("target_mean"), a("target_low").alias("target_low"), a("target_high").alias("target_high"), "upside_pct").alias("analyst"),
        F.struct(F.size(headlines).alias("total"), zero("positive"), zero("negative"), zero("neutral"), F.transform(F.slice(headlines, 1, RECENT), lambda h: h.dropFields("place")).alias("recent")).alias("news"),
        F.array_compact(F.array(*[F.when(missing[g], F.lit(g)) for g in GAPS])).alias("data_gaps"),
    )
