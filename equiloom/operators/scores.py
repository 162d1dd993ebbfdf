"""Rule scores: distress, alpha, the five panels and their judge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.functions import num


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _steps(x: Column, *steps: tuple, high: bool = True) -> Column:
    """Points of the first bound that x reaches; none for null."""
    out = F.lit(0)
    for bound, points in reversed(steps):
        out = F.when(x >= bound if high else x <= bound, points).otherwise(out)
    return out


def _if(c: Column, points) -> Column:
    return F.when(c, points).otherwise(0)


def distress_flags() -> Column:
    """Core flags first, then the seed mark and the softer ones."""
    c = F.col
    named = [
        ("seed", c("seed")), ("neg_eps_yoy", c("eps_yoy") < 0), ("stressed_pe", c("pe") >= 80), ("drawdown", c("drawdown_pct") <= -20),
        ("sales_pressure", c("sales_yoy") < -15), ("surveillance", c("stage").isNotNull()), ("sales_gt_eps", c("sales_yoy") > c("eps_yoy") + 10),
        ("bounce", c("bounce_pct") >= 15), ("cheap_pe", (c("pe") > 0) & (c("pe") <= 18)), ("small_cap", c("mcap_cr") <= 500),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in named]))


def distress(df: DataFrame) -> DataFrame:
    """distress_score, flags and reason from price, growth, valuation and size."""
    c = F.col
    core = F.coalesce((c("eps_yoy") < 0) | F.lit(False), F.lit(False))
    for t in (c("pe") >= 80, c("drawdown_pct") <= -20, c("sales_yoy") < -15, c("stage").isNotNull()):
        core = core | F.coalesce(t, F.lit(False))
    dd = c("drawdown_pct")
    sales = F.when(c("sales_yoy") > c("eps_yoy") + 10, 18).when(c("sales_yoy") >= 0, 10).when(c("sales_yoy") > -15, 5).otherwise(0)
    pe = F.when(c("pe") >= 900, 6).when(c("pe") >= 80, 4).when((c("pe") > 0) & (c("pe") <= 18), 8).otherwise(0)
    cap = F.when(c("mcap_cr") <= 500, 8).when(c("mcap_cr") <= 2000, 4).when(c("mcap_cr") >= 10000, -4).otherwise(0)
    parts = [
        F.when(c("seed"), 30).otherwise(22), F.when((dd >= -70) & (dd <= -20), 18).when((dd >= -85) & (dd < -70), 10).when((dd > -20) & (dd <= -10), 6).otherwise(0),
        _steps(c("bounce_pct"), (80, 22), (40, 16), (15, 10), (5, 5)), sales,
        F.when(c("returns_pct") <= -25, -6).otherwise(_steps(c("returns_pct"), (40, 22), (10, 12), (0, 5))), pe, _if((c("pb") > 0) & (c("pb") <= 3.5), 6), cap, -F.coalesce(c("stage"), F.lit(0)),
    ]
    score = F.when(~core & ~c("seed"), 0.0).otherwise(num.js_round(num.clamp(_sum(parts).cast("double"), 0, 100), 1))
    flags = distress_flags()
    return df.select("*", score.alias("distress_score"), F.array_join(flags, ",").alias("distress_flags"), F.when(~core & ~c("seed"), "no_distress").otherwise(F.array_join(F.slice(flags, 1, 4), "|")).alias("distress_reason"))


def alpha(moat: Column, growth: Column, smart: Column, mcap: Column) -> Column:
    return F.least(F.lit(200), 10 + 10 * moat + 20 * growth + _if(smart, 50) + _if(mcap < 100, 15))


def panels(e: DataFrame) -> DataFrame:
    """Technician, fundamentalist, newsdesk, bull and bear scores of evidence."""
    c = F.col
    net = c("positive") - c("negative")
    up, down = c("price_vs_sma_pct") > 1, c("price_vs_sma_pct") < -1
    fit = lambda *parts: num.clamp(_sum([p.cast("double") if isinstance(p, Column) else F.lit(float(p)) for p in parts]), 0, 100)
    return e.select(
        "*",
        fit(50, F.when(c("rvol") >= 3, 25).when(c("rvol") >= 1.5, 12).when(c("rvol") < 1, -10).otherwise(0), _if(c("position_pct") >= 85, 15), F.when(up, 10).when(down, -12).otherwise(0), _if(c("day_range_position_pct") >= 70, 8)).alias("technician"),
        fit(50, F.when(c("upside_pct") >= 15, 25).when(c("upside_pct") >= 8, 15).when(c("upside_pct") <= 0, -15).otherwise(0), F.when(c("buy_pct") >= 70, 12).when(c("buy_pct") < 45, -10).otherwise(0)).alias("fundamentalist"),
        fit(50, F.when(net >= 2, 20).when(net <= -2, -20).otherwise(0), _if(c("headlines") == 0, -5)).alias("newsdesk"),
        fit(40, F.when(c("rvol") >= 1.5, F.least(F.lit(20.0), num.js_round(c("rvol") * 5))).otherwise(0), _if(c("position_pct") >= 85, 18), _if(c("price_vs_sma_pct") > 0, 8), _if(c("day_range_position_pct") >= 65, 8),
            _if(c("upside_pct") >= 10, 12), _if(c("buy_pct") >= 80, 10), _if(net > 0, 6), F.when(c("window_return_pct") > 0, F.least(F.lit(10.0), num.js_round(c("window_return_pct") / 2))).otherwise(0)).alias("bull"),
        fit(35, _if(c("rvol") < 1, 12), _if(c("position_pct") < 30, 18), _if(down, 12), _if(c("upside_pct") <= 0, 15), _if(c("buy_pct") < 55, 10), _if(c("pct_from_high") <= -20, 10), _if(c("sell_pct") >= 25, 8), _if(net < 0, 8), _if(c("day_range_position_pct") < 35, 8)).alias("bear"),
    )


def judge(p: DataFrame, fire_at: int = 7) -> DataFrame:
    """Verdict, confidence, winner, and whether a signal fires."""
    c = F.col
    net = c("bull") - c("bear")
    buy = (net >= 25) & ((c("position_pct") >= 60) | (c("rvol") >= 3))
    verdict = F.when(buy, "BUY").when(net <= -15, "AVOID").otherwise("WATCH")
    base = num.clamp(num.js_round(4 + net / 15), 1, 10)
    conf = F.when(verdict == "BUY", F.greatest(base, F.lit(7.0))).otherwise(F.least(base, F.lit(6.0))).cast("int")
    return p.select("*", verdict.alias("verdict"), conf.alias("confidence"), F.when(net > 0, "bull").when(net < 0, "bear").otherwise("tie").alias("winner"), ((verdict == "BUY") & (conf >= fire_at)).alias("fired"))


# What a distress flag is called.
FLAG_LABELS = {
    "seed": "Seed monitor", "neg_eps_yoy": "EPS ↓ YoY", "neg_np_yoy": "Profit ↓ YoY", "stressed_pe": "Stressed P/E", "drawdown": "52w drawdown", "sales_pressure": "Sales pressure",
    "surveillance": "ASM/GSM", "sales_gt_eps": "Sales > EPS (turn)", "bounce": "Off lows", "cheap_pe": "Cheap P/E", "small_cap": "≤₹500 Cr",
}


def flag_labels(flags: Column) -> Column:
    """Labels of an array of flags; a flag without one is its own."""
    table = F.create_map(*[F.lit(x) for k, v in FLAG_LABELS.items() for x in (k, v)])
    return F.transform(flags, lambda f: F.coalesce(F.try_element_at(table, f), f))


def distress_list(companies: DataFrame, kind: str, seeds: DataFrame, holdings: DataFrame) -> DataFrame:
    """Companies of a list: `seeds`, seeds that are held, or a whole market
    (`nse`, `nse-sme`)."""
    market = {"nse": "NSE", "nse-sme": "NSE SME"}.get(kind)
    if market:
        return companies.where(F.col("market") == market)
    upper = lambda df: df.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    wanted = upper(seeds)
    wanted = wanted.join(upper(holdings), "ticker", "left_semi") if kind == "holdings" else wanted
    return companies.join(wanted, "ticker", "left_semi")


def distress_rows(scored: DataFrame, holdings: DataFrame, companies: DataFrame, seeds: DataFrame, funds: DataFrame) -> DataFrame:
    """Scored companies (ticker, distress_score, distress_flags: an array, price,
    mcap_cr and other figures) with the holding's name and sector before the
    company's, the company's price and cap where the score has none, and whether
    they are held, seeds, or in a fund's list (ticker, list)."""
    h = holdings.select("ticker", F.col("name").alias("h_name"), F.col("market").alias("h_market"), F.col("sector").alias("h_sector")).dropDuplicates(["ticker"]).withColumn("held", F.lit(True))
    c = companies.select("ticker", F.col("name").alias("c_name"), F.col("market").alias("c_market"), F.col("sector").alias("c_sector"), "website", F.col("mcap_cr").alias("c_mcap"), F.col("price").alias("c_price"))
    s = seeds.select("ticker").distinct().withColumn("seeded", F.lit(True))
    f = funds.groupBy("ticker").agg(F.array_sort(F.collect_set("list")).alias("fund_lists"))
    j = scored.join(h, "ticker", "left").join(c, "ticker", "left").join(s, "ticker", "left").join(f, "ticker", "left")
    return j.withColumns({
        "name": F.coalesce("h_name", "c_name"), "market": F.coalesce("c_market", "h_market", F.lit("NSE")), "sector": F.coalesce("h_sector", "c_sector"),
        "has_hold": F.col("held").isNotNull(), "has_distress": F.col("seeded").isNotNull(), "fund_lists": F.coalesce("fund_lists", F.array().cast("array<string>")),
        "flag_labels": flag_labels(F.col("distress_flags")), "mcap_cr": F.coalesce("mcap_cr", "c_mcap"), "price": F.coalesce("price", "c_price"),
    }).drop("h_name", "h_market", "h_sector", "held", "c_name", "c_market", "c_sector", "c_mcap", "c_price", "seeded")
