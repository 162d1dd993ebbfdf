"""Signals on the last bar: breakout, trend quality, mean stack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num
from equiloom.operators import indicators as I


def breakout(bars: DataFrame, n: int = 50) -> DataFrame:
    """NEW_BREAKOUT: the last close is above the upper band, the one before was not."""
    b = I.bollinger(bars, n)
    w = I.by_symbol()
    b = b.select("*", F.lag("close").over(w).alias("_c"), F.lag("upper").over(w).alias("_u"))
    last = I.last_row(b).where((F.col("close") > F.col("upper")) & (F.col("_c") <= F.col("_u")))
    return last.select("symbol", F.lit("NEW_BREAKOUT").alias("signal"), F.col("close").alias("price"), num.js_round(F.col("upper"), 2).alias("upper_band"), F.col("date").alias("signal_date"))


def trend_quality(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Eight gates on the last bar, a crossover of relative strength, and a
    score of four parts of 25 at most."""
    w = I.by_symbol()
    a = I.atr(I.aligned(bars, benchmark)).drop("tr")
    x = I.adx(I.rsi(a, 21), 13).drop("tr")
    x = x.select("*", I.relative_strength(52).alias("rs52"), I.relative_strength(13).alias("rs13"), I.rolling_mean(F.col("close"), 13).alias("sma13"), I.rolling_mean(F.col("volume"), 13).alias("vol13"))
    x = x.select("*", F.lag("rs52").over(w).alias("p52"), F.lag("rs13").over(w).alias("p13"))
    # A symbol's last row and its bars for the fold, from the same sorted rows.
    row = F.struct("date", "close", "volume", "rsi", "adx", "di_plus", "di_minus", "rs52", "rs13", "sma13", "vol13", "p52", "p13")
    both = x.groupBy("symbol").agg(F.max_by(row, "date").alias("r"), F.array_sort(F.collect_list(F.struct("date", "high", "low", "close", "atr"))).alias("bars"))
    last = both.select("symbol", "r.*", I.last_supertrend(F.col("bars")).alias("st"))
    gates = (
        (F.col("rsi") > 55) & (F.col("close") > F.col("st.line")) & (F.col("adx") > 20) & (F.col("di_plus") > F.col("di_minus"))
        & (F.col("close") > F.col("sma13")) & (F.col("volume") > F.col("vol13")) & (F.col("rs52") > 0) & (F.col("rs13") > 0)
    )
    long_ = ((F.col("p52") < -0.15) & (F.col("rs52") > 0.005)) | ((F.col("p52") < 0) & (F.col("rs52") > 0.02))
    short = ((F.col("p13") < -0.005) & (F.col("rs13") > 0.005)) | ((F.col("p13") < 0.01) & (F.col("rs13") > 0.02))
    cap = lambda v: num.clamp(v, 0, 25)
    score = cap((F.col("rsi") - 55) * 2.5) + cap((F.col("adx") - 20) * 1.25) + cap((F.col("di_plus") - F.col("di_minus")) * 2) + cap((F.col("rs52") + F.col("rs13")) * 1000)
    kind = F.when(long_ & short, "both").when(long_, "long").when(short, "short")
    return last.select("symbol", F.coalesce(gates, F.lit(False)).alias("gates"), kind.alias("crossover"), num.js_round(score, 2).alias("score"), F.col("date").alias("signal_date"))


def mean_stack(bars: DataFrame, spans: tuple[int, ...] = (10, 20, 50, 200)) -> DataFrame:
    """The last close against exponential means; `stacked` if above them all."""
    s = I.series(bars).select("symbol", "bars", F.transform("bars", lambda b: b["close"]).alias("c"))
    last = s.select("symbol", F.element_at("c", -1).alias("price"), F.element_at("bars", -1)["date"].alias("signal_date"), F.size("c").alias("n"), *[I.last_ema(F.col("c"), k).alias(f"e{k}") for k in spans])
    above = reduce(lambda p, q: p & q, [F.col("price") > F.col(f"e{k}") for k in spans])
    return last.select("symbol", "price", "signal_date", *[num.js_round(F.col(f"e{k}"), 4).alias(f"ema{k}") for k in spans], F.coalesce((F.col("n") >= max(spans)) & above, F.lit(False)).alias("stacked"))


def merge_flags(bb: DataFrame, tq: DataFrame, ema: DataFrame) -> DataFrame:
    """Full outer merge of three signal tables by ticker."""
    mark = lambda df, c: df.select("ticker").distinct().withColumn(c, F.lit(True))
    j = mark(bb, "bb").join(mark(tq, "tq"), "ticker", "full").join(mark(ema, "ema"), "ticker", "full")
    return j.select("ticker", *[F.coalesce(c, F.lit(False)).alias(f"has_{c}") for c in ("bb", "tq", "ema")])


def features(bars: DataFrame) -> DataFrame:
    """Last-bar features: relative volume, window return, swings, 3-month return."""
    w = I.by_symbol()
    past = Window.partitionBy("symbol").orderBy("date")
    x = bars.select(
        "*", F.avg("volume").over(past.rowsBetween(-20, -1)).alias("v20"), F.max("high").over(past.rowsBetween(-51, 0)).alias("hi"), F.min("low").over(past.rowsBetween(-51, 0)).alias("lo"),
        F.first("close").over(past.rowsBetween(-20, 0)).alias("c0"), F.first("close").over(past.rowsBetween(-63, 0)).alias("c63"), I.rolling_mean(F.col("close"), 20).alias("sma"), F.lag("close").over(w).alias("prev"),
    )
    return I.last_row(x).select(
        "symbol", "date", "close",
        num.js_round(num.div(F.col("volume"), F.col("v20")), 2).alias("rvol"),
        num.js_round((F.col("close") / F.col("c0") - 1) * 100, 2).alias("window_return_pct"),
        num.js_round((F.col("close") / F.col("c63") - 1) * 100, 2).alias("return_3m"),
        num.js_round((F.col("close") / F.col("hi") - 1) * 100, 1).alias("pct_from_high"),
        num.js_round((F.col("close") / F.col("lo") - 1) * 100, 1).alias("bounce_pct"),
        num.js_round(num.div(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")) * 100, 1).alias("position_pct"),
        num.js_round((F.col("close") / F.col("sma") - 1) * 100, 2).alias("price_vs_sma_pct"),
        num.js_round((F.col("close") / F.col("prev") - 1) * 100, 2).alias("day_change_pct"),
        num.js_round(num.div(F.col("close") - F.col("low"), F.col("high") - F.col("low")) * 100, 1).alias("day_range_position_pct"),
    )
