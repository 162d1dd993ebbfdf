"""Indicators over price bars: windows per symbol, folds for recursions.

Frames that are not yet full give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def full(value: Column, agg, n: int) -> Column:
    """`agg` over the last n rows, null before n values are there."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def rolling_mean(x: Column, n: int) -> Column:
    return full(x, F.avg, n)


def rolling_sum(x: Column, n: int) -> Column:
    return full(x, F.sum, n)


def rolling_std(x: Column, n: int) -> Column:
    return full(x, F.stddev_samp, n)


def bollinger(df: DataFrame, n: int = 50, width: float = 2.0) -> DataFrame:
    m, s = rolling_mean(F.col("close"), n), rolling_std(F.col("close"), n)
    return df.select("*", m.alias("mid"), (m + width * s).alias("upper"), (m - width * s).alias("lower"))


def rsi(df: DataFrame, n: int = 21) -> DataFrame:
    """By simple means of gains and losses; the first change counts as none."""
    step = F.coalesce(F.col("close") - F.lag("close").over(by_symbol()), F.lit(0.0))
    a = df.withColumn("_g", F.greatest(step, F.lit(0.0))).withColumn("_l", F.greatest(-step, F.lit(0.0)))
    g, l = rolling_mean(F.col("_g"), n), rolling_mean(F.col("_l"), n)
    return a.withColumn("_a", g).withColumn("_b", l).withColumn("rsi", F.when(F.col("_b") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_a") / F.col("_b")))).drop("_g", "_l", "_a", "_b")


def true_range() -> Column:
    prev = F.lag("close").over(by_symbol())
    span = F.col("high") - F.col("low")
    return F.when(prev.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def atr(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("tr", true_range()).withColumn("atr", rolling_mean(F.col("tr"), n))


def adx(df: DataFrame, n: int = 13) -> DataFrame:
    """di_plus, di_minus and adx from rolling sums of directional movement."""
    w = by_symbol()
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    a = df.withColumn("tr", true_range()).withColumn("_i", F.row_number().over(w) - 1)
    a = a.withColumn("_u", F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0))).withColumn("_d", F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)))
    a = a.withColumn("_t", rolling_sum(F.col("tr"), n)).withColumn("_us", rolling_sum(F.col("_u"), n)).withColumn("_ds", rolling_sum(F.col("_d"), n))
    a = a.withColumn("di_plus", F.when(F.col("_t") > 0, 100 * F.col("_us") / F.col("_t"))).withColumn("di_minus", F.when(F.col("_t") > 0, 100 * F.col("_ds") / F.col("_t")))
    both = F.col("di_plus") + F.col("di_minus")
    a = a.withColumn("_x", F.when(both == 0, 0.0).otherwise(100 * F.abs(F.col("di_plus") - F.col("di_minus")) / both))
    return a.withColumn("adx", F.when(F.col("_i") >= 2 * n - 2, rolling_mean(F.col("_x"), n))).drop("_i", "_u", "_d", "_t", "_us", "_ds", "_x")


def aligned(df: DataFrame, benchmark: DataFrame, least: int = 65) -> DataFrame:
    """Bars with the benchmark's close of the same date (bench), for symbols
    with so many common dates."""
    j = df.join(benchmark.select("date", F.col("close").alias("bench")), "date")
    return j.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= least).drop("_n")


def relative_strength(n: int) -> Column:
    ratio = F.col("close") / F.col("bench")
    return ratio / F.lag(ratio, n).over(by_symbol()) - 1


def series(df: DataFrame) -> DataFrame:
    """One row a symbol: its bars as an array in date order. A symbol's history
    is bounded by its exchange's sessions."""
    return df.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "high", "low", "close", "atr") if "atr" in df.columns else F.struct("date", "high", "low", "close"))).alias("bars"))


def last_ema(closes: Column, n: int) -> Column:
    """Exponential mean whose seed is the mean of the first n; null under n."""
    k = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(closes, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    return F.when(F.size(closes) >= n, F.aggregate(F.slice(closes, n + 1, F.greatest(F.size(closes) - n, F.lit(0))), seed, lambda a, x: x * k + a * (1 - k)))


def last_supertrend(bars: Column, factor: float = 3.0) -> Column:
    """(direction, line) at the last bar; direction starts at -1."""
    start = F.struct(F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("l"), F.lit(-1).alias("d"), F.lit(None).cast("double").alias("c"))

    def step(s, b):
        mid = (b["high"] + b["low"]) / 2
        bu, bl = mid + factor * b["atr"], mid - factor * b["atr"]
        u = F.when(s["u"].isNull() | (bu < s["u"]) | (s["c"] > s["u"]), bu).otherwise(s["u"])
        l = F.when(s["l"].isNull() | (bl > s["l"]) | (s["c"] < s["l"]), bl).otherwise(s["l"])
        d = F.when(s["u"].isNull(), F.lit(-1)).when((s["d"] == -1) & (b["close"] > u), F.lit(1)).when((s["d"] == 1) & (b["close"] < l), F.lit(-1)).otherwise(s["d"])
        none = b["atr"].isNull()
        return F.struct(F.when(none, s["u"]).otherwise(u).alias("u"), F.when(none, s["l"]).otherwise(l).alias("l"), F.when(none, s["d"]).otherwise(d).alias("d"), b["close"].alias("c"))

    return F.aggregate(bars, start, step, lambda s: F.struct(s["d"].alias("direction"), F.when(s["d"] == 1, s["l"]).otherwise(s["u"]).alias("line")))


def last_row(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trim_stub(df: DataFrame, days: int = 6) -> DataFrame:
    """Drop a symbol's last bar if it follows the one before too closely."""
    gap = F.datediff("date", F.lag("date").over(by_symbol()))
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))) == 1
    return df.withColumn("_x", last & (gap < days)).where("not coalesce(_x, false)").drop("_x")


def clean(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["open", "high", "low", "close"]).fillna(0, ["volume"])


def latest_session(df: DataFrame, date: str, *keys: str) -> DataFrame:
    """Rows of the greatest date of their kind, by a join with the maxima."""
    top = df.groupBy(*keys).agg(F.max(date).alias("_top")) if keys else df.agg(F.max(date).alias("_top"))
    j = df.join(top, [*keys]) if keys else df.crossJoin(F.broadcast(top))  # one row
    return j.where(F.col(date) == F.col("_top")).drop("_top")
