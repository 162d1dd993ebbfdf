"""Quarterly fundamentals: panels, year-on-year changes, valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num


def reported(q: DataFrame, as_of: str) -> DataFrame:
    """Quarters that ended by five days after `as_of` and hold any figure."""
    return q.where((F.col("period_end") <= F.date_add(F.lit(as_of).cast("date"), 5)) & F.coalesce("revenue", "net_income", "eps").isNotNull())


def last_quarters(q: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("period_end"))
    return q.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def crore_scaled(q: DataFrame, metric: str) -> Column:
    """A ticker's metric in crore if any of its panel values reaches 1e5."""
    big = F.max(F.abs(F.col(metric))).over(Window.partitionBy("ticker")) >= 1e5
    return F.when(big, F.col(metric) / 1e7).otherwise(F.col(metric))


def panel(q: DataFrame, n: int = 5) -> DataFrame:
    """Per ticker: labels, sales, net profit and EPS of its last quarters, oldest first."""
    p = last_quarters(q, n)
    p = p.select("ticker", "period_end", num.js_round(crore_scaled(p, "revenue"), 2).alias("sales"), num.js_round(crore_scaled(p, "net_income"), 2).alias("np"), num.js_round(F.col("eps"), 2).alias("eps"))
    g = p.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("period_end", "sales", "np", "eps"))).alias("r"))
    list_ = lambda f: F.array_join(F.transform("r", f), ",")
    cell = lambda c: list_(lambda x: x[c].cast("decimal(20,2)").cast("string")).alias(c)
    return g.select("ticker", list_(lambda x: F.date_format(x["period_end"], "MMM yyyy")).alias("labels"), cell("sales"), cell("np"), cell("eps"))


def recent(q: DataFrame, n: int = 5) -> DataFrame:
    """Per ticker its last quarters, the latest first, as one array."""
    p = last_quarters(q, n)
    return p.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("back", "period_end", "revenue", "net_income", "eps"))).alias("quarters"))


def _yoy(out: dict[str, str]) -> list[Column]:
    """Changes of the latest quarter against the same month a year before."""
    now = F.get("quarters", F.lit(0))
    old = F.get(F.filter("quarters", lambda x: F.last_day(F.add_months(x["period_end"], 12)) == now["period_end"]), F.lit(0))
    return [num.yoy_pct(now[c], old[c]).alias(a) for c, a in out.items()]


def _multiples(price: Column) -> list[Column]:
    """Forward PE on four times the last known EPS, trailing on the last four."""
    last = F.get(F.filter("quarters", lambda x: x["eps"].isNotNull()), F.lit(0))["eps"]
    four = F.filter(F.slice("quarters", 1, 4), lambda x: x["eps"].isNotNull())
    total = F.aggregate(four, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + num.js_round(x["eps"], 6).cast("decimal(28,6)")).cast("decimal(38,6)")).cast("double")
    return [num.forward_pe(price, last).alias("forward_pe"), num.trailing_pe(price, F.when(F.size(four) == 4, total)).alias("trailing_pe")]


CHANGES = {"eps": "eps_yoy", "revenue": "sales_yoy", "net_income": "np_yoy"}


def yoy(q: DataFrame, n: int = 5) -> DataFrame:
    """The latest quarter of the panel against the same month a year before."""
    return recent(q, n).select("ticker", *_yoy(CHANGES))


def valuation(q: DataFrame, prices: DataFrame) -> DataFrame:
    """Forward and trailing PE at a price."""
    return recent(q).join(prices, "ticker").select("ticker", *_multiples(F.col("price")))


def figures(q: DataFrame, prices: DataFrame) -> DataFrame:
    """Changes and multiples from one panel; multiples are null without a price."""
    return recent(q).join(prices.select("ticker", "price"), "ticker", "left").select("ticker", *_yoy(CHANGES), *_multiples(F.col("price")))


def all_green() -> Column:
    """0 < PE <= 20 and both EPS and sales above the year before."""
    return F.coalesce((F.col("forward_pe") > 0) & (F.col("forward_pe") <= 20) & (F.col("eps_yoy") > 0) & (F.col("sales_yoy") > 0), F.lit(False))


def directions(q: DataFrame) -> DataFrame:
    """up, down or flat of each quarter against the one before."""
    prev = F.lag("revenue").over(Window.partitionBy("ticker").orderBy("period_end"))
    return q.select("ticker", "period_end", F.when(prev.isNull(), "na").when(F.col("revenue") > prev, "up").when(F.col("revenue") < prev, "down").otherwise("flat").alias("direction"))


def decumulate(now: DataFrame, total: DataFrame) -> DataFrame:
    """The quarter before, where a cumulative filing is over 5% above the
    quarter's own: the difference, without EPS."""
    j = now.join(total.select("ticker", "period_end", F.col("revenue").alias("r"), F.col("net_income").alias("n")), ["ticker", "period_end"])
    more = (F.col("r") > 1.05 * F.col("revenue")) | (F.abs("n") > 1.05 * F.abs("net_income"))
    return j.where(more).select("ticker", F.last_day(F.add_months("period_end", -3)).alias("period_end"), (F.col("r") - F.col("revenue")).alias("revenue"), (F.col("n") - F.col("net_income")).alias("net_income"))


def by_priority(frames: list[DataFrame], least: int = 2) -> DataFrame:
    """Per ticker, the first source with so many quarters, or else the longest."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [f.withColumn("source", F.lit(i)) for i, f in enumerate(frames)])
    n = every.groupBy("ticker", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ticker").orderBy(F.desc(F.col("n") >= least), F.when(F.col("n") >= least, F.col("source")), F.desc("n"), "source")
    pick = n.withColumn("r", F.row_number().over(w)).where("r = 1").select("ticker", "source")
    return every.join(pick, ["ticker", "source"])


def merge_quarters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Quarters by date; a new figure wins where there is one."""
    keys = ["ticker", "period_end"]
    j = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("revenue", "eps")]).join(new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("revenue", "eps")]), keys, "full")
    return j.select(*keys, *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in ("revenue", "eps")])
