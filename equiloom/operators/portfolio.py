"""Paper positions and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.functions import num


def positions(trades: DataFrame) -> DataFrame:
    """Quantity, market value (the amount where there is no mark) and profit."""
    q = trades.withColumn("qty", num.js_round(F.col("amount") / F.col("entry"), 4))
    q = q.withColumn("market_value", F.when(F.col("mark").isNull(), F.col("amount")).otherwise(F.col("qty") * F.col("mark")))
    pnl = F.col("market_value") - F.col("amount")
    return q.select("*", pnl.alias("pnl"), num.js_round(num.div(pnl, F.col("amount")) * 100, 2).alias("pnl_pct"))


def summary(p: DataFrame) -> DataFrame:
    invested = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    value = F.sum(num.js_round(F.col("market_value"), 2).cast("decimal(38,2)")).cast("double")
    return p.agg(F.count("*").alias("n"), num.js_round(invested, 2).alias("invested"), num.js_round(value, 2).alias("market_value"), num.js_round((value / invested - 1) * 100, 2).alias("pnl_pct"))


def open_trade(amount, entry):
    """Quantity of a new trade; amounts outside [100, 1e7] open none."""
    return F.when(amount.between(100, 1e7), num.js_round(amount / entry, 4))


def latest_state(log: DataFrame) -> DataFrame:
    """Open, close and delete records to each trade's last state."""
    last = log.groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"), F.max_by("price", F.when(F.col("status") == "closed", F.col("at"))).alias("close_price"))
    return last.where("status <> 'deleted'")
