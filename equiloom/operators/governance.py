"""Directors and companies: scores, views, searches and seat changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import num


def role_weight(designation: Column, category: Column | None = None) -> Column:
    low = F.lower(F.concat_ws(" ", designation, *([] if category is None else [category])))
    return (
        F.when(low.contains("chair"), 1.25)
        .when(low.contains("managing") | low.contains("whole-time") | low.contains("whole time") | low.contains("ceo") | low.contains("md"), 1.2)
        .when(low.contains("independent"), 1.15)
        .otherwise(1.0)
    )


def din_backed(person_id: Column, din: Column) -> Column:
    """Known by a director number: the number itself, or a person id that is
    not one made from the name."""
    pid = F.trim(F.coalesce(person_id, F.lit("")))
    return (F.trim(F.coalesce(din, F.lit(""))) != "") | ((pid != "") & ~pid.startswith("n:"))


def multi_board(seats: DataFrame, least: int = 2) -> DataFrame:
    """Seats of the directors on so many boards or more."""
    boards = F.size(F.collect_set("ticker").over(Window.partitionBy("person_id")))  # a person's boards: bounded
    return seats.withColumn("_n", boards).where(F.col("_n") >= least).drop("_n")


def seat_rows(seats: DataFrame, companies: DataFrame) -> DataFrame:
    return seats.join(companies.select("ticker", F.col("name").alias("company"), "market", "sector", "mcap_cr"), "ticker")


def director_scores(rows: DataFrame) -> DataFrame:
    """Roll-up of seats by person with the director score."""
    m = F.when(F.col("mcap_cr") > 0, F.col("mcap_cr"))  # none above 0 is unknown
    backed = din_backed(F.col("person_id"), F.col("din"))
    weight = num.log_weight(m) * F.when(backed, 1.0).otherwise(0.25) * role_weight(F.col("designation"), F.col("category") if "category" in rows.columns else None)
    size = lambda c: F.count_if(c).cast("long")
    g = rows.groupBy("person_id", "din", "director").agg(
        F.countDistinct("ticker").alias("board_count"),
        F.sum(num.js_round(weight, 6).cast("decimal(38,6)")).cast("double").alias("raw"),
        size(m >= 5000).alias("big_n"), size(m < 5000).alias("small_n"), size(m < 500).alias("tiny_n"), size(m < 100).alias("ti_n"), size(m >= 20000).alias("lc_n"),
        F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"),
    )
    bridge = (F.col("big_n") > 0) & (F.col("small_n") > 0)
    bonus = F.when(bridge, 15).when(F.col("lc_n") >= 2, 12).when(F.col("big_n") > 0, 8).otherwise(0)
    score = num.saturate(F.col("raw")) + bonus - 4 * F.greatest(F.lit(0), F.col("board_count") - 5)
    return g.select(
        "person_id", "din", "director", "board_count", "tickers",
        bridge.alias("bridge"), ((F.col("big_n") > 0) & (F.col("tiny_n") > 0)).alias("tiny_bridge"),
        ((F.col("big_n") > 0) & (F.col("ti_n") > 0)).alias("ti_bridge"), (F.col("lc_n") >= 2).alias("multi_lc"), "lc_n",
        (~din_backed(F.col("person_id"), F.col("din")) & (F.col("board_count") >= 5)).alias("name_collision"),
        num.js_round(num.clamp(score, 0, 100), 1).alias("score"),
    )


def seat_events(old: DataFrame, new: DataFrame, keep_dins: bool = True) -> DataFrame:
    """joined, resigned and role_changed by company and person. A company
    without an earlier snapshot has no events; one whose new board lost all
    director numbers is passed over."""
    key = ["ticker", "person_id"]
    known = old.select("ticker").distinct()
    if keep_dins:
        had = old.groupBy("ticker").agg(F.count("din").alias("a"))
        has = new.groupBy("ticker").agg(F.count("din").alias("b"))
        known = had.join(has, "ticker", "left").where("not (a > 0 and coalesce(b, 0) = 0)").select("ticker")
    role = lambda c: F.lower(F.trim(F.col(c)))
    both = old.select(*key, F.col("designation").alias("old_designation"), F.lit(True).alias("was")).join(
        new.select(*key, F.col("designation").alias("new_designation"), F.lit(True).alias("now")), key, "full"
    )
    kind = F.when(F.col("was").isNull(), "joined").when(F.col("now").isNull(), "resigned").when(role("old_designation") != role("new_designation"), "role_changed")
    return both.join(known, "ticker", "left_semi").select(*key, kind.alias("event_type"), "old_designation", "new_designation").where("event_type is not null")


def event_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("joined", "resigned", "role_changed")],
        F.countDistinct("ticker").alias("companies"), F.countDistinct("person_id").alias("people"),
    )
