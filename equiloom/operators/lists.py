"""Lists, orders and further state of incremental runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.functions import text
from equiloom.operators.company import first_per_key


def fill_sector(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Sector and sub-sector of the class where the row's sector is blank or a
    dash; other rows keep theirs."""
    known = first_per_key(classes.select(F.upper("ticker").alias("_t"), F.col("sector").alias("_s"), F.col("sub_sector").alias("_b")), "_t", "_s", "_b")
    blank = F.coalesce(F.trim("sector"), F.lit("")).isin("", "—") & F.col("_t").isNotNull()
    j = rows.join(known, F.upper(F.col(key)) == F.col("_t"), "left")
    return j.withColumns({"sector": F.when(blank, F.coalesce("_s", "sector")).otherwise(F.col("sector")), "sub_sector": F.when(blank, F.coalesce("_b", "sub_sector")).otherwise(F.col("sub_sector"))}).drop("_t", "_s", "_b")


def distinct_sources(*lists: DataFrame) -> DataFrame:
    """Tickers of any list, once each, in upper case and sorted."""
    every = reduce(lambda a, b: a.unionByName(b), [x.select(F.upper(F.trim("ticker")).alias("ticker")) for x in lists])
    return every.where("ticker <> ''").distinct().orderBy("ticker")


def notes(rows: DataFrame, attachments: DataFrame) -> DataFrame:
    """All notes, and an empty one for each ticker that has attachments only."""
    more = attachments.select("ticker").distinct().join(rows.select("ticker").distinct(), "ticker", "left_anti")
    return rows.unionByName(more, allowMissingColumns=True)


def curated_order(summary: DataFrame, curated: dict[str, int]) -> list[Column]:
    """Curated investors first in their own order, others by holdings, name."""
    rank = F.create_map(*[F.lit(x) for k, v in curated.items() for x in (k, v)])[F.col("investor")] if curated else F.lit(None).cast("int")
    return [rank.asc_nulls_last(), F.desc("holdings"), F.asc("investor")]


def consensus_order() -> list[Column]:
    """More investors, more new ones, more that add, greater value, then the
    symbol."""
    return [F.desc("investors"), F.desc("new_count"), F.desc("increased_count"), F.coalesce("total_value", F.lit(0.0)).desc(), F.asc("symbol")]


def collapse(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key: greatest share and value, longest name, all entities."""
    longest = F.max_by("name", F.struct(F.length("name"), "name"))
    return rows.groupBy(*keys).agg(F.max("pct").alias("pct"), F.max("value").alias("value"), longest.alias("name"), F.array_join(F.array_sort(F.collect_set("entity")), ", ").alias("entities"))


def greatest_rows(rows: DataFrame, key: list[str], value: str, *later: str) -> DataFrame:
    """The row of each key with the greatest value; ties go to the later one."""
    return first_per_key(rows, key, F.coalesce(value, F.lit(0.0)).desc(), *[F.desc(c) for c in later])


def canonical(symbol: Column) -> Column:
    """All alias forms of a symbol as one key."""
    return F.regexp_replace(text.bare_symbol(symbol), "-SM$", "")


def alias_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones under any alias of their symbols."""
    gone = new.select(canonical(F.col(key)).alias("_c")).distinct()
    kept = old.withColumn("_c", canonical(F.col(key))).join(gone, "_c", "left_anti").drop("_c")
    return kept.unionByName(new)


def invalidate(old: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Old rows without those of the symbols, under any alias."""
    gone = symbols.select(canonical(F.col(key)).alias("_c")).distinct()
    return old.withColumn("_c", canonical(F.col(key))).join(gone, "_c", "left_anti").drop("_c")


def backfill(about: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows found are added; those known get values only where blank."""
    rest = [c for c in about.columns if c not in keys]
    f = found.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest])
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    return about.join(f, keys, "full").select(*keys, *[F.coalesce(blank(c), F.col(f"_n_{c}"), F.col(c)).alias(c) for c in rest])


def runs(log: DataFrame) -> DataFrame:
    """A run's start, its finish if it has one, and its verdicts so far."""
    when = lambda k: F.max(F.when(F.col("kind") == k, F.col("at")))
    return log.groupBy("run_id").agg(when("start").alias("started"), when("finish").alias("finished"), F.count_if(F.col("kind") == "verdict").alias("verdicts"))


def ttl_scan(cache: DataFrame, tickers: DataFrame, now: str, hours: int, least: float, limit: int) -> DataFrame:
    """Fresh cached scores of the tickers from `least` on, the greatest first."""
    fresh = F.col("cached_at") > F.expr(f"timestamp_ntz '{now}' - interval {hours} hours")
    return cache.join(tickers.select("ticker").distinct(), "ticker", "left_semi").where(fresh & (F.col("score") >= least)).orderBy(F.desc("score"), "ticker").limit(limit)


def seat_filter(rows: DataFrame, cap: str = "All", sme: bool = False, pattern: str | None = None, show_all: bool = False, any_flag: tuple[str, ...] = ()) -> DataFrame:
    """Seats of the directors that pass: by cap band (NC has none), board, theme
    text and flags of some seat. With `show_all` a matching director keeps all
    seats, those of the theme first (`theme_hit`)."""
    person = Window.partitionBy("person_id")
    out = rows
    if pattern:
        hit = F.coalesce((F.trim("seat_text") != "") & text.matches_pattern(F.col("seat_text"), pattern), F.lit(False))
        out = out.withColumn("theme_hit", hit)
        out = out.withColumn("_m", F.max("theme_hit").over(person)).where("_m").drop("_m") if show_all else out.where("theme_hit")
    if cap.upper() != "ALL":
        out = out.where(F.coalesce("cap_code", F.lit("NC")) == cap.upper())
    if sme:
        out = out.where(F.col("market").rlike("\\bSME\\b"))
    if any_flag:
        some = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in any_flag])
        out = out.withColumn("_f", F.max(some).over(person)).where("_f").drop("_f")
    return out


def director_filter(scores: DataFrame, min_score: float = 0, min_boards: int = 2, query: str = "", hide_collision: bool = False, din_only: bool = False, **flags: bool) -> DataFrame:
    """Scored directors: the least score and boards (not when searching), known
    numbers alone, no likely name collisions, and the bridges asked for."""
    out = scores.where(F.col("score") >= min_score)
    if not query.strip():
        out = out.where(F.col("board_count") >= min_boards)
    if din_only:
        out = out.where("din is not null")
    if hide_collision:
        out = out.where(~F.col("name_collision"))
    return reduce(lambda df, c: df.where(F.col(c)), [c for c, on in flags.items() if on], out)


def director_order(sort: str) -> list[Column]:
    """By score, boards or name, with the others as ties."""
    score, boards, name = F.desc("score"), F.desc("board_count"), F.asc("director")
    first = {"boards": [boards, score, name], "name": [name, score, boards]}.get(sort, [score, boards, name])
    return [*first, F.asc("person_id")]
