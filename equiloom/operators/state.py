"""Incremental state as pure functions of old and new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write wins by key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def coalesce_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new value wins per column where there is one."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return o.join(n, keys, "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest])


def list_merge(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The union of a list column by key, old entries first."""
    o, n = old.select(*keys, F.col(column).alias("_o")), new.select(*keys, F.col(column).alias("_n"))
    none = F.array().cast(old.schema[column].dataType)
    return o.join(n, keys, "full").select(*keys, F.array_union(F.coalesce("_o", none), F.coalesce("_n", none)).alias(column))


def replace_part(old: DataFrame, new: DataFrame, part: list[str]) -> DataFrame:
    """New rows replace all old ones of the parts they touch."""
    return old.join(new.select(*part).distinct(), part, "left_anti").unionByName(new)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def pending(work: DataFrame, done: DataFrame, keys: list[str], limit: int | None = None, *order) -> DataFrame:
    """Work not yet done, the first rows of it where a batch is asked for."""
    left = work.join(done.select(*keys).distinct(), keys, "left_anti")
    return left.orderBy(*order).limit(limit) if limit else left


def with_tombstones(work: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every key tried, null where nothing came of it."""
    return work.select(*keys).distinct().join(results, keys, "left")
