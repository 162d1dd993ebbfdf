"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh by ``weights``, repeating, and
share all words. A target stops at ``cap`` times its source's words; the excess
is shared again by weight, which ends at one common level: with sources by
ascending cap per weight, a source is full while its cap is within the level
that the rest would get.

Each document of a source expects target / source words copies. Documents are
ordered by size class and a hash, their expected copies are prefix-summed
within the source, one random offset is added, and a document is emitted once
per whole number crossed. The order is cut at fixed prefixes of a hash of doc_id
and text, whose counts are summed first, so no source is ever ordered in one task.

Cases: null text has size 0; a null source is a source; sources without words
take nothing; repeated rows are documents of their own, and those equal in
doc_id and text share one ordering window; a very long text is one document; an
empty table gives an empty result; other columns, whatever their names, pass
through `mixed` and `emit` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.llm import common as C
from equiloom.llm.common import WORD

#: Documents that one ordering window should hold at most, about.
BIN_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """From (source, source_size) to (source, source_size, target)."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("all_words") - F.coalesce(F.sum("most").over(level), F.lit(0.0))
    left = F.col("all_weight") - F.coalesce(F.sum("weight").over(level), F.lit(0.0))
    return (
        sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
        .select("*", (F.col("most") / F.col("weight")).alias("ratio"), F.sum(F.col("source_size").cast("double")).over(every).alias("all_words"), F.sum("weight").over(every).alias("all_weight"))
        .select("*", (rest / left).alias("level"))
        .select("*", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every).alias("common"))
        .select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("common"))).alias("target"))
    )


def _part(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _placed(docs: DataFrame, seed: int, digits: int) -> DataFrame:
    """The rows with a struct column `o`: their place in the order (source key,
    size class, bin, hash) and size. One key for joins and windows, null apart
    from any string."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    at = C.own_columns(docs, "o")[0]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    sized = docs.select(*docs.columns, F.struct(key.alias("s"), size.alias("size"), F.md5(name).alias("hash")).alias(at))
    o = F.col(at)
    size_class = F.length(F.bin(o["size"])) * 16 + F.expr(f"shiftright(`{at}`.size, greatest(length(bin(`{at}`.size)) - 4, 0))")
    return sized.withColumn(at, F.struct(o["s"].alias("s"), size_class.cast("long").alias("class"), F.substring(o["hash"], 1, digits).alias("bin"), o["hash"].alias("hash"), o["size"].alias("size")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 0) -> tuple[DataFrame, str]:
    """The documents, and the name of an added struct column with their size,
    source_size, target and copies."""
    digits, rows = 0, docs.count()
    while BIN_ROWS * 16**digits < rows and digits < 8:
        digits += 1
    placed = _placed(docs, seed, digits)
    at = placed.columns[-1]
    # Texts are measured once for the sums, and once more on the rows themselves.
    groups = C.checkpoint(
        placed.groupBy(f"{at}.s", f"{at}.class", f"{at}.bin").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum(f"{at}.size").alias("w"))
    )
    before = F.sum("n").over(Window.partitionBy("s").orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1))
    sizes = groups.groupBy("s").agg(F.first("source").alias("source"), F.sum("w").alias("source_size"))
    goal = targets(sizes.select("source", "source_size"), weights, cap).withColumn("s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    bins = groups.select("s", "class", "bin", F.coalesce(before, F.lit(0)).alias("before")).join(goal, "s")
    some = C.own_columns(placed, "p", "s", "class", "bin", "row")
    p, keys, row_at = some[0], some[1:4], some[4]
    bins = bins.select(*[F.col(c).alias(k) for c, k in zip(("s", "class", "bin"), keys, strict=True)], F.struct("source", "before", "source_size", "target").alias(p))
    order = Window.partitionBy(f"{at}.s", f"{at}.class", f"{at}.bin").orderBy(f"{at}.hash")
    ranked = placed.withColumn(row_at, F.row_number().over(order)).withColumns({k: F.col(at)[c] for c, k in zip(("s", "class", "bin"), keys, strict=True)})
    rate = F.when(F.col(p)["source_size"] > 0, F.col(p)["target"] / F.col(p)["source_size"]).otherwise(0.0)
    offset = _part(F.concat_ws("|", F.lit(str(seed)), F.lit("offset"), F.coalesce(F.col(p)["source"].cast("string"), F.lit("\x00"))))
    rank = F.col(p)["before"] + F.col(row_at)
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    mix = F.struct(F.col(at)["size"].alias("size"), F.col(p)["source_size"].alias("source_size"), F.col(p)["target"].alias("target"), copies.cast("long").alias("copies"))
    return ranked.join(bins, keys).select(*docs.columns, mix.alias(at)), at


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    rows, at = mixed(docs.select("doc_id", "text", "source"), weights, cap, seed)
    return rows.select("doc_id", "source", f"{at}.size", f"{at}.source_size", f"{at}.target", f"{at}.copies", (F.col(at)["size"] * F.col(at)["copies"]).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    rows, at = mixed(docs, weights, cap, seed)
    again = C.own_columns(rows, "copy")[0]
    return rows.where(F.col(at)["copies"] > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(at)["copies"].cast("int")))).select(*docs.columns)


def oracle(weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 0, source: str = "documents") -> str:
    """The same in DuckDB SQL."""
    weight = f"[{', '.join(f'{w}.0' for w in weights)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1]::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {source}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, source_size * {float(cap)}::DOUBLE AS most, {weight} AS weight FROM s),
b AS (SELECT *, most / weight AS ratio, sum(source_size::DOUBLE) OVER () AS all_words, sum(weight) OVER () AS all_weight FROM a),
c AS (SELECT *, (all_words - coalesce(sum(most) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level
      FROM b WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS common FROM c),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN most ELSE least(most, weight * common) END AS target FROM e),
r AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('{seed}|offset|' || coalesce(d.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off,
        row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(d.text), ''))) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rank * rate + off) - floor((rank - 1) * rate + off)))::BIGINT AS taken FROM r"""
