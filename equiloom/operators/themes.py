"""Theme matching over texts, and the audit of theme keywords.

A theme is {pattern, group, keywords, candidates, allow: sectors, allow_sub:
sub-sectors, deny: (sector, sub-sector) pairs}. All patterns of all themes are
read in one pass over each text (`phrases.scan`); gates, lists and counts are
expressions on the numbers that come back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloom.operators.company import in_sector
from equiloom.operators.phrases import FOUND, Phrases, holds, scan

# Greatest market cap in crore of two groups of themes.
GROUP_CAPS = {"Nanocap Champs": 500, "Listed Venture Capital": 6000}

SHARES = 256  # of the rows of one keyword, for its first keys
EXAMPLES, SAMPLE = 3, 8
PRUNE = 1000  # words at most to which a search for phrases is narrowed


def cap_passes(group: str | None, mcap: Column) -> Column:
    """Unknown caps pass, and all of a group without a limit."""
    return F.lit(True) if group not in GROUP_CAPS else mcap.isNull() | (mcap <= GROUP_CAPS[group])


def _gate(theme: dict) -> Column:
    return in_sector(theme.get("allow", []), theme.get("allow_sub", []), theme.get("deny", []))


def _matches(phrases: Phrases, theme: dict) -> Column:
    return F.coalesce(holds(phrases, theme["pattern"]) & cap_passes(theme.get("group"), F.col("mcap_cr")) & _gate(theme), F.lit(False))


def _others(df: DataFrame, column: str) -> list[str]:
    return [c for c in df.columns if c != column]


def theme_flags(df: DataFrame, column: str, themes: dict[str, dict]) -> DataFrame:
    """The columns but the text, and a boolean for each theme."""
    phrases = Phrases([t["pattern"] for t in themes.values()])
    return scan(df, column, phrases, *_others(df, column)).withColumns({f"theme_{k}": _matches(phrases, t) for k, t in themes.items()}).drop(*FOUND)


def _named(numbers: Column, names: list[str]) -> Column:
    table = F.array(*map(F.lit, names))
    return F.transform(numbers, lambda i: F.get(table, i))


def _numbers(ids) -> Column:
    return F.array(*map(F.lit, ids)) if len(ids) else F.array().cast("array<int>")


def theme_columns(df: DataFrame, column: str, themes: dict[str, dict], custom: str = "") -> DataFrame:
    """Every row without the text, with `theme_hit` (whether some theme or the
    custom pattern matches), the ids of its themes, the clauses that matched and
    the phrases to highlight, longest first."""
    phrases = Phrases([*(t["pattern"] for t in themes.values()), *([custom] if custom.strip() else [])])
    hits = [(k, t["pattern"], _matches(phrases, t)) for k, t in themes.items()]
    hits += [(None, custom, holds(phrases, custom))] if custom.strip() else []
    none = F.array().cast("array<int>")
    # Clauses in the patterns' order, of the patterns that match.
    clauses = F.array_distinct(F.flatten(F.array(*[F.when(ok, F.filter(_numbers(phrases.of[p]), lambda c: F.array_contains("clauses", c))).otherwise(none) for _, p, ok in hits])))
    terms = F.array(*[_numbers(c) for c in phrases.clauses])
    lit = F.array_distinct(F.flatten(F.transform("which", lambda c: F.filter(F.get(terms, c), lambda t: F.array_contains("terms", t)))))
    by_length = F.transform(F.array_sort(F.transform("lit", lambda t, i: F.struct((-F.length(F.get(F.array(*map(F.lit, phrases.terms)), t))).alias("n"), i.alias("i"), t.alias("t")))), lambda r: r["t"])
    return (
        scan(df, column, phrases, *_others(df, column))
        .withColumns({"theme_hit": reduce(lambda a, b: a | b, [ok for *_, ok in hits], F.lit(False)), "theme_ids": F.array_compact(F.array(*[F.when(ok, F.lit(k)) for k, _, ok in hits if k is not None])), "which": clauses})
        .withColumn("lit", lit)
        .withColumn("highlights", _named(by_length, phrases.terms))
        .drop("clauses")
        .withColumn("clauses", _named(F.col("which"), phrases.names()))
        .drop("which", "lit", "terms", "loose")
    )


def theme_rows(df: DataFrame, column: str, themes: dict[str, dict], custom: str = "") -> DataFrame:
    """Those rows of `theme_columns` that match."""
    return theme_columns(df, column, themes, custom).where("theme_hit").drop("theme_hit")


def merge_portfolio(rows: DataFrame, universe: DataFrame, holdings: DataFrame, column: str, themes: dict[str, dict]) -> DataFrame:
    """Rows, and held companies of a theme that they lack."""
    held = theme_rows(universe.join(holdings.select("ticker").distinct(), "ticker", "left_semi"), column, themes)
    return rows.unionByName(held.join(rows.select("ticker").distinct(), "ticker", "left_anti").select(*rows.columns))


def _entries(themes: dict[str, dict]) -> list[tuple[str, str, str, int]]:
    """(theme, kind, pattern, place): a theme's own pattern, its keywords, and
    its candidates that are no keywords."""
    out = []
    for k, t in themes.items():
        known = {w.lower() for w in t.get("keywords", [])}
        out.append((k, "theme", t["pattern"], 0))
        out += [(k, "keyword", w, i) for i, w in enumerate(t.get("keywords", []))]
        out += [(k, "candidate", w, i) for i, w in enumerate(t.get("candidates", [])) if w.lower() not in known]
    return out


def keyword_hits(df: DataFrame, column: str, key: str, themes: dict[str, dict], loose_over: int = 140) -> DataFrame:
    """A row (entry, key, gated, loose) for each row of the table and each
    pattern that matches it: whether the theme lets the row through, caps set
    aside, and whether the phrases of a single clause lie far apart."""
    entries = _entries(themes)
    phrases = Phrases([e[2] for e in entries], loose_over)
    by_clause: list[list[int]] = [[] for _ in phrases.clauses]
    single: list[list[int]] = [[] for _ in phrases.clauses]
    for i, (_, _, p, _) in enumerate(entries):
        for c in set(phrases.of[p]):
            by_clause[c].append(i)
        if len(phrases.of[p]) == 1:
            single[phrases.of[p][0]].append(i)
    reach = lambda ids, table: F.array_distinct(F.flatten(F.transform(ids, lambda c: F.get(F.array(*map(_numbers, table)), c))))
    ids = list(themes)
    own = [ids.index(e[0]) for e in entries]
    open_ = F.array_compact(F.array(*[F.when(F.coalesce(_gate(t) & holds(phrases, t["pattern"]), F.lit(False)), F.lit(i)) for i, t in enumerate(themes.values())]))
    rows = scan(df, column, phrases, key, "sector", "sub_sector").where(F.size("clauses") > 0)
    rows = rows.select(key, reach(F.col("clauses"), by_clause).alias("e"), reach(F.col("loose"), single).alias("far"), open_.alias("open"))
    return rows.select(key, "far", "open", F.explode("e").alias("entry")).select(
        "entry", key, F.array_contains("open", F.get(F.array(*map(F.lit, own)), F.col("entry"))).alias("gated"), F.array_contains("far", F.col("entry")).alias("loose")
    )


def audit(df: DataFrame, column: str, key: str, themes: dict[str, dict], loose_over: int = 140) -> DataFrame:
    """Per pattern of a theme (kind, pattern, place): hits, those that the theme
    lets through, those whose phrases lie far apart, the first three keys (of a
    theme itself the first eight that are let through), and whether it is never
    or seldom hit. Counts and first keys are taken in shares of a pattern's rows
    before these meet."""
    entries = _entries(themes)
    share = Window.partitionBy("entry", F.pmod(F.xxhash64(key), F.lit(SHARES)), "shown")
    kinds = F.array(*[F.lit(e[1]) for e in entries])
    shown = (F.get(kinds, F.col("entry")) != "theme") | F.col("gated")
    part = (
        keyword_hits(df, column, key, themes, loose_over)
        .withColumn("shown", shown)
        .select("entry", key, "shown", F.row_number().over(share.orderBy(key)).alias("r"), F.count("*").over(share).alias("n"), F.count_if("gated").over(share).alias("g"), F.count_if("loose").over(share).alias("l"))
        .where(F.col("r") <= SAMPLE)
    )
    once = lambda c: F.sum(F.when(F.col("r") == 1, F.col(c)))
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("shown"), F.col(key)))), 1, SAMPLE)  # SHARES * SAMPLE at most
    counts = part.groupBy("entry").agg(once("n").alias("hits"), once("g").alias("gated"), once("l").alias("loose"), first.alias("first"))
    every = df.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(entries)], "entry int, theme string, kind string, pattern string, place int")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    size = F.when(F.col("kind") == "theme", SAMPLE).otherwise(EXAMPLES)
    tag = F.when(F.coalesce("hits", F.lit(0)) == 0, "ZERO").when(F.col("hits") < 3, "low").otherwise("ok")
    examples = F.coalesce(F.array_join(F.slice("first", F.lit(1), size), ","), F.lit(""))
    return every.join(counts, "entry", "left").select("theme", "kind", "pattern", "place", n("hits"), n("gated"), n("loose"), examples.alias("examples"), tag.alias("tag"))


def audit_report(audited: DataFrame) -> DataFrame:
    """Per theme: matches let through and their sample, keywords never and
    seldom hit, in order, and how often its phrases lay far apart."""
    keyword, theme = F.col("kind") == "keyword", F.col("kind") == "theme"
    listed = lambda tag: F.transform(F.array_sort(F.collect_list(F.when(keyword & (F.col("tag") == tag), F.struct("place", "pattern")))), lambda r: r["pattern"])
    return audited.groupBy("theme").agg(
        F.max(F.when(theme, F.col("gated"))).alias("gated"), F.max(F.when(theme, F.col("examples"))).alias("sample"), F.count_if(keyword).alias("keywords"),
        F.array_join(listed("ZERO"), ",").alias("zero_hit"), F.array_join(listed("low"), ",").alias("low_hit"), F.coalesce(F.sum(F.when(keyword, F.col("loose"))), F.lit(0)).alias("loose"),
    )


def candidates(audited: DataFrame, least: int = 3, top: int = 8) -> DataFrame:
    """Per theme its candidates with the most hits, three at least; ties in the
    order given."""
    order = Window.partitionBy("theme").orderBy(F.desc("hits"), "place")
    return audited.where((F.col("kind") == "candidate") & (F.col("hits") >= least)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("theme", "rank", "pattern", "hits", "examples")


def _row_counts(df: DataFrame, key: str, phrases: Column) -> DataFrame:
    """(phrase, hits): in how many rows each phrase occurs, rows of one key taken
    as one. A key of one row needs no meeting of its rows: its phrases are counted
    where they are."""
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_k"), F.lit(True).alias("_again"))
    own = F.when(F.col("_again"), F.struct(key))
    rows = df.join(again, F.col(key).eqNullSafe(F.col("_k")), "left").select(own.alias("_own"), F.explode(F.array_distinct(phrases)).alias("phrase"))
    once = rows.groupBy("phrase", "_own").agg(F.count("*").alias("n"))
    return once.groupBy("phrase").agg(F.sum(F.when(F.col("_own").isNull(), F.col("n")).otherwise(1)).alias("hits"))


def _frequent(words: DataFrame, known: list[str], least: int, top: int) -> list[str] | None:
    """The words of which a phrase among the `top` can be made: a phrase occurs in
    no more rows than each of its words does, and `top` words that are no keywords
    set how often it must. None where these are more than PRUNE."""
    rows = words.where(F.col("hits") >= least).orderBy(F.desc("hits"), "phrase").limit(PRUNE + 1).collect()
    new = [r.hits for r in rows if r.phrase not in known]
    need = new[top - 1] if len(new) >= top else least
    some = [r.phrase for r in rows if r.hits >= need]
    return None if len(some) > PRUNE else some


def mine(df: DataFrame, column: str, key: str, known: list[str], longest: int = 1, least: int = 3, top: int = 8) -> DataFrame:
    """Frequent runs of up to `longest` words of four letters or more that are
    no keywords yet, each counted once a row. Words are counted first; runs of two
    and more are made only of words frequent enough, where these are told."""
    words = F.regexp_extract_all(F.lower(column), F.lit("([a-z]{4,})"), F.lit(1))
    split = df.select(key, words.alias("w"))
    c = _row_counts(split, key, F.col("w"))
    some = _frequent(c, known, least, top) if longest > 1 else None
    if longest > 1:
        if some is not None:  # other words become null, and every run with one of them
            split = df.select(key, F.transform(words, lambda x: F.when(x.isin(*some), x) if some else F.lit(None).cast("string")).alias("w"))
        run = lambda n: F.zip_with(run(n - 1), F.slice("w", n, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)) if n > 1 else F.col("w")
        c = _row_counts(split, key, F.array_compact(F.flatten(F.array(*[run(n + 1) for n in range(longest)]))))
    return c.where((F.col("hits") >= least) & ~F.col("phrase").isin(*known)).orderBy(F.desc("hits"), "phrase").limit(top)
