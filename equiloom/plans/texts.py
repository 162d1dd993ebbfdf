"""Queries on documents, conversations, pages and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.functions import num, text
from equiloom.operators import themes as TH
from equiloom.plans.base import query
from equiloom.sources import domain as D
from equiloom.sources.domain import with_sql as W


def _docs(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("sector"), F.col("source").alias("sub_sector"), (F.col("n_chars") / 4).alias("mcap_cr"))


def _body(term: str) -> str:
    return r"[\s\x{00a0}]+".join(term.split())


def _has(x: str, term: str) -> str:
    cs = text.is_acronym(term)
    return f"regexp_matches({x}, '{'' if cs else '(?i)'}(^|[^A-Za-z0-9_-]){_body(term)}([^A-Za-z0-9_]|$)')"


def _clear(x: str, term: str) -> str:
    """A hit free of finance and medical words, found by splitting at the term."""
    low = term.lower()
    of = x if text.is_acronym(term) else f"lower({x})"
    left, right = f"array_to_string(p[greatest(1, k - 12):k], '{low}')", f"array_to_string(p[k + 1:k + 61], '{low}')"
    fine = f"NOT regexp_matches({left}, '[A-Za-z0-9_-]$') AND NOT regexp_matches({right}, '^[A-Za-z0-9_]')"
    fine += f" AND NOT regexp_matches(lower(right({left}, 16) || '{low}' || left({right}, 120)), '\\b({text.FINANCE_NOISE})\\b')"
    if low in text.MEDICAL_TERMS:
        fine += f" AND NOT regexp_matches(lower(right({left}, 24) || '{low}' || left({right}, 64)), '\\b({text.MEDICAL_NOISE})\\b')"
    return f"({_has(x, term)} AND list_transform([string_split_regex({of}, '{_body(term if text.is_acronym(term) else low)}')], lambda p: len(list_filter(range(1, len(p)), lambda k: {fine})) > 0)[1])"


def _clause(x: str, c: list[str]) -> str:
    return "(" + " AND ".join(_clear(x, t) for t in c) + ")"


def _pattern(x: str, p: str) -> str:
    return "(" + " OR ".join(_clause(x, c) for c in text.parse_pattern(p)) + ")"


_DSL = "that the+with|MIT License|und der|token"


@query(f"SELECT doc_id FROM documents WHERE {_pattern('text', _DSL)}")
def f07_pattern_match(spark, d):
    return _docs(spark, d).where(text.matches_pattern(F.col("text"), _DSL)).select("doc_id")


_TERMS = sorted({t: [c for c in text.parse_pattern(_DSL) if t in c] for c in text.parse_pattern(_DSL) for t in c}.items(), key=lambda x: -len(x[0]))


@query("SELECT doc_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {_has('text', t)} AND ({' OR '.join(_clause('text', c) for c in cs)}) THEN '{t}' END" for t, cs in _TERMS) + "] IF x IS NOT NULL], '|') AS terms FROM documents")
def t05_matched_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.matched_terms(F.col("text"), _DSL), "|").alias("terms"))


_LOUD = ["permission", "license", "the"]


@query("SELECT doc_id, " + ", ".join(f"coalesce({_has('text', t)}, false) AS held_{t}, coalesce({_clear('text', t)}, false) AS clear_{t}" for t in _LOUD) + " FROM documents")
def f08_noise_suppressed(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", *[x for t in _LOUD for x in (text.has_term(c, t).alias(f"held_{t}"), text.has_clear_term(c, t).alias(f"clear_{t}"))])


_FAR = ["that", "with", "license"]


def _places(x: str, term: str) -> str:
    left, right = "array_to_string(p[1:k], '" + term + "')", "p[k + 1]"
    return f"list_transform([string_split(lower({x}), '{term}')], lambda p: list_transform(list_filter(range(1, len(p)), lambda k: NOT regexp_matches(p[k], '[A-Za-z0-9_]$') AND NOT (p[k] = '' AND k > 1) AND NOT regexp_matches({right}, '^[A-Za-z0-9_]') AND NOT ({right} = '' AND k + 1 < len(p))), lambda k: length({left})))[1]"


def _gap(a: str, b: str) -> str:
    return f"list_min(list_transform({a}, lambda x: list_min(list_transform({b}, lambda y: abs(x - y)))))"


@query("WITH p AS (SELECT doc_id, " + ", ".join(f"{_places('text', t)} AS p_{t}" for t in _FAR) + " FROM documents), g AS (SELECT doc_id, least(" + ", ".join(_gap(f"p_{a}", f"p_{b}") for i, a in enumerate(_FAR) for b in _FAR[i + 1 :]) + ") AS distance FROM p WHERE " + " AND ".join(f"len(p_{t}) > 0" for t in _FAR) + ") SELECT doc_id, distance::INT AS distance FROM g WHERE distance > 20")
def m12_loose_and(spark, d):
    return _docs(spark, d).select("doc_id", text.loose_and_distance(F.col("text"), _FAR).alias("distance")).where("distance > 20")


_THEMES = {
    "license": {"pattern": "license|licensed", "allow": ["en", "fr"], "allow_sub": ["src2", "src7"], "deny": [("en", "src1")], "group": "Nanocap Champs",
                "keywords": ["license", "licensed", "token", "secret", "that the", "zebra", "of the", "MIT", "that+with+license"], "candidates": ["License", "permission", "rights reserved", "MIT License", "und der", "for the", "zebra", "unicorn"]},
    "tokens": {"pattern": "token|secret", "deny": [("de", "src3")], "group": "Listed Venture Capital", "keywords": ["token", "secret", "API key", "pass word"], "candidates": ["key", "password", "email"]},
    "common": {"pattern": "the+and+of", "allow": ["en"], "group": "Other", "keywords": ["the+and+of", "loan|credit"]},
}


def _match(t: dict, capped: bool = True) -> str:
    one = lambda xs: ", ".join(f"'{x}'" for x in xs)
    gate = "true"
    if t.get("allow") or t.get("allow_sub"):
        deny = " OR ".join(f"(lang = '{a}' AND source = '{b}')" for a, b in t.get("deny", [])) or "false"
        allow = " OR ".join(f"coalesce({c} IN ({one(t[k])}), false)" for c, k in (("lang", "allow"), ("source", "allow_sub")) if t.get(k))
        gate = f"NOT coalesce({deny}, false) AND ({allow})"
    cap = TH.GROUP_CAPS.get(t.get("group")) if capped else None
    small = f"coalesce(n_chars / 4 <= {cap}, true)" if cap else "true"
    return f"coalesce(length(trim(text)) > 0 AND {_pattern('text', t['pattern'])} AND {small} AND {gate}, false)"


def _theme_sql() -> str:
    return "SELECT doc_id, " + ", ".join(f"{_match(t)} AS theme_{k}" for k, t in _THEMES.items()) + " FROM documents"


@query(_theme_sql())
def f35_theme_rows(spark, d):
    return TH.theme_flags(_docs(spark, d), "text", _THEMES).select("doc_id", *[f"theme_{k}" for k in _THEMES])


@query(f"WITH t AS ({_theme_sql()}), h AS (SELECT *, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN theme_{k} THEN '{k}' END" for k in _THEMES) + "] IF x IS NOT NULL], ',') AS themes FROM t) SELECT doc_id, themes FROM h WHERE themes <> ''")
def j23_theme_ids(spark, d):
    return TH.theme_rows(_docs(spark, d), "text", _THEMES).select("doc_id", F.array_join("theme_ids", ",").alias("themes"))


def _hits(theme: str, kind: str, p: str, place: int) -> str:
    clauses, far = text.parse_pattern(p), "false"
    if len(clauses) == 1 and len(clauses[0]) > 1:
        t = clauses[0]
        far = "coalesce(least(" + ", ".join(_gap(_places("text", a), _places("text", b)) for i, a in enumerate(t) for b in t[i + 1 :]) + ") > 20, false)"
    return f"SELECT '{theme}' AS theme, '{kind}' AS kind, '{p}' AS pattern, {place} AS place, doc_id, {_match(_THEMES[theme], False)} AS gated, {far} AS loose FROM documents WHERE {_pattern('text', p)}"


_ENTRIES = TH._entries(_THEMES)
_AUDIT = f"""h AS ({" UNION ALL ".join(_hits(*e) for e in _ENTRIES)}),
w AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in _ENTRIES)}) AS x(theme, kind, pattern, place)),
f AS (SELECT theme, kind, pattern, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM (SELECT * FROM h WHERE kind <> 'theme' OR gated QUALIFY row_number() OVER (PARTITION BY theme, kind, pattern ORDER BY doc_id) <= CASE WHEN kind = 'theme' THEN 8 ELSE 3 END) GROUP BY ALL),
c AS (SELECT theme, kind, pattern, count(*) AS hits, count(*) FILTER (WHERE gated) AS gated, count(*) FILTER (WHERE loose) AS loose FROM h GROUP BY ALL),
a AS (SELECT theme, kind, pattern, place, coalesce(hits, 0) AS hits, coalesce(gated, 0) AS gated, coalesce(loose, 0) AS loose, coalesce(examples, '') AS examples, CASE WHEN hits IS NULL THEN 'ZERO' WHEN hits < 3 THEN 'low' ELSE 'ok' END AS tag
  FROM w LEFT JOIN c USING (theme, kind, pattern) LEFT JOIN f USING (theme, kind, pattern))"""


def _audited(spark, d):
    return TH.audit(_docs(spark, d), "text", "doc_id", _THEMES, 20)


@query(f"WITH {_AUDIT} SELECT * FROM a")
def a23_keyword_audit(spark, d):
    return _audited(spark, d)


@query(f"WITH {_AUDIT} SELECT theme, max(gated) FILTER (WHERE kind = 'theme') AS gated, max(examples) FILTER (WHERE kind = 'theme') AS sample, count(*) FILTER (WHERE kind = 'keyword') AS keywords, coalesce(string_agg(pattern, ',' ORDER BY place) FILTER (WHERE kind = 'keyword' AND tag = 'ZERO'), '') AS zero_hit, coalesce(string_agg(pattern, ',' ORDER BY place) FILTER (WHERE kind = 'keyword' AND tag = 'low'), '') AS low_hit, (coalesce(sum(loose) FILTER (WHERE kind = 'keyword'), 0))::BIGINT AS loose FROM a GROUP BY theme")
def a24_audit_report(spark, d):
    return TH.audit_report(_audited(spark, d))


@query("SELECT theme, pattern, doc_id FROM (" + " UNION ALL ".join(_hits(*e) for e in _ENTRIES if e[1] == "keyword") + ") WHERE loose")
def a23_loose_keys(spark, d):
    own = spark.createDataFrame([(i, e[0], e[2]) for i, e in enumerate(_ENTRIES) if e[1] == "keyword"], "entry int, theme string, pattern string")
    hits = TH.keyword_hits(_docs(spark, d), "text", "doc_id", _THEMES, 20).where("loose")
    return hits.join(F.broadcast(own), "entry").select("theme", "pattern", "doc_id")


@query(f"WITH {_AUDIT} SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY hits DESC, place)::INT AS rank, pattern, hits, examples FROM a WHERE kind = 'candidate' AND hits >= 3")
def a34_candidates(spark, d):
    return TH.candidates(_audited(spark, d))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents), g AS (SELECT doc_id, w AS g FROM w UNION ALL SELECT doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] FROM w WHERE len(w) >= 2 UNION ALL SELECT doc_id, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] FROM w WHERE len(w) >= 3) SELECT phrase, count(*) AS hits FROM (SELECT DISTINCT doc_id, unnest(g) AS phrase FROM g) WHERE phrase NOT IN ('that', 'with') GROUP BY 1 HAVING count(*) >= 3 ORDER BY hits DESC, phrase LIMIT 8")
def a34_mining(spark, d):
    return TH.mine(_docs(spark, d), "text", "doc_id", ["that", "with"], 3)


_MENU = "len(regexp_extract_all({0}, '(?i)\\b(" + "|".join(text.MENU) + ")\\b'))"


def _junk(x: str) -> str:
    hits = _MENU.format(f"trim({x})")
    return f"(length(trim({x})) >= 80 AND ({hits} >= 3 OR (len(string_split_regex(trim({x}), '\\s+')) > 40 AND NOT regexp_matches({x}, '[.!?]') AND {hits} >= 2)))"


_SITE = "html || ' Investor Relations Career' || CASE WHEN page_id % 2 = 0 THEN ' CSR' ELSE '' END"


@query(f"SELECT page_id, {_junk('t')} AS junk FROM (SELECT page_id, {_SITE} AS t FROM pages)")
def p05_nav_junk(spark, d):
    p = D.table(spark, d, "pages")
    t = F.concat("html", F.lit(" Investor Relations Career"), F.when(F.col("page_id") % 2 == 0, " CSR").otherwise(""))
    return p.select("page_id", text.looks_like_menu(t).alias("junk"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 30")
def f33_min_text(spark, d):
    return _docs(spark, d).where(F.length(F.trim("text")) >= 30).select("doc_id")


# --- conversations ---


def _any(x: str, words) -> str:
    return " + ".join(f"(contains(lower({x}), '{w}'))::INT" for w in words)


@query(f"SELECT conv_id, turn, sign(({_any('text', text.POSITIVE)}) - ({_any('text', text.NEGATIVE)}))::INT AS tone FROM conversations")
def t16_sentiment(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", text.sentiment(F.coalesce("text", F.lit(""))).alias("tone"))


@query(f"WITH t AS (SELECT conv_id, sign(({_any('text', text.POSITIVE)}) - ({_any('text', text.NEGATIVE)}))::INT AS tone FROM conversations) SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE tone > 0) AS positive, count(*) FILTER (WHERE tone < 0) AS negative, count(*) FILTER (WHERE tone = 0) AS neutral FROM t GROUP BY 1")
def a28_tone_counts(spark, d):
    t = D.table(spark, d, "conversations").select("conv_id", text.sentiment(F.coalesce("text", F.lit(""))).alias("tone"))
    n = lambda c, a: F.count_if(c).alias(a)
    return t.groupBy("conv_id").agg(F.count("*").alias("total"), n(F.col("tone") > 0, "positive"), n(F.col("tone") < 0, "negative"), n(F.col("tone") == 0, "neutral"))


_KW = ["order", "export", "tion", "wind", "acquire", "capex"]


@query("SELECT conv_id, turn, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _KW) + "] IF x IS NOT NULL], ',') AS hits FROM conversations")
def t15_keyword_hits(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.keyword_hits(F.col("text"), _KW), ",").alias("hits"))


@query(r"SELECT * FROM (SELECT conv_id, turn, regexp_replace(text, '^[\t\n\f\r ]+|[\t\n\f\r ]+\z', '', 'g') AS block FROM conversations) WHERE block <> ''")
def a36_note_blocks(spark, d):
    """The whole blocks of a note, a row each; `turn` is their order."""
    c = D.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.regexp_replace("text", r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", "").alias("block")).where("block <> ''")


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?'), ',') AS numbers FROM documents WHERE regexp_matches(text, '\\d')")
def t22_number_trace(spark, d):
    n = _docs(spark, d).select("doc_id", text.numbers_in(F.col("text")).alias("n")).where(F.size("n") > 0)
    return n.select("doc_id", F.array_join("n", ",").alias("numbers"))


@query("WITH f AS (SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) SELECT conv_id, role, length(text)::INT AS n FROM f")
def a37_top_headline(spark, d):
    c = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("f"))
    return c.select("conv_id", "f.role", F.length("f.text").alias("n"))


# --- pages ---

_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({_STRIP}) AS digest, length({_STRIP})::INT AS n FROM pages")
def t13_strip_tags(spark, d):
    p = D.table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


_LIT = ["that", "the", "license", "MIT", "that the"]
_LIT_RE = r"\b(that[\s\x{00a0}]+the|license|that|the)\b"


@query(f"SELECT doc_id, len(p) - 1 AS hits, (list_sum([length(x) FOR x IN p]) + list_sum([length(x) FOR x IN regexp_extract_all(text, '(?i){_LIT_RE}')]))::BIGINT AS n, coalesce(list_sum([length(x) FOR x IN regexp_extract_all(text, '(?i){_LIT_RE}')]), 0)::BIGINT AS lit FROM (SELECT doc_id, text, string_split_regex(text, '(?i){_LIT_RE}') AS p FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'MIT') AND NOT regexp_matches(text, '(?i)-(license|that|the)\\b')) WHERE len(p) > 1")
def t21_segments(spark, d):
    """Texts in pieces: together they are the text again."""
    docs = D.table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("MIT") & ~F.col("text").rlike("(?i)-(license|that|the)\\b"))
    once = F.stack(F.lit(1), text.segments(F.col("text"), _LIT))  # what comes after reads the pieces, it does not make them again
    x = docs.select("doc_id", "text", once.alias("s")).where(F.exists("s", lambda p: p["hit"]))
    count = lambda ok: F.aggregate("s", F.lit(0).cast("long"), lambda a, p: a + F.when(ok(p), F.length(p["text"])).otherwise(0))
    whole = F.array_join(F.transform("s", lambda p: p["text"]), "") == F.col("text")
    return x.where(whole).select("doc_id", F.size(F.filter("s", lambda p: p["hit"])).cast("long").alias("hits"), count(lambda p: F.lit(True)).alias("n"), count(lambda p: p["hit"]).alias("lit"))


@query("WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '777777.25' ELSE '-3,777777.25' END AS odd FROM x")
def t22_untraceable(spark, d):
    """Sentences with an order's total as it is or rounded, and some with
    figures of their own; the evidence nests and has digits in strings."""
    o, k = D.table(spark, d, "orders"), F.col("o_orderkey") % 3
    shown = F.when(k == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).when(k == 1, num.js_round(F.col("o_totalprice"), 1).cast("decimal(18,1)").cast("string")).otherwise(num.js_round(F.col("o_totalprice"), 0).cast("long").cast("string"))
    said = F.concat(F.lit("Total "), shown, F.lit(" scores 87 of 100, -2 in all"), F.when(k == 2, " and -3").otherwise(""), F.when(k > 0, ", 777777.25 and 777777.25").otherwise(""))
    evidence = F.to_json(F.struct(F.lit('no "777777.25" here').alias("note"), F.array(F.struct(F.struct(F.col("o_totalprice").cast("double").alias("v")).alias("deep"))).alias("list")))
    return o.select("o_orderkey", F.array_join(text.untraceable(said, evidence), ",").alias("odd"))


# --- names ---


@query(W("company") + r" SELECT ticker, trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '\b(limited|ltd|private|pvt|inc|corp|corporation|company|co)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm, upper(ticker) || CASE WHEN market LIKE 'BSE%' THEN '.BO' ELSE '.NS' END AS yahoo FROM company")
def t08_norm_name(spark, d):
    return D.company(spark, d).select("ticker", text.norm_name(F.col("name")).alias("norm"), text.yahoo_symbol(F.col("ticker"), F.col("market")).alias("yahoo"))


@query(r"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN right(lpad(c_custkey::VARCHAR, 8, '0'), 8) ELSE 'n:' || trim(regexp_replace(regexp_replace(lower(c_name), '\b(mr|mrs|ms|dr|shri|smt)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) END AS person_id FROM customer")
def t09_person_key(spark, d):
    c = D.table(spark, d, "customer")
    return c.select("c_custkey", text.person_id(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")), F.col("c_name")).alias("person_id"))


@query("WITH s AS (SELECT DISTINCT o_orderpriority AS p FROM orders) SELECT p, CASE WHEN upper(trim(p)) = 'B' OR starts_with(upper(trim(p)), 'BUY') THEN 'BUY' WHEN upper(trim(p)) = 'S' OR starts_with(upper(trim(p)), 'SEL') THEN 'SELL' ELSE upper(trim(p)) END AS side FROM s")
def t25_side(spark, d):
    return D.table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().select("p", text.normalize_side(F.col("p")).alias("side"))


@query("SELECT o_orderkey, CASE WHEN v < 1000 THEN v::VARCHAR WHEN v < 100000 THEN (v // 1000)::VARCHAR || ',' || lpad((v % 1000)::VARCHAR, 3, '0') ELSE CASE WHEN v < 10000000 THEN (v // 100000)::VARCHAR ELSE (v // 10000000)::VARCHAR || ',' || lpad((v // 100000 % 100)::VARCHAR, 2, '0') END || ',' || lpad((v // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((v % 1000)::VARCHAR, 3, '0') END AS grouped FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders)")
def t20_grouping(spark, d):
    o = D.table(spark, d, "orders")
    return o.select("o_orderkey", num.indian_grouping(F.floor("o_totalprice")).alias("grouped"))
