"""The phrase index against one regular expression per phrase and place."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from equiloom.functions import text
from equiloom.operators import themes
from equiloom.operators.phrases import Phrases, holds, scan

FINANCE = re.compile(rf"\b(?:{text.FINANCE_NOISE})\b", re.I | re.A)
MEDICAL = re.compile(rf"\b(?:{text.MEDICAL_NOISE})\b", re.I | re.A)
SPACE = r"[ \t\n\x0b\f\r\xa0]+"


def places(x, term, acronym):
    body = SPACE.join(re.escape(w) for w in term.split())
    return [m.start() for m in re.finditer(rf"(?={'' if acronym else '(?i:'}\b{body}\b{'' if acronym else ')'})", x, re.A)]


def by_hand(x, pattern, over):
    """(matches, held phrases, whether some clause is loose)"""
    held, matched, loose = set(), [], False
    for clause in text.parse_pattern(pattern):
        clear = []
        for t in clause:
            at = [i for i in places(x, t, text.is_acronym(t)) if i == 0 or x[i - 1] != "-"]
            if at:
                held.add(t)
            noisy = lambda i, t=t: FINANCE.search(x[max(0, i - 16) : i + len(t) + 120]) or (t.lower() in text.MEDICAL_TERMS and MEDICAL.search(x[max(0, i - 24) : i + len(t) + 64]))
            clear.append(any(not noisy(i) for i in at))
        if all(clear):
            matched.append(" + ".join(clause))
            far = [places(x, t, False) for t in clause]
            gaps = [abs(a - b) for i, p in enumerate(far) for q in far[i + 1 :] for a in p for b in q]
            loose |= len(clause) > 1 and all(far) and min(gaps) > over
    return matched, held, loose


PATTERNS = [
    "solar|wind power+turbine", "LED|EV", "die casting + auto", "nuclear|cobalt-60", "a.b+c", "rooftop solar|solar panel", "power", "wind", "the", "of the+power", "AI", "x-ray", "loan", "", " | + |", "café", "power power",
]
WORDS = "solar Solar wind power turbine LED led EV die casting auto nuclear medicine cobalt-60 a.b c rooftop panel the of AI-led x-ray loan credit emi premium NBFC pet-ct spect café cafés power_x 1power".split()


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    joins = [" ", " ", " ", "  ", "\n", "\t \n", "-", ", ", ".", "\xa0", "_"]
    out = [None, "", " ", "solar", "-solar", "solar-", "x" * 50000 + " wind", "AI-led and LED", "ｓolar", "İstanbul wind", "solar loan"]
    out += ["".join(draw.choice(WORDS) + draw.choice(joins) + "z " * draw.choice([0, 0, 1, 40]) for _ in range(draw.randint(1, 40))) for _ in range(600)]
    return out


def test_against_one_expression_each(spark, texts):
    phrases = Phrases(PATTERNS, 30)
    df = spark.createDataFrame([(i, x, "en", 1) for i, x in enumerate(texts)], "k int, text string, terms string, loose int").repartition(3).drop("terms", "loose")
    rows = {r.k: r for r in scan(df, "text", phrases, "k").select("*", *[holds(phrases, p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()}
    assert len(rows) == len(texts)
    some = set()
    for k, x in enumerate(texts):
        want = {p: by_hand(x or "", p, 30) for p in PATTERNS}
        r = rows[k]
        assert {phrases.terms[t] for t in r.terms} == set().union(*(w[1] for w in want.values())), x
        assert {phrases.names()[c] for c in r.clauses} == {m for w in want.values() for m in w[0]}, x
        for i, p in enumerate(PATTERNS):
            assert r[f"p{i}"] == bool(want[p][0])
            assert any(c in r.loose for c in phrases.of[p]) == want[p][2], (x, p)
            some.add((p, r[f"p{i}"], want[p][2]))
    assert len(some) > 25


def test_as_the_expressions(spark, texts):
    """The index and the column functions agree."""
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").where("text is not null and text not like '%İ%'")
    phrases = Phrases(PATTERNS)
    some = [p for p in PATTERNS if text.parse_pattern(p) and "café" not in p]
    a = df.select("k", *[text.matches_pattern(F.col("text"), p).alias(f"p{i}") for i, p in enumerate(some)])
    b = scan(df, "text", phrases, "k").select("k", *[holds(phrases, p).alias(f"p{i}") for i, p in enumerate(some)])
    assert a.exceptAll(b).count() == 0


def test_five_hundred_phrases_in_one_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("lang").alias("sector"), F.col("source").alias("sub_sector"), F.lit(1.0).alias("mcap_cr"))
    rows = docs.collect()
    words = sorted({w for r in rows[:60] for w in re.findall("[a-z]{4,}", (r.text or "").lower())})
    draw = random.Random(1)
    keywords = sorted({*draw.sample(words, 300), *(f"{a} {b}" for r in rows[:40] for a, b in re.findall("([a-z]+) ([a-z]+)", (r.text or ""))[:6])})[:500]
    theme = {"t": {"pattern": "|".join(keywords[:50]), "keywords": keywords, "allow": ["en"], "group": "Nanocap Champs"}}
    assert len(keywords) == 500
    df = themes.audit(docs, "text", "doc_id", theme)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    assert plan.count("MapInArrow") == 1
    got = {(r.kind, r.pattern): r for r in df.collect()}
    for w in [*keywords[::25], theme["t"]["pattern"]]:
        hit = [r for r in rows if by_hand(r.text or "", w, 140)[0]]
        r = got["theme" if w == theme["t"]["pattern"] else "keyword", w]
        gated = [x for x in hit if x.sector == "en" and by_hand(x.text or "", theme["t"]["pattern"], 140)[0]]
        assert (r.hits, r.gated) == (len(hit), len(gated))
        shown = sorted(x.doc_id for x in gated)[:8] if r.kind == "theme" else sorted(x.doc_id for x in hit)[:3]
        assert r.examples == ",".join(map(str, shown))
        assert r.tag == ("ZERO" if not hit else "low" if len(hit) < 3 else "ok")


def test_rows_custom_pattern_and_portfolio(spark):
    form = "ticker string, text string, sector string, sub_sector string, mcap_cr double"
    rows = [("A", "solar panel and wind power with turbine", "Energy", None, 400.0), ("B", "rooftop solar loan", "Energy", None, None), ("C", "wind power, turbine", "Energy", "x", 900.0), ("D", None, None, None, None), ("E", "die casting for auto", "Auto", None, 1.0)]
    df = spark.createDataFrame(rows, form)
    ts = {"sun": {"pattern": "solar|wind power+turbine", "group": "Nanocap Champs", "allow": ["Energy"]}, "cars": {"pattern": "auto"}}
    got = {r.ticker: r for r in themes.theme_rows(df, "text", ts, "die casting").collect()}
    assert {k: (r.theme_ids, r.clauses, r.highlights) for k, r in got.items()} == {
        "A": (["sun"], ["solar", "wind power + turbine"], ["wind power", "turbine", "solar"]), "E": (["cars"], ["auto", "die casting"], ["die casting", "auto"]),
    }
    held = spark.createDataFrame([("A",), ("E",), ("E",), ("D",)], "ticker string")
    base = themes.theme_rows(df.where("ticker = 'A'"), "text", ts)
    assert sorted(r.ticker for r in themes.merge_portfolio(base, df, held, "text", ts).collect()) == ["A", "E"]
    assert text.combine_patterns([" a|b ", "", None, "c"]) == "a|b | c"
