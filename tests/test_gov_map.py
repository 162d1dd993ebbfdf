"""The map of directors against seats filtered in Python; pieces of highlighted
texts and figures against evidence."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from equiloom.functions import text
from equiloom.operators import gov_map as M

TEXTS = ["copper wire", "solar panel", "", "wheat"]


@pytest.fixture(scope="module")
def data():
    draw = random.Random(8)
    companies = [(f"T{i:02}", f"{draw.choice('cab')}o {i % 7}", draw.choice(["NSE", "NSE SME", "BSE SME"]), "x", draw.choice([None, 50.0, 400.0, 9000.0, 50000.0]), draw.choice([None, "TI", "MIC", "LC"]), draw.choice(TEXTS), *[draw.random() < 0.3 for _ in range(6)]) for i in range(30)]
    seats = set()
    for p in range(60):
        din = f"{p:08}" if p % 3 else None
        for t in draw.sample(range(30), draw.randint(1, 6)):
            seats.add((din or f"n:d{p}", din, f"Person {p}", f"T{t:02}", draw.choice(["Chairperson", "Director 7", "Independent Director"])))
    return companies, sorted(seats, key=str)


@pytest.fixture(scope="module")
def tables(spark, data):
    has = ", ".join(f"has_{x} boolean" for x in (*M.SEAT_FLAGS, *M.SEAT_LISTS))
    return spark.createDataFrame(data[1], "person_id string, din string, director string, ticker string, designation string").persist(), spark.createDataFrame(data[0], f"ticker string, name string, market string, sector string, mcap_cr double, cap_code string, text string, {has}").persist()


def by_hand(data, r):
    c = {x[0]: dict(zip(("ticker", "name", "market", "sector", "mcap", "cap", "text", *M.SEAT_FLAGS, *M.SEAT_LISTS), x)) for x in data[0]}
    people: dict = {}
    for p, din, name, t, role in data[1]:
        people.setdefault((p, din, name), []).append(c[t] | {"role": role})
    q, out = r.search.strip().lower(), {}
    for (p, din, name), seats in people.items():
        if q and not (q in name.lower() or q in (din or "") or any(q in s["ticker"].lower() or q in s["name"].lower() for s in seats)):
            continue
        if not q and len(seats) < r.min_boards:
            continue
        sme = [("SME" in s["market"]) for s in seats]
        if ("din_only" in r.flags and not din) or ("sme_cross" in r.flags and not (any(sme) and not all(sme))):
            continue
        left = sorted(seats, key=lambda s: (s["name"].lower(), s["ticker"]))
        hit = lambda s: re.search(rf"\b{r.theme}\b", s["text"]) is not None
        if r.theme:
            if not any(map(hit, left)):
                continue
            left = left if r.show_all else list(filter(hit, left))
        matched = sum(map(hit, seats)) if r.theme else 0
        if r.cap != "All":
            left = [s for s in left if (not s["cap"] if r.cap == "NC" else s["cap"] == r.cap)]
        if r.sme:
            left = [s for s in left if "SME" in s["market"]]
        if not left or any(names and not any(s[x] for s in left for x in names) for names in (r.signals, r.lists)):
            continue
        if q:
            own = q in name.lower() or q in (din or "")
            found = [s for s in left if q in s["ticker"].lower() or q in s["name"].lower() or q in s["role"].lower()]
            if not own and not found:
                continue
            left = found if r.narrow and not own else left
        if r.theme and r.show_all:
            left = sorted(left, key=lambda s: not hit(s))
        out[p] = ([s["ticker"] for s in left], len({s["ticker"] for s in left}), matched)
    return out


@pytest.mark.parametrize("r", [
    M.MapRequest(), M.MapRequest(min_boards=4), M.MapRequest(flags=frozenset(["din_only", "sme_cross"])), M.MapRequest(theme="solar panel"), M.MapRequest(theme="copper wire", show_all=True, cap="LC"),
    M.MapRequest(cap="NC"), M.MapRequest(sme=True, signals=frozenset(["bb", "tq"])), M.MapRequest(lists=frozenset(["hold", "fund_b"]), cap="TI"), M.MapRequest(search="person 1"), M.MapRequest(search="t07", narrow=True),
    M.MapRequest(search=" 0000001", narrow=True), M.MapRequest(search="ao 3", narrow=True, sme=True), M.MapRequest(search="7", narrow=True, theme="wheat"), M.MapRequest(search="nobody"),
])
def test_requests(tables, data, r):
    got = {x.person_id: ([s.ticker for s in x.companies], x.board_count, x.theme_matched, x.tickers) for x in M.narrowed(M.directors(*tables, r), r).collect()}
    want = by_hand(data, r)
    assert {k: v[:3] for k, v in got.items()} == want
    assert all(v[3] == ", ".join(v[0]) for v in got.values())


def test_flags_are_the_scores(tables):
    for flag in ("bridge", "tiny_bridge", "ti_bridge", "multi_lc", "hide_collision"):
        every = {x.person_id: x for x in M.narrowed(M.directors(*tables, M.MapRequest()), M.MapRequest()).collect()}
        some = {x.person_id for x in M.narrowed(M.directors(*tables, M.MapRequest()), M.MapRequest(flags=frozenset([flag]))).collect()}
        assert some == {p for p, x in every.items() if (not x.name_collision if flag == "hide_collision" else x[flag])}


def pieces(said, terms, loose):
    """Hits of each kind of phrase, the earlier and longer kept."""
    known = sorted(dict.fromkeys(t.strip() for t in terms if t.strip()), key=lambda t: -len(t))
    hits = []
    for some, flags in (([t for t in known if text.is_acronym(t)], 0), ([t for t in known if not text.is_acronym(t)], re.I)):
        if some:
            body = "|".join(r"\s+".join(map(re.escape, t.split())) for t in some)
            hits += [(m.start(), -m.end()) for m in re.finditer(f"(?:{body})" if loose else rf"\b(?:{body})\b", said, flags | re.A) if loose or m.start() == 0 or said[m.start() - 1] != "-"]
    out, at = [], 0
    for s, e in sorted(hits):
        if s >= at:
            out += [(said[at:s], False)] * (s > at) + [(said[s:-e], True)]
            at = -e
    return out + [(said[at:], False)] * (at < len(said)) or [(said, False)]


def test_segments(spark):
    draw = random.Random(1)
    words = "LED led AI-led solar Solar power solar  power panel x LEDs EV E.V. (power)".split(" ")
    said = ["", "solar", "-solar", "x", *("".join(draw.choice(words) + draw.choice([" ", "-", ", ", ""]) for _ in range(draw.randint(1, 14))) for _ in range(150))]
    for terms in (["solar power", "solar", "LED", "power panel", "EV"], ["E.V.", "led"], [" "], []):
        for loose in (False, True):
            df = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", text.segments(F.col("t"), terms, loose).alias("s"))
            for r in df.collect():
                assert [(p.text, p.hit) for p in r.s] == pieces(said[r.k], terms, loose), said[r.k]
                assert "".join(p.text for p in r.s) == said[r.k]
    assert [(p.text, p.hit) for p in spark.range(1).select(text.segments(F.lit(None).cast("string"), ["a"]).alias("s")).first().s] == [("", False)]


def test_untraceable(spark):
    evidence = {"a": 1234.567, "b": [{"c": -17.25, "d": "999.5", "e": True}], "f": None, "g": 1e6}
    rounded = lambda x: {x, *(math.floor(x * k + 0.5) / k for k in (1, 10, 100))}
    allowed = set().union(*(rounded(float(x)) for x in (1234.567, -17.25, 1e6)))
    said = "1234.567 1234.57 1234.6 1235 1234 -17.25 -17 -17.3 999.5 50 101 -2 -3 2.5 1000000 1234.5671 999.5 7.7 8.8 9.9"
    want = []
    for m in re.findall(r"-?\d+(?:\.\d+)?", said):
        n = float(m)
        if not (n == int(n) and -2 <= n <= 100) and not rounded(n) & allowed and m not in want:
            want.append(m)
    df = spark.createDataFrame([(said, json.dumps(evidence)), ("5.5", "{}"), ("", "[]"), ("3.5", None)], "t string, e string")
    got = [r.u for r in df.select(text.untraceable(F.col("t"), F.col("e")).alias("u")).collect()]
    assert got[0] == want[:5]
    assert got[1] == ["5.5"]
    assert not got[2]
