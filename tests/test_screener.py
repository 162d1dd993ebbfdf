"""Screener requests against rows filtered and sorted in Python."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from equiloom.operators import screener as S

DAY = datetime.date(2024, 5, 3)


@pytest.fixture(scope="module")
def data():
    draw = random.Random(2)
    master, signals, lists, quarter, live = [], [], [], [], []
    for i in range(137):
        t = f"T{i:03}"
        master.append((t, f"Name {draw.randint(0, 60)}", draw.choice(["NSE", "NSE SME", "BSE SME"]), draw.choice(["Metal", "Food", None]), draw.choice(["x", "", None]), draw.choice([None, 10.0, 900.0, 90000.0]), draw.choice([None, 5.0, 7.0]), None, draw.choice([None, "copper wire", "wheat and rye"])))
        signals += [(t, k, DAY, float(i)) for k in S.KINDS if draw.random() < 0.3]
        lists += [(t.lower(), k) for k in S.LISTS if draw.random() < 0.3]
        if draw.random() < 0.8:
            quarter.append((t, draw.choice([10.0, 30.0]), draw.choice([5.0, -1.0]), 3.0))
        if draw.random() < 0.5:
            live.append((t, 1.5, 2.5))
    lists += [("Z1", "fund_a"), ("Z1", "fund_b"), ("Z2", "fund_b"), ("Z3", "hold")]
    return master, signals, lists, quarter, live


@pytest.fixture(scope="module")
def universe(spark, data):
    m, s, li, q, lv = data
    df = spark.createDataFrame(m, "ticker string, name string, market string, sector string, sub_sector string, mcap_cr double, price double, website string, about string").withColumn("search_text", F.coalesce("about", F.lit("")))
    out = S.universe(df, spark.createDataFrame(s, "ticker string, kind string, signal_date date, value double"), spark.createDataFrame(li, "ticker string, list string"), spark.createDataFrame(q, "ticker string, forward_pe double, eps_yoy double, sales_yoy double"), spark.createDataFrame(lv, "ticker string, price double, mcap_cr double"))
    return out.repartition(3).persist()


def rows(data):
    m, s, li, q, lv = data
    out = {r[0]: dict(zip("ticker name market sector sub_sector mcap_cr price website about".split(), r), stub=False) for r in m}
    for t, k in li:
        if k in S.FUNDS:
            out.setdefault(t.upper(), dict.fromkeys("market sector sub_sector mcap_cr price website about".split(), None) | {"ticker": t.upper(), "name": t.upper(), "stub": True})
    figures, prices = {r[0]: r[1:] for r in q}, {r[0]: r[1:] for r in lv}
    for t, r in out.items():
        r |= {k: any((x, y) == (t, k) for x, y, *_ in s) for k in S.KINDS} | {k: any((x.upper(), y) == (t, k) for x, y in li) for k in S.LISTS}
        f = figures.get(t)
        r |= {"sme": "SME" in (r["market"] or ""), "green": bool(f and 0 < f[0] <= 20 and f[1] > 0 and f[2] > 0), "pending": f is None, "pe": f and f[0], "live": prices.get(t)}
    return list(out.values())


def asked(rs, keep, key, descending, page, size):
    found = sorted((r for r in rs if keep(r)), key=lambda r: r["ticker"])
    found = sorted(found, key=key, reverse=False) if not descending else sorted(found, key=lambda r: (-key(r) if not isinstance(key(r), str) else key(r)))
    pages = max(1, -(-len(found) // size))
    page = min(page, pages)
    return len(found), page, pages, [r["ticker"] for r in found[(page - 1) * size : page * size]]


CASES = [
    (S.Request(market="NSE", signals=frozenset(["bb"]), sort="mcap_cr", descending=True, size=10, page=1), lambda r: r["market"] == "NSE" and r["bb"], lambda r: r["mcap_cr"] or 0),
    (S.Request(sort="name", size=10, page=3), lambda r: not r["stub"], lambda r: r["name"]),
    (S.Request(sort="price", size=10, page=99), lambda r: not r["stub"], lambda r: r["price"] or 0),
    (S.Request(sort="price", size=10, page=14), lambda r: not r["stub"], lambda r: r["price"] or 0),
    (S.Request(market="NSE", chips=frozenset(["hold", "sme"]), size=10), lambda r: r["hold"] and r["sme"], lambda r: r["sector"] or ""),
    (S.Request(market="NSE", chips=frozenset(["green"]), size=10), lambda r: r["market"] == "NSE" and r["green"], lambda r: r["sector"] or ""),
    (S.Request(market="NSE", chips=frozenset(["fund_a", "fund_b", "sme"]), signals=frozenset(["bb"]), size=30), lambda r: r["fund_a"] and r["fund_b"], lambda r: r["sector"] or ""),
    (S.Request(chips=frozenset(["fund_b", "note"]), size=30), lambda r: r["fund_b"] and r["note"], lambda r: r["sector"] or ""),
    (S.Request(market="fund_b", size=60), lambda r: r["fund_b"], lambda r: r["sector"] or ""),
    (S.Request(market="hold", sector="Food", size=60), lambda r: r["hold"] and r["sector"] == "Food" and not r["stub"], lambda r: r["sector"] or ""),
    (S.Request(cap="NC", size=60), lambda r: not r["stub"] and r["mcap_cr"] is None, lambda r: r["sector"] or ""),
    (S.Request(market="NSE", search="copper|t00", size=60), lambda r: r["market"] in ("NSE", "NSE SME") and ("copper" in (r["about"] or "") or r["ticker"].startswith("T00")), lambda r: r["sector"] or ""),
    (S.Request(missing="price", market="NSE", size=60), lambda r: r["price"] is None and (r["market"] == "NSE" or r["fund_a"] or r["fund_b"]), lambda r: r["sector"] or ""),
    (S.Request(signals=frozenset(S.KINDS), every=True, size=10), lambda r: r["bb"] and r["tq"] and r["ema"], lambda r: r["sector"] or ""),
    (S.Request(scan=True), lambda r: False, lambda r: ""),
    (S.Request(sector="None such"), lambda r: False, lambda r: ""),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_page(universe, data, i):
    request, keep, key = CASES[i]
    got = S.respond(universe, request).first()
    want = asked(rows(data), keep, key, request.descending, request.page, min(200, max(10, request.size)))
    assert (got.total, got.page, got.pages, [r.ticker for r in got.rows]) == want
    by = {r["ticker"]: r for r in rows(data)}
    for r in got.rows:
        x = by[r.ticker]
        assert r.price == (x["live"] or (x["price"],))[0]
        assert r.missing.price == (r.price is None)
        assert (r.forward_pe, r.missing.dots_pending) == (x["pe"], x["pending"])
        assert (r.has_bb, r.bb is not None, r.has_hold) == (x["bb"], x["bb"], x["hold"])
    assert [r.place for r in got.rows] == list(range((got.page - 1) * got.page_size + 1, (got.page - 1) * got.page_size + 1 + len(got.rows)))


def test_theme_page_prefers_signals_and_brings_held_back(universe, data):
    request = S.Request(market="NSE", scan=True, prefer=True, themes={"c": {"pattern": "copper wire"}}, signals=frozenset(), sector="Metal", size=200)
    got = S.respond(universe, request).first()
    rs = rows(data)
    base = [r for r in rs if r["market"] in ("NSE", "NSE SME") and r["about"] == "copper wire"]
    narrow = [r for r in base if r["sector"] == "Metal" or r["hold"]]
    some = [r for r in narrow if r["bb"] or r["tq"] or r["ema"]]
    assert {r.ticker for r in got.rows} == {r["ticker"] for r in some}
    assert got.breakouts_preferred
    held = [r.has_hold for r in got.rows]
    assert held == sorted(held, reverse=True)
    assert all(r.matched == ["copper wire"] and r.highlights == ["copper wire"] for r in got.rows)


def test_counts_take_no_chip_and_one_scan(universe, data, spark, tmp_path):
    got = S.respond(universe, S.Request(market="NSE", chips=frozenset(["green"]), sector="Food")).first()
    rs = rows(data)
    pool = [r for r in rs if r["market"] in ("NSE", "NSE SME") and r["sector"] == "Food"]
    assert got.signals.asDict() == {k: sum(r[k if k != "dots_pending" else "pending"] for r in pool) for k in (*S.KINDS, "hold", "edge", "sme", "note", "distress", "green", "dots_pending")} | {k: sum(r[k] for r in rs) for k in S.FUNDS}
    hit = [r for r in rs if r["market"] == "NSE" and r["sector"] == "Food" and r["green"]]
    assert got.gaps.price == sum(r["price"] is None for r in hit)
    assert got.gaps.metrics == sum(r["price"] is None or r["mcap_cr"] is None for r in hit)
    text = S.page_json(S.respond(universe, S.Request(size=10))).first().json
    assert len(json.loads(text)["rows"]) == 10
    universe.select([c for c in universe.columns if c not in S.KINDS]).write.parquet(str(tmp_path / "u"))
    kinds = {k: F.lit(None).cast("struct<signal_date:date,value:double>") for k in S.KINDS}
    plan = S.respond(spark.read.parquet(str(tmp_path / "u")).withColumns(kinds), S.Request(signals=frozenset(["bb"])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
