"""Fixed cases: values, indicators, phrases, boards, state."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from equiloom.functions import dates, num, text
from equiloom.operators import fundamentals, governance, portfolio, signals, state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: num.js_round(F.lit(-2.5)), -2.0),
        (lambda: num.yoy_pct(F.lit(140.0), F.lit(100.0)), 40.0),
        (lambda: num.yoy_pct(F.lit(4.48), F.lit(-0.56)), None),
        (lambda: num.forward_pe(F.lit(475.0), F.lit(13.38)), 8.9),
        (lambda: num.forward_pe(F.lit(100.0), F.lit(-2.0)), 999.0),
        (lambda: num.trailing_pe(F.lit(475.0), F.lit(0.3 + 0.36 + 4.47 + 13.38)), 25.7),
        (lambda: num.cap_tier(F.lit(0.0)), "TI"),
        (lambda: num.cap_code(F.lit(0.0)), None),
        (lambda: num.parse_num(F.lit("1,234.5")), 1234.5),
        (lambda: num.parse_num(F.lit("-")), None),
        (lambda: num.indian_grouping(F.lit(1234567)), "12,34,567"),
        (lambda: text.norm_din(F.lit("12-34")), "00001234"),
        (lambda: text.infer_category(F.lit("Non-Executive Director")), "Executive"),
        (lambda: text.infer_category(F.lit("CFO")), ""),
        (lambda: text.infer_category(F.lit("CFO"), True), "Executive"),
        (lambda: text.infer_category(F.lit("MD"), True), ""),
        (lambda: text.news_query(F.lit('Acme "X"'), F.lit("acmelt-sm.ns")), '("Acme X" OR ACMELT) (stock OR shares OR NSE)'),
        (lambda: text.news_query(F.lit("Acme"), F.lit("ACM.BO")), '"Acme" (stock OR shares OR NSE OR SME OR crore)'),
        (lambda: text.news_query(F.lit(None).cast("string"), F.lit("ACM.BO")), '"ACM" (stock OR shares OR NSE OR SME OR crore)'),
        (lambda: text.news_query(F.lit(""), F.lit("")), ""),
        (lambda: text.news_query(F.lit("Tata Motors Limited"), F.lit("TATAMOTORS.NS")), '"tata motors limited" (stock OR shares OR NSE OR order OR revenue)'),
        (lambda: text.csv_escape(F.lit('a"b')), '"a""b"'),
        (lambda: dates.trading_friday(F.lit("2024-03-03").cast("date")), dt.date(2024, 3, 8)),
        (lambda: dates.trading_friday(F.lit("2024-03-02").cast("date")), dt.date(2024, 3, 1)),
        (lambda: dates.period_end(F.lit("Feb-24")), dt.date(2024, 2, 28)),
        (lambda: dates.parse_trade_date(F.lit("05/03/2024")), dt.date(2024, 3, 5)),
    ],
)
def test_values(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(
    ("blurb", "pattern", "want"),
    [
        ("leading CDMO and API intermediates manufacturer", "CDMO|API+intermediates", True),
        ("gold loan and NBFC services only", "gold", False),
        ("gold jewellery exporter", "gold", True),
        ("hospital, nuclear medicine, PET CT", "nuclear", False),
        ("nuclear reactor vessels", "nuclear", True),
        ("missile subsystems, unmanned aerial vehicles", "missile|unmanned aerial", True),
        ("non-copper parts", "copper", False),
        ("coppersmith", "copper", False),
        ("copper flats, wires and rods", "copper+wires", True),
        ("caféled lamps", "led", True),
        ("api maker", "API", False),
        ("", "copper", False),
    ],
)
def test_patterns(spark, blurb, pattern, want):
    assert one(spark, text.matches_pattern(F.lit(blurb), pattern)) is want


def test_breakout(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(7 * i), 100.0, 101.0, 99.0, 100.0, 1e6) for i in range(52)]
    flat = [("B", *r[1:]) for r in rows] + [("B", dt.date(2024, 12, 30), 100.0, 101.0, 99.0, 100.0, 1e6)]
    bars = spark.createDataFrame([*rows, ("A", dt.date(2024, 12, 30), 130.0, 132.0, 120.0, 130.0, 2e6), *flat], "symbol string, date date, open double, high double, low double, close double, volume double")
    assert [(r.symbol, r.signal) for r in signals.breakout(bars).collect()] == [("A", "NEW_BREAKOUT")]


def test_quarters(spark):
    rows = [("2024-06-30", 100e7, 10e7, 1.0), ("2024-09-30", 105e7, 11e7, 1.1), ("2024-12-31", 110e7, 12e7, 1.2), ("2025-03-31", 115e7, 12.5e7, 1.25), ("2025-06-30", 125e7, 14e7, 1.4), ("2099-03-31", 1.0, 1.0, 1.0)]
    q = spark.createDataFrame([("T", dt.date.fromisoformat(a), *r) for a, *r in rows], "ticker string, period_end date, revenue double, net_income double, eps double")
    q = fundamentals.reported(q, "2025-08-01")
    y = fundamentals.yoy(q).first()
    assert (y.sales_yoy, y.eps_yoy) == (25.0, 40.0)
    p = fundamentals.panel(q).first()
    assert p.sales.split(",")[0] == "100.00" and p.eps.split(",")[-1] == "1.40" and len(p.labels.split(",")) == 5


def test_directors(spark):
    seats = [("12345678", "12345678", "A", "X1", "Independent Director", 180000.0), ("12345678", "12345678", "A", "X2", "Director", 400.0), ("99887766", "99887766", "B", "X3", "Director", 20000.0), ("99887766", "99887766", "B", "X4", "Director", 80.0),
             ("22334455", "22334455", "C", "X5", "Director", 5500.0), ("22334455", "22334455", "C", "X6", "Director", 4900.0), ("n:gap", None, "G", "X7", "Director", 2000.0), ("n:gap", None, "G", "X8", "Director", 3000.0)]
    rows = spark.createDataFrame(seats, "person_id string, din string, director string, ticker string, designation string, mcap_cr double")
    got = {r.person_id: r for r in governance.director_scores(rows).collect()}
    a, b, c, g = (got[k] for k in ("12345678", "99887766", "22334455", "n:gap"))
    assert a.bridge and a.tiny_bridge and not a.ti_bridge and a.score > 40 and a.board_count == 2
    assert b.ti_bridge and b.tiny_bridge
    assert c.bridge and not c.tiny_bridge and not c.ti_bridge
    assert not g.bridge


def test_seat_events(spark):
    schema = "ticker string, person_id string, din string, designation string"
    old = spark.createDataFrame([("G", "1", "1", "Independent Director"), ("G", "2", "2", "Chairperson")], schema)
    new = spark.createDataFrame([("G", "1", "1", "Managing Director"), ("G", "3", "3", "Independent Director"), ("NEW", "9", "9", "Director")], schema)
    got = {(r.ticker, r.person_id, r.event_type) for r in governance.seat_events(old, new).collect()}
    assert got == {("G", "1", "role_changed"), ("G", "2", "resigned"), ("G", "3", "joined")}
    assert governance.seat_events(old, new.withColumn("din", F.lit(None).cast("string"))).count() == 0


def test_state(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 2, None)], "k int, at int, v string")
    assert {(r.k, r.v) for r in state.upsert(old, new, ["k"], "at").collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert {(r.k, r.v) for r in state.coalesce_upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    log = spark.createDataFrame([(1, "open", 1, None), (1, "closed", 2, 5.0), (2, "open", 1, None), (2, "deleted", 3, None)], "id int, status string, at int, price double")
    assert [(r.id, r.status, r.close_price) for r in portfolio.latest_state(log).collect()] == [(1, "closed", 5.0)]


def test_row_order_is_free(spark):
    from equiloom.sources import domain

    d = "/root/testdata/sf0.001"
    a = signals.features(domain.bars(spark, d))
    b = signals.features(domain.bars(spark, d).repartition(7).orderBy(F.rand(3)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_stream(spark, tmp_path):
    from equiloom.streaming.seats import seat_event_stream, signal_counts

    schema = "ticker string, person_id string, din string, designation string"
    spark.createDataFrame([("G", "1", "1", "Managing Director")], schema).write.parquet(str(tmp_path / "in"))
    old = spark.createDataFrame([("G", "1", "1", "Director")], schema)
    seen = []
    q = seat_event_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: old, lambda ev, _: seen.extend(ev.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [(r.ticker, r.event_type) for r in seen] == [("G", "role_changed")]
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "a")], "ts timestamp, event_type string")
    assert signal_counts(events).count() == 1


def test_loose_and(spark):
    """Places of whole phrases, and the least distance of two different ones."""
    blurb = "Copper here, copper again" + " x" * 100 + " wires, coppersmith and wires near copper"
    far = text.loose_and_distance(F.lit(blurb), ["copper", "wires"])
    assert one(spark, text.term_places(F.lit(blurb), "copper")) == [0, 13, blurb.rindex("copper")]
    assert one(spark, far) == blurb.rindex("copper") - blurb.rindex("wires")
    assert one(spark, text.loose_and_distance(F.lit("copper only"), ["copper", "wires"])) is None


@pytest.mark.parametrize(
    ("title", "name", "symbol", "want"),
    [
        ("Sarfaraz Khan in, Dhruv Jurel out for IND vs SL Tests", "Dhruv Consultancy Services Limited", "DHRUV", False),
        ("Dhruv Consultancy wins NHAI road contract worth Rs 120 crore", "Dhruv Consultancy Services Limited", "DHRUV", True),
        ("Atam Valves bags export order from Middle East", "Atam Valves", "ATAM", True),
        ("IIIT professor develops ATAM dance teaching tool", "Atam Valves", "ATAM", False),
    ],
)
def test_headlines(spark, title, name, symbol, want):
    assert one(spark, text.headline_names(F.lit(title), F.lit(name), F.lit(symbol))) is want


def test_money(spark):
    for said, crore in (("12.5 Cr", 12.5), ("50 lac", 0.5), ("300k", 0.003), ("1,00,00,000", 1.0), ("", 0.0)):
        assert one(spark, num.parse_value_cr(F.lit(said))) == crore
    assert one(spark, num.log_weight(F.lit(0.0))) == 0.5
