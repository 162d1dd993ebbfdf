"""Parsers over odd documents: known cases, by hand or by Python's json."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from equiloom.sources import deal_files, json_walk, markup, parsers


def one(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, v string")


# --- JSON ---


def walked(doc, wanted):
    """Objects in arrays whose first name that is not null is wanted."""
    out = []

    def open_(node, depth):
        for x in node.values() if isinstance(node, dict) else node:
            if isinstance(node, list) and isinstance(x, dict):
                name = next((x[n] for n in json_walk.NAMES if x.get(n) is not None), None)
                name = name if isinstance(name, str) else None if name is None or isinstance(name, (dict, list)) else json.dumps(name)
                if name is not None and name.strip() in wanted:
                    out.append((name.strip(), depth + 1))
            if isinstance(x, (dict, list)):
                open_(x, depth + 1)

    if isinstance(doc, (dict, list)):
        open_(doc, 0)
    return sorted(out)


def test_json_objects_at_any_depth(spark):
    draw = random.Random(4)

    def make(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.25:
            return draw.choice(["a", "b}", '{"name":"a"}', 'x"y', "[", None, 3, True, ""])
        if kind < 0.6:
            return [make(depth - 1) for _ in range(draw.randint(0, 3))]
        keys = draw.sample([*json_walk.NAMES, "x", "y.z", "q\"r"], draw.randint(0, 4))
        return {k: draw.choice(["a", "b}", " a ", None, 3]) if draw.random() < 0.5 else make(depth - 1) for k in keys}

    docs = [make(5) for _ in range(200)] + [[{"name": "a", "in": [{"label": "a", "held": {"deep": [[{"desc": "b}"}]]}}]}]]
    texts = [json.dumps(d) for d in docs] + ["{", "", None, "no json"]
    found: dict = {}
    for r in json_walk.named_objects(one(spark, *texts), "v", "k", wanted=lambda n: n.isin("a", "b}")).collect():
        found.setdefault(r.k, []).append((r["name"], r.depth))
    want = {i: w for i, d in enumerate(docs) if (w := walked(d, {"a", "b}"}))}
    assert {k: sorted(v) for k, v in found.items()} == want
    assert len(want) > 20


# --- pages ---

HEAD = "<tr><th>Sr</th><th>Name of  the Director</th><th>DIN</th><th>Category 1</th><th>Current Status</th></tr>"


def test_board_tables(spark):
    pages = [
        f"<table>{HEAD}<tr><td>1</td><td><b>A. Alder</b></td><td>1234</td><td>Chairperson</td><td></td></tr><tr><td>2<td>B. Birch<td>5678<td>Independent<td>Inactive</table>",
        f"<table><tr><td>x</td></tr></table><table><tr><td>Outer</td></tr><tr><td><table>{HEAD}<tr><td>1</td><td>C &amp; D</td><td>din 9</td><td>-</td><td>NA</td></tr><tr><td>1</td><td>Again</td><td>00000009</td><td>-</td><td></td></tr><tr><td>short</td></tr><tr><td>1</td><td>Dummy</td><td>99999999</td><td></td><td></td></tr></table></td></tr></table>",
        "<table><tr><th>DIN</th></tr><tr><td>1</td></tr></table>", "", None, "<table><tr><td>never closed", "<td>alone</td></tr></table>",
        f"<table>{'<tr><td>x</td></tr>' * 8}{HEAD}<tr><td>1</td><td>Late</td><td>7</td><td></td><td></td></tr></table>",
    ]
    got = sorted(tuple(r) for r in markup.board_tables(markup.html_rows(one(spark, *pages), "v", "k"), "k").collect())
    assert got == [(0, "00001234", "A. Alder", "Chairperson", ""), (1, "00000009", "C & D", "Director", "")]


def test_cells_of_nested_and_open_tables(spark):
    page = "<table><tr><td>a<table><tr><td>b<td>c</table>d<tr><th>e <i>f</i></table>"
    rows = sorted((r.tbl, r.row, tuple(r.cells), tuple(r.data)) for r in markup.html_rows(one(spark, page), "v", "k").collect())
    assert rows == [(0, 0, ("abcd", "b", "c"), ("a b c d", "b", "c")), (0, 1, ("b", "c"), ("b", "c")), (0, 2, ("e f",), ()), (1, 0, ("b", "c"), ("b", "c"))]


def test_holding_rows_of_two_layouts(spark):
    td = lambda *cs: "".join(f"<td>{c}</td>" for c in cs)
    pages = [
        f"<table><tr class='stockrow'>{td('', 'Old Works Ltd', '1,250.5 Cr', '1,00,000', 'NEW', '-', '2.5%')}</tr><tr class=stockrow>{td('Old Works', '1250.5 cr', '50', '-1.5%', '-', '-')}</tr><tr>{td('Not marked', '9 Cr', '1', '1', '1')}</tr></table>",
        f"<table><tr class='stockrow'><td></td><td><a title='Good Food Share Price' href=x>gf</a></td>{td('H. Older', '12.5', '400', '+1.2%', '0.3', '75 lac')}</tr><tr class='StockRow'>{td('Short', '1', '2')}</tr></table>",
        f"<table><tr class='stockrow'>{td('Ten', '2 k', '7.9', 'x', '', '1%', '', '', '', 'z')}</tr></table>",
    ]
    rows = markup.html_rows(one(spark, *pages).withColumn("who", F.lit("Holder")), "v", "k", "who")
    got = {(r.k, r.company): r for r in markup.holding_rows(rows, "who", "k", "who").collect()}
    assert set(got) == {(0, "Old Works"), (1, "Good Food"), (2, "Ten")}
    a, b, c = got[0, "Old Works"], got[1, "Good Food"], got[2, "Ten"]
    assert (a.holder, a.value_cr, a.quantity, a.change, a.change_type, a.pct, a.price) == ("Holder", 1250.5, 50.0, -1.5, "decreased", None, 1250.5e7 / 50)
    assert (b.holder, b.price, b.quantity, b.pct, b.change_type, b.value_cr) == ("H. Older", 12.5, 400.0, 1.2, "increased", 0.75)
    assert (c.value_cr, c.quantity, c.change_type, c.pct) == (2 / 100000, 7.0, "unchanged", 1.0)


# --- filings ---


def test_figures_of_contexts(spark):
    ctx = lambda i, end, more="": f"<x:context id='{i}'>{more}<x:period><x:endDate>{end}</x:endDate></x:period></x:context>"
    f = lambda tag, v, c="OneD": f"<f:{tag} contextRef='{c}'>{v}</f:{tag}>"
    doc = lambda *xs: "<x:xbrl xmlns:x='a' xmlns:f='b'>" + "".join(xs) + "</x:xbrl>"
    filings = [
        doc(ctx("OneD", "2024-03-31T00"), ctx("FourD", "2024-03-30"), f("RevenueFromOperations", "1,200.5"), f("ProfitLossForPeriodFromContinuingOperations", 7), f("ProfitLossForPeriod", 5), f("RevenueFromOperations", 9, "FourD"), f("OtherIncome", "n/a")),
        doc(ctx("OneD", ""), f("RevenueFromOperations", 1)), doc(ctx("OneD", "2024-03-31"), f("OtherIncome", 1)), "<broken", "", None, doc(f("ProfitLossForPeriod", "1e400"), f("RevenueFromOperations", 2, "OneD_x"), ctx("OneD", "2024-03-31")),
    ]
    facts = markup.facts(one(spark, *filings), "v", "k")
    got = {(r.k, r.context): (r.period_end, r.revenue, r.net_income, r.eps, r.other_income) for r in markup.period_figures(facts, markup.INTEGRATED, "k", contexts=("OneD", "FourD")).collect()}
    assert got == {(0, "OneD"): (datetime.date(2024, 3, 31), 1200.5, 5.0, None, None), (0, "FourD"): (datetime.date(2024, 3, 30), 9.0, None, None, None)}
    assert [r.k for r in facts.where("kind = 'bad'").collect()] == [3]


def test_filing_lists(spark):
    doc = '[{"qe_Date":"31-MAR-2024","consolidated":"Standalone","xbrl":"http://x/INDAS_a.xml"},{"qe_Date":"31-Mar-2024","consolidated":"Consolidated","xbrl":"https://x/indas_b.xml"},{"qe_Date":"31-Dec-2023","consolidated":"Non","xbrl":"http://x/INDAS_c.xml"},{"qe_Date":"31-Dec-2023","consolidated":"non","xbrl":"http://x/INDAS_d.xml"},{"qe_Date":"30-Sep-2023","xbrl":"-"},{"qe_Date":"?","xbrl":"http://x/INDAS"}]'
    got = parsers.pick_filings(parsers.integrated_filings(one(spark, doc, json.dumps({"data": json.loads(doc)}), None, "x"), "v", "k"), "k").collect()
    want = {("2024-03-31", "https://x/indas_b.xml", True), ("2023-12-31", "http://x/INDAS_c.xml", False)}
    assert {(r.k, str(r.period_end), r.xbrl, r.consolidated) for r in got} == {(k, *w) for k in (0, 1) for w in want}
    older = '[{"toDate":"31-Mar-2024","xbrl":"http://x","relatingTo":"Fourth Quarter","period":"Half Yearly","exchdisstime":"01-May-2024 10:00:00"},{"toDate":"31-Mar-2024","xbrl":"x"}]'
    r = parsers.corporate_filings(one(spark, older), "v", "k").collect()
    assert [(x.half, x.consolidated, x.broadcast_ms) for x in r] == [(True, True, 1714557600000)]


# --- deals ---


def test_headed_files(spark):
    files = ['Date,Symbol,Security Name,Client Name,Buy / Sell,Quantity Traded,Price\r\n05-Mar-2024,abc,"ABC, ""X"" LTD","ALDER, FUND",B,"1,200",10.5\n\n06/03/2024,,XYZ,BIRCH,SELL,50,-', "symbol,date\n A1 ,2024-01-02", "Date,Symbol", "", None]
    got = [tuple(r)[:9] + (r.bad,) for r in deal_files.headed(one(spark, *files), "v", "k").orderBy("k", "line").collect()]
    d = datetime.date
    assert got == [
        (0, 0, d(2024, 3, 5), "ABC", "ABC, X LTD", "ALDER, FUND", "BUY", 1200.0, 10.5, None), (0, 1, d(2024, 3, 6), "", "XYZ", "BIRCH", "SELL", 50.0, None, "no symbol"),
        (1, 0, d(2024, 1, 2), "A1", "", "", "—", None, None, None),
    ]


def test_placed_files_and_messages(spark):
    file = "d,c,n,cl,t,q,p\n01/02/2024,500001,Some Works,ALDER,LTD,B,100,,2.5\n01/02/2024,,Odd,BIRCH,S,7\nx,y\n01/02/2024,5,N, ,S,7,1"
    got = [(r.symbol, r.client, r.side, r.quantity, r.price, r.bad) for r in deal_files.placed(one(spark, file), "v", "k").orderBy("line").collect()]
    assert got == [("500001", "ALDERLTD", "BUY", 100.0, 2.5, None), ("ODD", "S", "7", None, None, "too short"), ("Y", "", "—", None, None, "too short"), ("5", "", "SELL", 7.0, 1.0, "no client")]
    first = '[{"symbol":"abc","clientName":"A","buySell":"BUY","qty":"5","watp":"1.5","date":"05-Mar-2024"},{"clientName":"B"}]'
    r = deal_files.message(one(spark, first, "x", None), "v", False, "k").orderBy("line").collect()
    assert [(x.symbol, x.client, x.quantity, x.price, x.bad) for x in r] == [("ABC", "A", 5.0, 1.5, None), ("", "B", None, None, "no symbol")]
    second = '{"Table":[{"ScripName":"Some Works","ClientName":"A","DealType":"S","Quantity":3}]}'
    r = deal_files.message(one(spark, second, "[]", "<html>"), "v", True, "k").collect()
    assert [(x.symbol, x.client, x.side, x.quantity, x.bad) for x in r] == [("Some", "A", "SELL", 3.0, None)]


@pytest.mark.parametrize("amount,want", [("1,250.5 Cr", 1250.5), ("75 Lac", 0.75), ("50k", 0.0005), ("10000000", 1.0), ("", 0.0), ("x", 0.0), (". cr", 0.0)])
def test_amounts(spark, amount, want):
    assert spark.range(1).select(markup.value_crore(F.lit(amount)).alias("v")).first().v == want
