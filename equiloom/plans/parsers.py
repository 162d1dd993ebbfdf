"""Parsers over documents that Spark makes of the given tables: what they read
back is what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.plans.base import query
from equiloom.sources import deal_files as B
from equiloom.sources import domain as D
from equiloom.sources import json_walk as J
from equiloom.sources import markup as M
from equiloom.sources import parsers as P
from equiloom.sources.domain import with_sql as W


def _sorted(struct, key: str):
    return F.transform(F.array_sort(F.collect_list(struct)), lambda r: r[key])


# --- JSON of any shape ---


@query("SELECT conv_id, turn, role AS name, CASE WHEN turn % 2 = 0 THEN 5 ELSE 3 END AS depth, length(text) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL")
def s34_json_walk(spark, d):
    """A turn's object lies in an array within a wanted object's own fields for
    even turns; its text keeps its braces and quotes."""
    t = D.table(spark, d, "conversations").where("text is not null")
    own = F.struct(F.col("role").alias("holderName"), F.col("turn").alias("turn"), F.col("text").alias("desc"), F.struct(F.lit("{not an [object]}").alias("a")).alias("extra"))
    deep = F.struct(F.lit("other").alias("name"), F.struct(F.array(own).alias("inner")).alias("held"))
    docs = t.select("conv_id", F.to_json(F.struct(F.lit("user").alias("name"), F.struct(F.when(F.col("turn") % 2 == 0, F.array(deep)).alias("even"), F.when(F.col("turn") % 2 == 1, F.array(own)).alias("odd")).alias("data"))).alias("v"))
    found = J.named_objects(docs, "v", "conv_id", wanted=lambda n: n.isin("user", "assistant"))
    get = lambda f, t: F.try_variant_get("object", f"$.{f}", t)
    return found.select("conv_id", get("turn", "int").alias("turn"), "name", F.when(F.col("depth") == 3, 3).otherwise(5).alias("depth"), F.length(get("desc", "string")).cast("long").alias("n"))


@query("SELECT event_id, 'k' || k AS name, k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE k % 7 = 0")
def s34_event_props(spark, d):
    e = D.table(spark, d, "events")
    docs = e.select("event_id", F.concat(F.lit('[[{"label":"k'), F.get_json_object("props", "$.k"), F.lit('","props":'), F.col("props"), F.lit('}],"}{"]')).alias("v"))
    found = J.named_objects(docs, "v", "event_id", wanted=lambda n: F.substring(n, 2, 9).try_cast("int") % 7 == 0)
    return found.select("event_id", "name", F.try_variant_get("object", "$.props.k", "int").alias("k"))


# --- tables of pages ---

_TH = "<tr><th>Sr</th><th>Title</th><th> Name of the\n Director</th><th>DIN</th><th>Category 1 of directors</th><th>Category 2</th><th>Current Status</th></tr>"
_NO_DIN = "n.din IS NOT NULL AND n.din NOT IN ('00000000', '99999999')"


@query(W("seats") + f", n AS (SELECT *, right(lpad(din, 8, '0'), 8) AS d8 FROM seats) SELECT ticker, d8 AS din, director, designation FROM n WHERE {_NO_DIN} AND substr(ticker, 2)::BIGINT % 5 <> 4 AND d8::BIGINT % 3 <> 0")
def s30_board_table(spark, d):
    """A company's filing: a page with a table for its layout, in which the
    board's table lies, cells left open, and inactive directors."""
    s = D.seats(spark, d).withColumn("n", F.substring("din", -4, 4).cast("int"))
    gone = F.when(F.col("din").cast("long") % 3 == 0, "Cessation").otherwise(F.when(F.col("din").cast("long") % 3 == 1, "-").otherwise("Active"))
    row = F.concat(F.lit("<tr><td>1<td>Mr<td><b>"), "director", F.lit("</b></td><td>&nbsp;"), F.coalesce("din", F.lit("")), F.lit("</td><td>"), "designation", F.lit("</td><td> <i>-</i>"), F.lit("</td><td>"), F.coalesce(gone, F.lit("")), F.lit("</td></tr>"))
    head = F.when(F.substring("ticker", 2, 9).cast("long") % 5 == 4, _TH.replace("DIN", "Number")).otherwise(_TH)
    pages = s.groupBy("ticker").agg(F.concat(F.lit("<html><script>var t='<tr>';</script><table><tr><td>Annexure</td></tr></table><table class=x>"), F.first(head), F.array_join(_sorted(F.struct("person_id", row.alias("r")), "r"), "\n"), F.lit("</table><table>" + _TH + "<tr><td>later tables do not count</td></tr></table></html>")).alias("html"))
    return M.board_tables(M.html_rows(pages, "html", "ticker"), "ticker").select("ticker", "din", "director", "designation")


_HOLD_SQL = """, r AS (SELECT investor, symbol, round(value / 1e7, 4)::DECIMAL(18,4) AS cr, shares::BIGINT AS q, row_number() OVER (PARTITION BY investor ORDER BY symbol) AS i, change_type, abs(hash(investor)) AS x, length(investor) % 2 AS kind FROM holdings WHERE shares >= 1)
SELECT investor, symbol AS company, q::DOUBLE AS quantity, cr::DOUBLE AS value_cr, CASE change_type WHEN 'increased' THEN 'increased' WHEN 'decreased' THEN 'decreased' WHEN 'new' THEN 'new' ELSE 'unchanged' END AS change_type FROM r"""


@query(W("holdings") + _HOLD_SQL)
def s32_row_extract(spark, d):
    """An investor's page in one of two layouts; each holding also stands in an
    earlier row with a smaller amount, which gives way."""
    h = D.holdings(spark, d).where("shares >= 1")
    cr, q = F.round(F.col("value") / 1e7, 4).cast("decimal(18,4)"), F.format_number(F.floor("shares"), 0)
    change = F.when(F.col("change_type") == "new", "NEW").when(F.col("change_type") == "increased", "1.5").when(F.col("change_type") == "decreased", "-0.5").otherwise("-")
    td = lambda *cs: F.concat(*[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cs])
    name = F.concat(F.lit('<td><a class="x stockrow" href="#">'), F.regexp_replace("symbol", "#", "&#35;"), F.lit("</a></td>"))
    amount = lambda x: F.concat(x.cast("string"), F.lit(" Cr"))
    portfolio = lambda x: F.concat(F.lit("<tr>"), name, td(amount(x), q, change, F.lit("-"), F.lit("1.25%")), F.lit("</tr>"))
    search = lambda x: F.concat(F.lit("<TR class='StockRow'><td></td>"), name, td(F.lit("Holder & Co"), F.lit("12.5"), q, F.lit("1.25%"), change, amount(x)), F.lit("</TR>"))
    row = F.when(F.length("investor") % 2 == 1, F.concat(portfolio(F.lit(0)), portfolio(cr))).otherwise(F.concat(search(F.lit(0)), search(cr)))
    pages = h.groupBy("investor").agg(F.concat(F.lit("<table><tr><th>Stock</th></tr>"), F.array_join(_sorted(F.struct("symbol", row.alias("r")), "r"), ""), F.lit("</table>")).alias("html"))
    return M.holding_rows(M.html_rows(pages, "html", "investor"), "investor", "investor").select("investor", "company", "quantity", "value_cr", "change_type")


@query("SELECT page_id, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(html, '<li>')))) AS n_rows, url AS first_cell FROM pages WHERE html IS NOT NULL AND contains(html, '<li>')")
def s32_page_rows(spark, d):
    """Whole pages whose lists are made tables: rows and cells are counted in
    the midst of their other markup."""
    p = D.table(spark, d, "pages").where("html is not null")
    table = F.replace(F.replace(F.replace(F.replace("html", F.lit("<ul>"), F.lit("<table>")), F.lit("</ul>"), F.lit("</table>")), F.lit("<li>"), F.concat(F.lit("<tr><td>"), "url", F.lit("</td><td>"))), F.lit("</li>"), F.lit("</td></tr>"))
    rows = M.html_rows(p.select("page_id", table.alias("html")), "html", "page_id")
    return rows.where(F.size("cells") == 2).groupBy("page_id").agg(F.count("*").alias("n_rows"), F.min(F.get("cells", F.lit(0))).alias("first_cell"))


# --- filings ---


def _filing(*facts):
    """A filing's text: contexts of the quarter and the year to date, one of a
    member, and facts of each."""
    ctx = lambda i, end, more="": F.concat(F.lit(f"<i:context id='{i}'><i:entity><i:identifier>x</i:identifier>{more}</i:entity><i:period><i:startDate>2000-01-01</i:startDate><i:endDate>"), end, F.lit("</i:endDate></i:period></i:context>"))
    end = F.col("period_end").cast("string")
    member = "<i:segment><d:explicitMember dimension='d:x'>A</d:explicitMember></i:segment>"
    return F.concat(F.lit("<?xml version='1.0'?><i:xbrl xmlns:i='urn:i' xmlns:d='urn:d' xmlns:f='urn:f'>"), ctx("OneD", end), ctx("FourD", end), ctx("OneD_A", F.lit("1999-01-01"), member), *facts, F.lit("</i:xbrl>"))


def _fact(tag: str, value, context: str = "OneD"):
    return F.coalesce(F.concat(F.lit(f"<f:{tag} contextRef='{context}' decimals='2'>"), value.cast("string"), F.lit(f"</f:{tag}>")), F.lit(""))


@query(W("quarters") + " SELECT ticker, period_end, revenue, net_income, eps FROM quarters")
def s28_xbrl(spark, d):
    """Every quarter as a filing and back, among facts of other contexts and of
    tags that give way."""
    q = D.quarters(spark, d)
    noise = [_fact("RevenueFromOperations", F.lit(1), "OneD_A"), _fact("ProfitLossForPeriodFromContinuingOperations", F.lit(2)), _fact("NameOfCompany", F.col("ticker")), _fact("BasicEarningsLossPerShareFromContinuingOperations", F.lit(3))]
    facts = [*noise, _fact("RevenueFromOperations", F.lit(9)), _fact("RevenueFromOperations", F.col("revenue")), _fact("ProfitLossForPeriod", F.col("net_income")), _fact("DilutedEarningsLossPerShareFromContinuingOperations", F.col("eps")), _fact("RevenueFromOperations", F.lit(7), "FourD")]
    docs = q.select("ticker", F.col("period_end").alias("filed"), _filing(*facts).alias("v"))
    return M.period_figures(M.facts(docs, "v", "ticker", "filed"), M.INTEGRATED, "ticker", "filed").select("ticker", "period_end", "revenue", "net_income", "eps")


@query(W("quarters") + " SELECT ticker, period_end, context, CASE context WHEN 'OneD' THEN revenue ELSE revenue * 2 END AS revenue, CASE context WHEN 'OneD' THEN net_income END AS net_income FROM quarters, (VALUES ('OneD'), ('FourD')) AS c(context)")
def s28_corporate_xbrl(spark, d):
    """The other kind of filing: the year to date beside the quarter, whose end
    the filing tells where no context does."""
    q = D.quarters(spark, d)
    body = F.concat(F.lit("<xbrl>"), _fact("Revenue", F.col("revenue")), _fact("ProfitLossForThePeriod", F.col("net_income")), _fact("Revenue", F.col("revenue") * 2, "FourD"), F.lit("</xbrl>"))
    docs = q.select("ticker", F.col("period_end").alias("filed"), F.replace(F.replace(body, F.lit("<f:"), F.lit("<")), F.lit("</f:"), F.lit("</")).alias("v"))
    out = M.period_figures(M.facts(docs, "v", "ticker", "filed"), M.CORPORATE, "ticker", "filed", contexts=("OneD", "FourD"), fallback="filed")
    return out.select("ticker", "period_end", "context", "revenue", "net_income")


def _filings(spark, d):
    """A company's list of filings: two of a quarter in some quarters."""
    q = D.quarters(spark, d)
    day = F.upper(F.date_format("period_end", "d-MMM-yyyy"))
    url = lambda c: F.concat(F.lit("https://x.example/INDAS_"), F.col("period_end").cast("string"), F.lit(f"_{c}.xml"))
    month = F.month("period_end")
    alone = F.struct(day.alias("qe_Date"), F.lit("Non-Consolidated").alias("consolidated"), url("s").alias("xbrl"))
    whole = F.struct(day.alias("qe_Date"), F.lit("Consolidated").alias("consolidated"), url("c").alias("xbrl"))
    broken = F.struct(F.lit("soon").alias("qe_Date"), F.lit("Consolidated").alias("consolidated"), url("b").alias("xbrl"))
    other = F.struct(day.alias("qe_Date"), F.lit("Consolidated").alias("consolidated"), F.lit("-").alias("xbrl"))
    some = F.when(month == 3, F.array(alone, whole)).when(month == 6, F.array(alone, broken)).when(month == 9, F.array(other)).otherwise(F.array(whole))
    return q.groupBy("ticker").agg(F.to_json(F.struct(F.flatten(_sorted(F.struct("period_end", some.alias("s")), "s")).alias("data"))).alias("v"))


@query(W("quarters") + " SELECT ticker, period_end, 'https://x.example/INDAS_' || period_end || CASE WHEN month(period_end) = 6 THEN '_s.xml' ELSE '_c.xml' END AS xbrl, month(period_end) <> 6 AS consolidated FROM quarters WHERE month(period_end) <> 9")
def s41_filings(spark, d):
    """Filings with a document that can be read, one a quarter: the consolidated
    one, or else the first."""
    return P.pick_filings(P.integrated_filings(_filings(spark, d), "v", "ticker"), "ticker")


@query(W("quarters") + " SELECT ticker, period_end, month(period_end) IN (3, 9) AS half, epoch_ms(period_end::TIMESTAMP) + 45296000 AS broadcast_ms FROM quarters")
def s41_corporate_filings(spark, d):
    q = D.quarters(spark, d)
    one = F.struct(F.date_format("period_end", "dd-MMM-yyyy").alias("toDate"), F.lit("x").alias("fromDate"), F.lit("https://x.example/a.xml").alias("xbrl"), F.when(F.month("period_end").isin(3, 9), "Second Half Yearly").otherwise("Quarterly").alias("relatingTo"), F.date_format("period_end", "dd-MMM-yyyy 12:34:56").alias("broadCastDate"))
    docs = q.groupBy("ticker").agg(F.to_json(_sorted(F.struct("period_end", one.alias("o")), "o")).alias("v"))
    return P.corporate_filings(docs, "v", "ticker").select("ticker", "period_end", "half", "broadcast_ms")


@query(W("quarters") + ", z AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS i FROM quarters) SELECT ticker, CASE WHEN month(period_end) = 2 THEN make_date(year(period_end), 2, 28) ELSE period_end END AS period_end, revenue, floor(revenue * 12.5 / 100 * 100 + 0.5) / 100 AS ebit, net_income FROM z WHERE i <= 3")
def s29_results_json(spark, d):
    """The last three quarters as JSON within JSON, and back."""
    q = D.quarters(spark, d)
    row = F.struct(F.date_format("period_end", "MMM-yy").alias("p"), "revenue", "net_income")
    last = q.groupBy("ticker").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("period_end", row.alias("r"))))), 1, 3).alias("s"))
    get = lambda f: F.transform("s", lambda x: x["r"][f])
    inner = F.to_json(F.struct(get("p").alias("periods"), get("revenue").alias("sales"), F.transform("s", lambda x: F.lit(12.5)).alias("opm"), get("net_income").alias("np")))
    docs = last.select("ticker", F.to_json(F.struct(inner.alias("d"))).alias("v"))
    return P.results_json(docs, "v", "ticker")


@query(W("seats") + " SELECT ticker, person_id, director, designation, CASE WHEN designation = 'Independent Director' THEN 'Independent' WHEN designation IN ('Managing Director', 'Whole-time Director') THEN 'Executive' ELSE '' END AS category FROM (SELECT ticker, coalesce(right(lpad(din, 8, '0'), 8), 'n:' || trim(regexp_replace(lower(director), '[^a-z0-9]+', ' ', 'g'))) AS person_id, director, designation, din FROM seats) WHERE coalesce(din, '0')::BIGINT % 5 <> 4")
def s31_board_json(spark, d):
    """A company's board as a document, former directors among it."""
    s = D.seats(spark, d)
    one = F.struct(F.col("director").alias("name"), F.coalesce("din", F.lit("-")).alias("din"), "designation", F.when(F.coalesce("din", F.lit("0")).cast("long") % 5 == 4, "Inactive since {2024}").otherwise("Active").alias("status"))
    docs = s.groupBy("ticker").agg(F.to_json(F.struct(F.concat(F.lit("NSE:"), F.col("ticker")).alias("symbol"), _sorted(F.struct("person_id", one.alias("o")), "o").alias("data"))).alias("v"))
    return P.board_json(docs, "v")


@query("SELECT feed, 'Item <' || item_id || '> & more' AS title, 'https://x.example/' || item_id AS link, TIMESTAMP '2024-01-01 06:00:00' + (item_id % 600) * INTERVAL 1 MINUTE AS published FROM (SELECT item_id, item_id % 4 AS feed, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS i FROM benchmark) WHERE i <= 20")
def s33_feed(spark, d):
    """Feeds of benchmark items, of which the first twenty count."""
    b = D.table(spark, d, "benchmark")
    at = F.timestamp_seconds(F.lit(1704088800) + (F.col("item_id") % 600) * 60)
    item = F.concat(F.lit("<item><title>Item &lt;"), F.col("item_id").cast("string"), F.lit("&gt; &amp; more</title><link>https://x.example/"), F.col("item_id").cast("string"), F.lit("</link><pubDate>"), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit("</pubDate></item>"))
    docs = b.groupBy((F.col("item_id") % 4).alias("feed")).agg(F.concat(F.lit("<rss><channel><title>no item</title>"), F.array_join(_sorted(F.struct("item_id", item.alias("x")), "x"), ""), F.lit("</channel></rss>")).alias("v"))
    return P.feed_items(docs, "v", "feed").select("feed", "title", "link", F.col("published").cast("timestamp_ntz").alias("published"))


@query(W("company") + " SELECT ticker, name, CASE WHEN mcap_cr > 0 THEN mcap_cr END AS mcap_cr FROM company WHERE k % 3 <> 2 AND k % 7 <> 6")
def s35_listings(spark, d):
    """Listings of a sector: groups with blanks, delisted ones, and each scrip
    twice in different case."""
    c, k = D.company(spark, d), F.col("k")
    one = lambda t, cap: F.struct(t.alias("scrip_id"), F.col("name").alias("scrip_name"), F.when(k % 7 == 6, "Delisted").otherwise("Active").alias("status"), F.when(k % 3 == 0, "M ").when(k % 3 == 1, "MT").otherwise("A").alias("grp"), cap.alias("mcap"))
    docs = c.groupBy("sector").agg(F.to_json(F.flatten(_sorted(F.struct("k", F.array(one(F.col("ticker"), F.col("mcap_cr")), one(F.lower("ticker"), F.lit(0.0))).alias("a")), "a"))).alias("v"))
    return P.listings(docs, "v")


# --- deal files ---


def _files(spark, d, row, *keys):
    """Deals of a day and kind as one text of lines."""
    x = D.deals(spark, d).withColumn("file", F.concat_ws("/", F.col("trade_date").cast("string"), "deal_type"))
    return x.groupBy("file", *keys).agg(_sorted(F.struct("o", "l", row.alias("r")), "r").alias("rows"))


_DEALS = W("deals") + ", x AS (SELECT * FROM deals)"


@query(_DEALS + " SELECT trade_date || '/' || deal_type AS file, trade_date, CASE WHEN o % 11 = 3 THEN '' ELSE symbol END AS symbol, client || ', Fund' AS client, side, quantity, CASE WHEN o % 7 = 2 THEN NULL ELSE quantity * 2 END AS price, CASE WHEN o % 11 = 3 THEN 'no symbol' END AS bad FROM x")
def s23_deal_csv(spark, d):
    """Files with their columns in either of two orders; lines without a symbol
    are told apart."""
    day, q = F.date_format("trade_date", "dd-MMM-yyyy"), F.format_number("quantity", 2)
    symbol, client = F.when(F.col("o") % 11 == 3, "").otherwise(F.lower("symbol")), F.concat(F.lit('"'), "client", F.lit(', Fund"'))
    price = F.when(F.col("o") % 7 == 2, "-").otherwise((F.col("quantity") * 2).cast("string"))
    quoted = F.concat(F.lit('"'), q, F.lit('"'))
    first = F.concat_ws(",", day, symbol, F.lit('"A, LTD"'), client, F.left("side", F.lit(1)), quoted, price)
    second = F.concat_ws(" , ", client, "side", quoted, price, F.lit("A"), symbol, F.date_format("trade_date", "dd/MM/yyyy"))
    bulk = F.col("deal_type") == "bulk"
    files = _files(spark, d, F.when(bulk, first).otherwise(second), "deal_type")
    head = F.when(bulk, "Date,Symbol,Security Name,Client Name,Buy / Sell,Quantity Traded,Trade Price / Wght. Avg. Price").otherwise("Client , Buy/Sell, Quantity,Avg,Security, SYMBOL ,Deal Date")
    texts = files.select("file", F.concat(head, F.lit("\r\n\n"), F.array_join("rows", "\r\n")).alias("v"))
    return B.headed(texts, "v", "file").select("file", "trade_date", "symbol", "client", "side", "quantity", "price", "bad")


@query(_DEALS + " SELECT trade_date || '/' || deal_type AS file, trade_date, CASE WHEN o % 5 = 1 THEN strftime(trade_date, '%d/%m/%Y') ELSE (540000 + o)::VARCHAR END AS symbol, CASE WHEN o % 11 = 3 THEN '' ELSE client || 'LTD' END AS client, side, quantity, CASE WHEN o % 13 = 5 THEN NULL ELSE quantity END AS price, CASE WHEN o % 11 = 3 THEN 'no client' END AS bad FROM x")
def s24_placed_csv(spark, d):
    """Files with fixed places and stray commas."""
    q = F.col("quantity").cast("string")
    code = F.when(F.col("o") % 5 == 1, " ").otherwise((F.col("o") + 540000).cast("string"))
    client = F.when(F.col("o") % 11 == 3, " ").otherwise(F.concat("client", F.lit(",LTD")))
    row = F.concat_ws(",", F.date_format("trade_date", "dd/MM/yyyy"), code, F.lit('"Some Works"'), client, F.left("side", F.lit(1)), q, F.when(F.col("o") % 13 == 5, F.lit("-")).otherwise(F.concat(F.lit(","), q)))
    texts = _files(spark, d, row).select("file", F.concat(F.lit("Deal Date,Code,Name,Client,Type,Quantity,Price\n"), F.array_join("rows", "\n")).alias("v"))
    return B.placed(texts, "v", "file").select("file", "trade_date", "symbol", "client", "side", "quantity", "price", "bad")


@query(_DEALS + " SELECT trade_date || '/' || deal_type AS file, trade_date, CASE WHEN o % 3 = 0 THEN 'Some' ELSE symbol END AS symbol, client, side, quantity, CASE WHEN deal_type = 'bulk' THEN quantity END AS price FROM x")
def s24_message(spark, d):
    """Messages whose fields go by several names, as an array or in a table."""
    bulk = F.col("deal_type") == "bulk"
    none = F.lit(None).cast("string")
    day = F.date_format("trade_date", "yyyy-MM-dd")
    row = F.struct(
        F.when(F.col("o") % 3 > 0, F.lower("symbol")).alias("ScripCode"), F.lit("Some Works").alias("scrip_name"), F.when(bulk, F.col("client")).alias("client_name"), F.when(~bulk, F.col("client")).alias("clientName"),
        F.when(bulk, day).alias("deal_date"), F.when(~bulk, day).alias("DealDate"), F.left("side", F.lit(1)).alias("type"), F.when(bulk, F.col("quantity")).alias("Quantity"), F.when(~bulk, F.col("quantity")).alias("qty"), F.when(bulk, F.col("quantity").cast("string")).otherwise(none).alias("price"),
    )
    files = _files(spark, d, row, "deal_type")
    texts = files.select("file", F.when(bulk, F.to_json("rows")).otherwise(F.to_json(F.struct(F.col("rows").alias("Table")))).alias("v"))
    return B.message(texts, "v", True, "file").where("bad is null").select("file", "trade_date", "symbol", "client", "side", "quantity", "price")


@query("SELECT DISTINCT c_mktsegment, replace(c_mktsegment, 'A', 'ALTD') || '1,2 LTD' AS mended FROM customer")
def t26_mended(spark, d):
    c = D.table(spark, d, "customer").select("c_mktsegment").distinct()
    return c.select("c_mktsegment", F.concat(F.replace("c_mktsegment", F.lit("A"), F.lit("A,LTD")), F.lit("1,,2, LTD")).alias("v")).select("c_mktsegment", B.mended("v").alias("mended"))


