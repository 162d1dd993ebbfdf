"""Files of bulk and block deals of two exchanges, one text a file.

The first exchange's files name their columns in a heading, in any order; the
second's have fixed places. A line is a row that is read or, with the reason, a
bad line; neither is dropped.

Cases: a null or empty text, or one of a heading alone, has no row; numbers and
dates that cannot be read are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.functions import dates, num, text

# What a column's heading holds, and the names of a field in the
# two exchanges' messages, the preferred first.
HEADINGS = {"date": ("date",), "symbol": ("symbol",), "security": ("security",), "client": ("client",), "side": ("buy", "sell"), "quantity": ("quantity",), "price": ("price", "avg")}
FIRST = {
    "date": ("date", "tradeDate", "trade_date"), "symbol": ("symbol", "Symbol"), "security": ("secName", "securityName", "name"), "client": ("clientName", "client_name"),
    "side": ("buySell", "buy_sell", "side"), "quantity": ("quantity", "qty", "QuantityTraded"), "price": ("tradePrice", "watp", "avgPrice", "TradePrice/Wght.Avg.Price"),
}
SECOND = {
    "date": ("deal_date", "DealDate", "date", "trade_date"), "symbol": ("scrip_cd", "ScripCode", "scripcode", "symbol"), "security": ("scrip_name", "ScripName", "securityName", "security_name"),
    "client": ("client_name", "ClientName", "clientName"), "side": ("deal_type", "DealType", "buy_sell", "type"), "quantity": ("quantity", "Quantity", "qty"), "price": ("price", "Price", "avg_price"),
}


def _lines(column: str) -> Column:
    return F.filter(F.transform(F.split(column, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")


def _fields(line: Column) -> Column:
    """Cells parted by commas outside quotes, without the quotes."""
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def _deal(get, exchange: str, keep: list[str], symbol: Column, bad: Column) -> list:
    return [
        *keep, dates.parse_trade_date(get("date")).alias("trade_date"), symbol.alias("symbol"), F.coalesce(get("security"), F.lit("")).alias("security"), F.coalesce(get("client"), F.lit("")).alias("client"),
        text.normalize_side(F.coalesce(get("side"), F.lit(""))).alias("side"), num.parse_num(get("quantity")).alias("quantity"), num.parse_num(get("price")).alias("price"), F.lit(exchange).alias("exchange"), bad.alias("bad"),
    ]


def headed(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Deals of files with headings; `bad` says why a line is none."""
    cells = F.transform(F.split(F.get("l", F.lit(0)), ","), lambda h: F.lower(F.trim(h)))
    holds = lambda h, ws: reduce(lambda a, b: a | b, [h.contains(w) for w in ws])
    place = lambda ws: (F.array_position(F.transform("h", lambda h: holds(h, ws)), True) - 1).cast("int")
    x = df.select(*keep, _lines(column).alias("l")).where(F.size("l") >= 2).withColumn("h", cells)
    x = x.select(*keep, *[place(ws).alias(f"_{k}") for k, ws in HEADINGS.items()], F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("line", "v"))
    x = x.select(*keep, "line", *[f"_{k}" for k in HEADINGS], _fields(F.col("v")).alias("c"))
    get = lambda k: F.when(F.col(f"_{k}") >= 0, F.get("c", F.col(f"_{k}")))
    symbol = F.upper(F.coalesce(get("symbol"), F.lit("")))
    return x.select(*_deal(get, "first", [*keep, "line"], symbol, F.when(symbol == "", F.lit("no symbol"))))


def mended(column: str) -> Column:
    """Stray commas of the second exchange's files."""
    out = F.replace(F.col(column), F.lit(",,"), F.lit(","))
    return F.replace(F.replace(out, F.lit(",LTD"), F.lit("LTD")), F.lit(", LTD"), F.lit(" LTD"))


def placed(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Deals of files with fixed places: date, code, security, client, side,
    quantity, price."""
    x = df.select(*keep, mended(column).alias("_t")).select(*keep, _lines("_t").alias("l")).where(F.size("l") >= 2)
    x = x.select(*keep, F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("line", "v"))
    x = x.withColumn("c", F.transform(F.split("v", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    where = {k: i for i, k in enumerate(("date", "code", "security", "client", "side", "quantity", "price"))}
    get = lambda k: F.get("c", F.lit(where[k]))
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    code = F.upper(some(get("code"), get("date")))
    symbol = F.when(code != "", code).otherwise(F.left(F.coalesce(get("security"), F.lit("")), F.lit(12)))
    bad = F.when(F.size("c") < 6, F.lit("too short")).when(some(get("client")) == "", F.lit("no client"))
    return x.select(*_deal(get, "second", [*keep, "line"], symbol, bad))


def message(df: DataFrame, column: str, second: bool, *keep: str) -> DataFrame:
    """Deals of a message: an array of objects, or one under Table or table
    (second exchange), whose fields go by several names."""
    rows = lambda c: F.from_json(c, "array<map<string,string>>")
    whole = rows(F.col(column))
    if second:
        inside = F.coalesce(F.get_json_object(column, "$.Table"), F.get_json_object(column, "$.table"))
        whole = F.when(F.trim(column).startswith("["), whole).otherwise(rows(inside))
    x = df.select(*keep, F.posexplode(whole).alias("line", "m"))
    names = SECOND if second else FIRST
    # Looked up row by row here, each once; what reads them finds a column.
    said = F.transform(F.array(*[F.array(*map(F.lit, ns)) for ns in names.values()]), lambda ns: F.trim(F.get(F.filter(F.transform(ns, lambda n: F.try_element_at("m", n)), lambda v: v.isNotNull()), F.lit(0))))
    x = x.select(*keep, "line", said.alias("c"))
    get = lambda k: F.get("c", F.lit(list(names).index(k)))
    symbol, security, client = (F.upper(F.coalesce(get("symbol"), F.lit(""))), F.coalesce(get("security"), F.lit("")), F.coalesce(get("client"), F.lit("")))
    if not second:
        return x.select(*_deal(get, "first", [*keep, "line"], symbol, F.when(symbol == "", F.lit("no symbol"))))
    first = F.substring_index(security, " ", 1)
    called = F.when(symbol != "", symbol).when(first != "", first).otherwise(F.lit("—"))
    return x.select(*_deal(get, "second", [*keep, "line"], called, F.when(client == "", F.lit("no client"))))
