"""The equity relations, read from the provided tables.

Each function takes (spark, sf_dir) and returns a DataFrame; `SQL` holds the
same relations as DuckDB common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company master: a supplier is a listed company, its nation the sub-sector."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # nations of the world: bounded
    factor = F.when(k % 4 == 0, 0.01).when(k % 4 == 1, 0.1).when(k % 4 == 2, 1.0).otherwise(5.0)
    return s.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), k.cast("string")).alias("ticker"),
        F.col("s_name").alias("name"),
        F.when(k % 5 == 0, "NSE SME").otherwise("NSE").alias("market"),
        F.col("r_name").alias("sector"),
        F.when(k % 11 != 0, F.col("n_name")).alias("sub_sector"),
        F.when(k % 13 != 0, F.col("s_acctbal") * factor).alias("mcap_cr"),
        F.when(k % 7 != 0, F.col("s_acctbal") / 10).alias("price"),
        F.when(k % 3 != 0, F.concat(F.lit("https://"), F.lower("s_name"), F.lit(".example"))).alias("website"),
        F.when(k % 6 != 0, F.concat_ws(" ", F.col("s_name"), F.lit("makes goods in"), F.col("n_name"))).alias("about"),
        k.alias("k"),
    )


def _place():
    """The order of line items as one number of fixed width, which a hash
    aggregation holds: time, order, line and part, one after another."""
    wide = lambda c: c.cast("decimal(18,0)")
    key = wide(F.col("l_orderkey")) * F.lit(10**10).cast("decimal(11,0)") + wide(F.col("l_linenumber")) * F.lit(10**8).cast("decimal(9,0)") + wide(F.col("l_partkey"))
    return (wide(F.unix_micros(F.col("l_shipdate").cast("timestamp"))) * F.lit("1" + "0" * 20).cast("decimal(21,0)") + key).cast("decimal(38,0)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single prices per supplier: line items with a total order."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        _place().alias("o"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.col("l_quantity").alias("q"),
    )


def _bars(t: DataFrame, *keys: str, unit: str = "week") -> DataFrame:
    day = F.to_date(F.date_trunc(unit, F.col("ts").cast("timestamp"))).alias("date")
    return t.groupBy(*keys, day).agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum(F.col("q").cast("decimal(38,2)")).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars (symbol, date, open, high, low, close, volume)."""
    return _bars(trades(spark, sf_dir), "symbol")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, date, open, high, low, close, volume)."""
    return _bars(trades(spark, sf_dir), "symbol", unit="day")


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the whole market, as one symbol."""
    return _bars(trades(spark, sf_dir), unit="day").select(F.lit("MARKET").alias("symbol"), "*")


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of the whole market."""
    return _bars(trades(spark, sf_dir))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, period_end, revenue, net_income, eps) by calendar quarter."""
    money = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(8,4)"))
    q = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.last_day(F.add_months(F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).cast("date"), 2)).alias("period_end"),
    ).agg(F.sum(money).cast("double").alias("revenue"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("units"))
    net = F.col("revenue") - F.col("units") * 1000
    return q.select("ticker", "period_end", "revenue", net.alias("net_income"), (net / F.col("units")).alias("eps"))


def seats(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Board seats (person_id, din, director, ticker, designation): buyers of 46
    units or more of a supplier sit on its board."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    if until:
        o = o.where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    pair = (
        li.where("l_quantity >= 46").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_suppkey").agg(F.min(F.substring("o_orderpriority", 1, 1).try_cast("int")).alias("p"))
    )
    p = F.col("p")
    role = F.when(p == 1, "Chairperson").when(p == 2, "Managing Director").when(p == 3, "Independent Director").when(p == 4, "Whole-time Director").otherwise("Director")
    din = F.when(F.col("o_custkey") % 2 == 0, F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return pair.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.coalesce(din, F.concat(F.lit("n:"), F.lower("c_name"))).alias("person_id"), din.alias("din"), F.col("c_name").alias("director"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), role.alias("designation"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk deals (trade_date, symbol, client, side, quantity, price, deal_type)."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.to_date("o_orderdate").alias("trade_date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
            F.col("c_name").alias("client"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.when(F.col("l_linestatus") == "O", "block").otherwise("bulk").alias("deal_type"),
            F.col("o_orderkey").alias("o"), F.col("l_linenumber").alias("l"),
        )
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investor holdings (investor, symbol, pct, value, change_type): customers by part brand."""
    o, li, c, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    q = F.col("l_quantity").cast("decimal(18,2)")
    sums = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"), (F.col("o_custkey") % 40).cast("int").alias("investor"), F.col("p_brand").alias("symbol"))
        .agg(F.sum(q).cast("double").alias("shares"), F.sum(F.when(F.col("o_orderdate") < cut, q).otherwise(0)).cast("double").alias("before"),
             F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    )
    late = F.col("shares") - F.col("before")
    kind = F.when(F.col("before") == 0, "new").when(late > F.col("before"), "increased").when(late < F.col("before"), "decreased").otherwise("unchanged")
    return sums.select(F.concat_ws("-", "segment", F.col("investor").cast("string")).alias("investor"), "symbol", "shares", "value", kind.alias("change_type"))


_TRADES = "SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_extendedprice / l_quantity AS p, l_quantity AS q FROM lineitem WHERE l_quantity > 0"
_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey"
_BAR = f"date_trunc('week', ts)::DATE AS date, first(p ORDER BY {_ORDER}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {_ORDER}) AS close, sum(q::DECIMAL(18,2))::DOUBLE AS volume FROM trades"


def _seats(extra: str = "") -> str:
    return f"""SELECT coalesce(din, 'n:' || lower(c_name)) AS person_id, din, c_name AS director, ticker, designation FROM (
 SELECT CASE WHEN o_custkey % 2 = 0 THEN lpad(o_custkey::VARCHAR, 8, '0') END AS din, o_custkey, 'S' || l_suppkey AS ticker,
  CASE substr(min(o_orderpriority), 1, 1) WHEN '1' THEN 'Chairperson' WHEN '2' THEN 'Managing Director' WHEN '3' THEN 'Independent Director' WHEN '4' THEN 'Whole-time Director' ELSE 'Director' END AS designation
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 46 {extra} GROUP BY o_custkey, l_suppkey) JOIN customer ON o_custkey = c_custkey"""


CUT = "1999-01-01"
SQL = {
    "company": """SELECT 'S' || s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'NSE SME' ELSE 'NSE' END AS market, r_name AS sector,
 CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS sub_sector,
 CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal * (CASE s_suppkey % 4 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 1::DOUBLE ELSE 5::DOUBLE END) END AS mcap_cr,
 CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 10 END AS price, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://' || lower(s_name) || '.example' END AS website,
 CASE WHEN s_suppkey % 6 <> 0 THEN s_name || ' makes goods in ' || n_name END AS about, s_suppkey AS k
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "trades": _TRADES,
    "bars": f"SELECT symbol, {_BAR} GROUP BY ALL",
    "bench": f"SELECT {_BAR} GROUP BY ALL",
    "daily": f"SELECT symbol, {_BAR.replace("'week'", "'day'")} GROUP BY ALL",
    "bench_daily": f"SELECT 'MARKET' AS symbol, {_BAR.replace("'week'", "'day'")} GROUP BY ALL",
    "quarters": """SELECT ticker, period_end, revenue, revenue - units * 1000 AS net_income, (revenue - units * 1000) / units AS eps FROM (
 SELECT 'S' || l_suppkey AS ticker, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS period_end,
 sum(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(8,4)))::DOUBLE AS revenue, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS units FROM lineitem GROUP BY ALL)""",
    "seats": _seats(),
    "old_seats": _seats(f"AND o_orderdate < TIMESTAMP '{CUT}'"),
    "deals": """SELECT o_orderdate::DATE AS trade_date, 'S' || l_suppkey AS symbol, c_name AS client, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
 l_quantity AS quantity, l_extendedprice / l_quantity AS price, CASE WHEN l_linestatus = 'O' THEN 'block' ELSE 'bulk' END AS deal_type, o_orderkey AS o, l_linenumber AS l
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "holdings": """SELECT segment || '-' || investor AS investor, symbol, shares, value,
 CASE WHEN before = 0 THEN 'new' WHEN shares - before > before THEN 'increased' WHEN shares - before < before THEN 'decreased' ELSE 'unchanged' END AS change_type FROM (
 SELECT c_mktsegment AS segment, (o_custkey % 40)::INT AS investor, p_brand AS symbol, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS shares,
 sum(CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN l_quantity::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS before, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
}
_NEEDS = {"bars": ["trades"], "bench": ["trades"], "daily": ["trades"], "bench_daily": ["trades"]}


def with_sql(*names: str) -> str:
    """`WITH` and the relations named, those they need first."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
