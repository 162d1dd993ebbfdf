"""Tables of HTML pages and facts of XML filings, whole texts at a time through
Arrow; what the rows and facts mean is decided by expressions and joins after.

Cases: a null or empty text has no row; a page of any nesting, with tags left
open, is read to its end; a filing that is no XML has one row of kind `bad`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from equiloom.functions import text
from equiloom.functions.memory import each_text, give_back

_SPACE = re.compile(r"\s+")
_VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}
HTML_ROW = "tbl int, row int, cells array<string>, data array<string>, marked boolean, title string, anchor string"
RECORDS = 4096  # in a batch that goes back
FACT = "kind string, context string, tag string, value double, place int, ends string, member boolean"


_TAG = "\0"  # stands where a tag was


def _plain(parts: list[str], gap: str = "") -> str:
    return _SPACE.sub(" ", "".join(parts).replace(_TAG, gap)).strip()


class _Tables(HTMLParser):
    """Rows of all tables. A row has the cells of tables within it too, and a
    cell all text within it; a new cell or row ends one that was left open."""

    def __init__(self, mark: str):
        super().__init__(convert_charrefs=True)
        self.mark, self.rows, self.count, self.open = mark, [], 0, []  # open: ("table" | "tr" | "td" | "a", record)

    def _end(self, kinds: tuple[str, ...], within: str) -> None:
        """Close the innermost open element of these kinds, unless a `within`
        begins inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in kinds:
                del self.open[i:]
                return
            if self.open[i][0] == within:
                return

    def _each(self, kind: str):
        return (r for k, r in self.open if k == kind)

    def _noted(self, said: str) -> None:
        if self.mark in said.lower():
            for r in self._each("tr"):
                r["marked"] = True

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(("table", {"table": self.count, "rows": 0}))
            self.count += 1
        elif tag == "tr" and self.open:
            self._end(("tr",), "table")
            row = {"at": [], "cells": [], "marked": False, "title": None, "anchor": None}
            for t in self._each("table"):
                row["at"].append((t["table"], t["rows"]))
                t["rows"] += 1
            self.rows.append(row)
            self.open.append(("tr", row))
        self._gap()
        if tag in ("td", "th") and any(self._each("tr")):
            self._end(("td",), "tr")
            cell = (tag, [])
            for r in self._each("tr"):
                r["cells"].append(cell)
            self.open.append(("td", cell))
        named = {k: v or "" for k, v in attrs}
        self._noted(" ".join(named.values()))
        said = re.match(r"(?i)(.+?)\s+share price", named.get("title", ""), re.S)
        for r in self._each("tr"):
            if said and r["title"] is None:
                r["title"] = said[1].strip()
            if tag == "a" and self.mark in named.get("class", "").lower() and r["anchor"] is None:
                r["anchor"] = []
                self.open.append(("a", r["anchor"]))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("table", "tr", "a"):
            self._end((tag,), "" if tag == "table" else "table")
        elif tag in ("td", "th"):
            self._end(("td",), "table")
        self._gap()

    def _gap(self):
        for _, parts in self._each("td"):
            parts.append(_TAG)

    def handle_data(self, data):
        self._noted(data)
        data = data.replace(_TAG, " ")
        for _, parts in self._each("td"):
            parts.append(data)
        for parts in self._each("a"):
            parts.append(data)


def _html_rows(page: str, mark: str) -> Iterator[dict]:
    reader = _Tables(mark)
    reader.feed(page)
    reader.close()
    for r in reader.rows:
        cells = [_plain(parts) for _, parts in r["cells"]]
        data = [_plain(parts, " ") for tag, parts in r["cells"] if tag == "td"]
        for table, row in r["at"]:
            yield {
                "tbl": table, "row": row, "cells": cells, "data": data, "marked": r["marked"], "title": r["title"],
                "anchor": None if r["anchor"] is None else _plain(r["anchor"]),
            }


def _through(df: DataFrame, column: str, keep: list[str], form: str, read: Callable[[str], Iterator[dict]]) -> DataFrame:
    """The kept columns beside each record that `read` makes of the text."""
    kept, more = df.select(*keep).schema.fields, T.StructType.fromDDL(form).fields
    schema = T.StructType([*kept, *more])
    made = to_arrow_schema(T.StructType(more))
    n = len(kept)

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, x in enumerate(each_text(batch.column(n))):
                for record in read(x) if x else ():
                    at.append(i)
                    found.append(record)
                    if len(found) >= RECORDS:
                        yield out(batch, at, found)
                        at, found = [], []
            if found:
                yield out(batch, at, found)
            del batch, at, found
            give_back()

    def out(batch, at, found):
        rows = batch.select(range(n)).take(pa.array(at))  # without the texts, which would be copied for each record
        return pa.RecordBatch.from_arrays([*rows.columns, *pa.RecordBatch.from_pylist(found, schema=made).columns], names=schema.names)

    return df.select(*keep, F.col(column).alias("_text")).mapInArrow(run, schema)


def html_rows(df: DataFrame, column: str, *keep: str, mark: str = "stockrow") -> DataFrame:
    """Every table row of a page: table and row number, its cells, those that
    are no headings, whether `mark` occurs in it, the title that names a share
    price, and the text of a link of class `mark`."""
    return _through(df, column, list(keep), HTML_ROW, lambda page: _html_rows(page, mark))


# Headings of a board's table by what they begin with or hold.
_BOARD = {"name": "^name of the director", "din": "^din", "cat1": "category 1", "cat2": "category 2", "cat3": "category 3", "title": "^title", "status": "current status"}
DUMMY_DINS = ("99999999", "00000000")


def active(status: Column) -> Column:
    said = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return ~(said.contains("inactive") | said.contains("cessation") | (said == "no"))


def board_tables(rows: DataFrame, *keys: str) -> DataFrame:
    """Board seats of each page's first table that has any: one of its first
    eight rows names its columns; numbers once each, actives only. Expects
    `html_rows`."""
    low = F.transform("cells", F.lower)
    heads = rows.where((F.col("row") < 8) & F.array_join(low, " | ").contains("din") & F.array_join(low, " | ").contains("name of the director"))
    # Of several matching cells the last counts; a cell has the first meaning that fits.
    meaning = F.transform(low, lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(k)) for k, p in _BOARD.items()]))
    place = lambda k: F.when(F.array_contains("m", k), F.size("m") - F.array_position(F.reverse("m"), k)).cast("int").alias(k)
    head = heads.select(*keys, "tbl", F.col("row").alias("_h"), meaning.alias("m")).select(*keys, "tbl", "_h", *map(place, _BOARD))
    head = head.groupBy(*keys, "tbl").agg(F.min_by(F.struct("_h", *_BOARD), "_h").alias("c")).where("c.name is not null and c.din is not null")
    cell = lambda k: F.get("cells", F.col(f"c.{k}"))
    j = rows.join(head, [*keys, "tbl"]).where((F.col("row") > F.col("c._h")) & (F.size("cells") > F.greatest(*[F.col(f"c.{k}") for k in _BOARD])))
    seats = j.select(*keys, "tbl", "row", text.norm_din(cell("din")).alias("din"), text.nonempty(cell("name")).alias("director"), text.designation_of(cell("cat1"), cell("cat2"), cell("cat3")).alias("designation"),
                     text.infer_category(F.concat_ws(" ", *map(cell, ("cat1", "cat2", "cat3")))).alias("category"), cell("status").alias("status"))
    seats = seats.where(F.col("din").isNotNull() & ~F.col("din").isin(*DUMMY_DINS) & F.col("director").isNotNull() & active(F.col("status")))
    once = seats.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "tbl", "din").orderBy("row"))).where("_r = 1")
    return once.withColumn("_t", F.min("tbl").over(Window.partitionBy(*keys))).where("tbl = _t").select(*keys, "din", "director", "designation", "category")


def _number(x: Column, drop: str = ",") -> Column:
    """An empty cell is zero, anything else that is no number null."""
    bare = F.trim(F.regexp_replace(x, f"[{drop}]", ""))
    return F.when(bare == "", F.lit(0.0)).otherwise(bare.try_cast("double"))


def value_crore(x: Column) -> Column:
    """An amount in crore: `cr`, `lac`, `k`, or a bare amount in rupees."""
    raw = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), ",", "")
    unit = lambda u: F.regexp_extract(raw, rf"([\d.]+)\s*{u}", 1)
    amount = lambda u: F.coalesce(unit(u).try_cast("double"), F.lit(0.0))
    bare = F.coalesce(raw.try_cast("double") / 1e7, F.lit(0.0))
    return F.when(unit("cr") != "", amount("cr")).when(unit("lac") != "", amount("lac") / 100).when(unit("k") != "", amount("k") / 100000).otherwise(bare)


def holding_rows(rows: DataFrame, holder: str, *keys: str) -> DataFrame:
    """Holdings on an investor's pages: marked rows in either of two layouts,
    a portfolio (amount, quantity, change, shares in percent) or a search result
    (holder, price, quantity, percent, change, amount); of a company by its
    normalized name the greatest amount, the later of equals. `holder` is a
    column of the page. Expects `html_rows`."""
    named = F.coalesce(F.col("title"), F.col("anchor"))
    own = F.filter(F.transform("data", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.exists(F.slice("data", F.lit(1), s["i"] + 1), lambda y: y != ""))
    cells = F.transform(own, lambda s: s["x"])  # empty cells before the first are no cells
    r = rows.where("marked").withColumn("c", cells)
    called = F.nullif(F.coalesce(named, F.lit("")), F.lit(""))
    r = r.withColumn("c", F.when(called.isNull(), F.col("c")).when(F.size("c") == 0, F.array(called)).otherwise(F.concat(F.array(called), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))))))
    at = lambda i: F.get("c", F.lit(i))
    n, crore = F.size("c"), F.coalesce(F.lower(at(1)).contains("cr"), F.lit(False))
    numbers = _number(at(2)).isNotNull() & _number(at(3)).isNotNull() & (n <= 9)
    layout = F.when(n >= 10, "portfolio").when((n >= 7) & numbers, "search").when((n >= 4) & crore, "portfolio").otherwise("search")
    r = r.withColumn("layout", layout).where(F.coalesce(at(0), F.lit("")) != "").where((n >= 7) | ((F.col("layout") == "portfolio") & (n >= 5)))
    search = F.col("layout") == "search"
    pick = lambda a, b: F.when(search, a).otherwise(b)
    value, held = value_crore(pick(at(6), at(1))), _number(pick(at(3), at(2)))
    quantity = F.floor(F.abs(held)) * F.signum(held)
    change = F.trim(pick(at(5), F.regexp_replace(at(3), "%", "")))
    moved = change.try_cast("double")
    kind = F.when(F.upper(change) == "NEW", "new").when(moved > 0, "increased").when(moved < 0, "decreased").otherwise("unchanged")
    percent = pick(at(4), F.get(F.filter(F.slice("c", F.lit(5), F.greatest(n - 4, F.lit(0))), lambda x: x.contains("%")), F.lit(0)))
    price = pick(_number(at(2)), F.when((quantity != 0) & (value != 0), value * 1e7 / quantity))
    out = r.select(
        *keys, "tbl", "row", at(0).alias("company"), F.when(search & (F.coalesce(at(1), F.lit("")) != ""), at(1)).otherwise(F.col(holder)).alias("holder"), price.alias("price"), quantity.alias("quantity"),
        _number(percent, "%+").alias("pct"), F.when(~(F.upper(change) == "NEW"), moved).alias("change"), kind.alias("change_type"), value.alias("value_cr"),
    )
    best = Window.partitionBy(*keys, text.norm_name(F.col("company"))).orderBy(F.desc("value_cr"), F.desc("tbl"), F.desc("row"))
    return out.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "tbl", "row")


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _facts(filing: str) -> Iterator[dict]:
    none = dict.fromkeys(("context", "tag", "value", "ends", "member"))
    try:
        root = ElementTree.fromstring(filing.strip().encode())
    except ElementTree.ParseError:
        yield none | {"kind": "bad", "place": 0}
        return
    for place, x in enumerate(root.iter()):
        said = "".join(x.itertext()).strip() if x.get("contextRef") or _local(x.tag) == "context" else ""
        if _local(x.tag).lower() == "context":
            ends = [("".join(y.itertext())).strip()[:10] for y in x.iter() if _local(y.tag).lower() == "enddate"]
            member = any(_local(y.tag).lower().endswith("member") for y in x.iter())
            yield none | {"kind": "context", "context": x.get("id"), "place": place, "ends": ([e for e in ends if e] or [None])[-1], "member": member}
        elif x.get("contextRef") is not None:
            try:
                value = float(said.replace(",", "").replace("_", "x"))
            except ValueError:
                continue
            if value - value == 0:
                yield none | {"kind": "fact", "context": x.get("contextRef"), "tag": _local(x.tag), "value": value, "place": place}


def facts(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Contexts (end of period, whether a member of a dimension) and numeric
    facts of filings, in document order."""
    return _through(df, column, list(keep), FACT, _facts)


# Tags of a figure, the preferred first, of the two kinds of filings.
INTEGRATED = {
    "revenue": ("RevenueFromOperations",),
    "net_income": ("ProfitLossForPeriod", "ProfitLossForPeriodFromContinuingOperations"),
    "eps": ("DilutedEarningsLossPerShareFromContinuingOperations", "BasicEarningsLossPerShareFromContinuingOperations", "DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations"),
    "ebit": ("SegmentProfitLossBeforeTaxAndFinanceCosts", "ProfitBeforeInterestAndFinanceCosts", "ProfitFromOperationsBeforeOtherIncomeInterestAndExceptionalItems", "ProfitBeforeExceptionalItemsAndTax"),
    "other_income": ("OtherIncome",),
}
CORPORATE = {
    "revenue": ("RevenueFromOperations", "Revenue"),
    "net_income": ("ProfitLossForThePeriod", "ProfitLossForPeriod", "ProfitLossForPeriodFromContinuingOperations", "ProfitLossForThePeriodFromContinuingOperations"),
    "eps": ("DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "DilutedEarningsLossPerShareFromContinuingOperations", "BasicEarningsLossPerShareFromContinuingOperations"),
    "ebit": ("ProfitBeforeExceptionalAndExtraordinaryItemsAndTax", "ProfitBeforeTax", "ProfitBeforeExtraordinaryItemsAndTax"),
    "other_income": ("OtherIncome",),
}


def period_figures(found: DataFrame, tags: dict[str, tuple[str, ...]], *keys: str, contexts: tuple[str, ...] = ("OneD",), fallback: str | None = None) -> DataFrame:
    """One row a filing and context: facts meet the context they name; of a
    figure's tags the first that is there counts, of a tag the last fact. The
    end is the context's, or the first context's, or the filing's (`fallback`,
    a column); without an end, or without revenue, net income and EPS, none."""
    f = found.where((F.col("kind") == "fact") & F.col("context").isin(*contexts))
    used = [t for ts in tags.values() for t in ts]
    last = F.max_by("value", "place")
    by_tag = f.where(F.col("tag").isin(*used)).groupBy(*keys, "context", "tag").agg(last.alias("value"))
    figure = lambda ts: F.coalesce(*[F.max(F.when(F.col("tag") == t, F.col("value"))) for t in ts])
    wide = by_tag.groupBy(*keys, "context").agg(*[figure(ts).alias(k) for k, ts in tags.items()])
    c = found.where((F.col("kind") == "context") & F.col("context").isin(*contexts) & F.col("ends").isNotNull())
    ends = c.groupBy(*keys, "context").agg(F.max_by("ends", "place").alias("ends"))
    first = ends.where(F.col("context") == contexts[0]).select(*keys, F.col("ends").alias("_first"))
    j = wide.join(ends, [*keys, "context"], "left").join(first, list(keys), "left")
    end = F.coalesce("ends", "_first", *([F.col(fallback).cast("string")] if fallback else []))
    return j.select(*keys, "context", end.try_cast("date").alias("period_end"), *tags).where("period_end is not null and (revenue is not null or net_income is not null or eps is not null)")
