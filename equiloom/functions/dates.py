"""Dates: trading weeks, quarter ends, labels and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trading_friday(d: Column) -> Column:
    """The Friday that a date's trading week is stamped with: Sunday goes
    forward, Saturday back."""
    n = F.dayofweek(d)
    return F.date_add(d, F.when(n == 7, -1).otherwise(6 - n))


def parse_trade_date(x: Column) -> Column:
    """The first of four forms that fits. A form is not tried on a text that it
    cannot fit: a form that fails takes many times as long as one that fits."""
    slash, letter, iso = x.contains("/"), x.rlike("[A-Za-z]"), x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    may = {"d-MMM-yyyy": letter, "d-M-yyyy": ~(slash | letter | iso), "d/M/yyyy": slash, "yyyy-MM-dd": ~(slash | letter)}
    return F.coalesce(*[F.when(ok, F.try_to_date(x, f)) for f, ok in may.items()])


def period_end(label: Column) -> Column:
    """`MMM-yy` to the month's end; February always ends on the 28th."""
    last = F.last_day(F.try_to_date(F.concat(F.lit("01-"), label), "dd-MMM-yy"))
    return F.when(F.month(last) == 2, F.make_date(F.year(last), F.lit(2), F.lit(28))).otherwise(last)


def quarter_label(d: Column) -> Column:
    return F.date_format(d, "MMM yyyy")


def first_quarter_end(half_start: Column) -> Column:
    return F.last_day(F.add_months(half_start, 2))


def held_days(opened: Column, end: Column, zone: str = "Asia/Kolkata") -> Column:
    day = lambda t: F.to_date(F.from_utc_timestamp(t, zone))
    return F.greatest(F.lit(0), F.datediff(day(end), day(opened)))


def fresh(ts: Column, as_of: Column, hours: float) -> Column:
    """Younger than so many hours at an explicit time."""
    return (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) < hours * 3600


def quarter_end_iso(x: Column) -> Column:
    """yyyy-MM-dd of d-MMM-yyyy in any case, spaces ignored; others are null."""
    raw = F.initcap(F.lower(F.regexp_replace(x, "\\s+", "")))
    dashed = F.regexp_extract(F.lower(raw), "^(\\d{1,2})-([a-z]{3})-(\\d{4})$", 2)
    day = F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(raw, "^(\\d{1,2})-", 1), F.initcap(dashed), F.right(raw, F.lit(4))), F.lit("d-MMM-yyyy"))
    return F.when(dashed != "", F.date_format(day, "yyyy-MM-dd"))


def broadcast_ms(x: Column) -> Column:
    """Milliseconds of dd-MMM-yyyy HH:mm:ss in UTC; 0 for others."""
    raw = F.lower(F.trim(x))
    month = F.initcap(F.regexp_extract(raw, "^\\d{2}-([a-z]{3})-\\d{4}\\s+\\d{2}:\\d{2}:\\d{2}$", 1))
    at = F.try_to_timestamp(F.concat(F.substring(raw, 1, 3), month, F.regexp_replace(F.substring(raw, 7, 30), "\\s+", " ")), F.lit("dd-MMM-yyyy HH:mm:ss"))
    return F.coalesce(F.when(month != "", F.unix_millis(at)), F.lit(0).cast("long"))
