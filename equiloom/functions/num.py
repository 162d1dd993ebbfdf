"""Numbers: rounding, clamping, parsing and money units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Market-cap bands in crore: upper bound (exclusive) and code.
CAP_BANDS = ((100, "TI"), (500, "MIC"), (5000, "SC"), (20000, "MC"))
CAP_LABELS = {"TI": "Tiny", "MIC": "Micro", "SC": "Small", "MC": "Mid", "LC": "Large"}


def js_round(x: Column, places: int = 0) -> Column:
    """Half toward plus infinity, as floor(x * 10^k + 0.5) / 10^k."""
    return F.floor(x * float(10**places) + 0.5).cast("double") / float(10**places)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def div(a: Column, b: Column) -> Column:
    """Null where the divisor is null or 0."""
    return F.when(b != 0, a / b)


def cap_tier(mcap: Column) -> Column:
    """Six bands; unknown is NC, zero and below are TI."""
    out = F.when(mcap.isNull(), "NC")
    for bound, code in CAP_BANDS:
        out = out.when(mcap < bound, code)
    return out.otherwise("LC")


def cap_code(mcap: Column) -> Column:
    """The same bands, null where unknown, zero or below."""
    return F.when(mcap > 0, cap_tier(mcap))


def cap_bucket(tier: Column) -> Column:
    return F.when(tier == "LC", "large").when(tier == "MC", "mid").otherwise("small")


def parse_num(x: Column) -> Column:
    """A number with thousands commas; blanks and dashes are null."""
    clean = F.regexp_replace(F.trim(x), ",", "")
    return F.when(~clean.isin("", "-"), clean.try_cast("double"))


def parse_percent(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[%,]", ""), "^\\s+|\\s+$", "").try_cast("double")


def parse_value_cr(x: Column) -> Column:
    """Money text with a unit (cr, lac, k) or in rupees, in crore; 0 for none."""
    raw = F.replace(F.lower(F.regexp_replace(x, "<[^>]*>", " ")), F.lit(","), F.lit(""))
    unit = lambda u: F.nullif(F.regexp_extract(raw, f"([\\d.]+)\\s*{u}", 1), F.lit("")).try_cast("double")
    return F.coalesce(unit("cr"), unit("lac") / 100, unit("k") / 100_000, F.trim(raw).try_cast("double") / 1e7, F.lit(0.0))


def pct_from_decimal(x: Column) -> Column:
    """Shares up to 3 in absolute value count as fractions."""
    return F.when(F.abs(x) <= 3, x * 100).otherwise(x)


def mcap_cr(rupees: Column) -> Column:
    return js_round(rupees / 1e7, 1)


def log_weight(mcap: Column) -> Column:
    """log10(1 + mcap); one half where there is none above 0."""
    return F.when(mcap > 0, F.log10(1 + mcap)).otherwise(0.5)


def saturate(raw: Column, top: float = 70.0, scale: float = 6.0) -> Column:
    return top * (1 - F.exp(-raw / scale))


def yoy_pct(latest: Column, prior: Column) -> Column:
    """Growth in percent, one decimal; null unless the prior value is positive."""
    return F.when(prior > 0, js_round((latest / prior - 1) * 100, 1))


def forward_pe(price: Column, eps: Column) -> Column:
    """Price over four times the last EPS; 999 where none or out of range."""
    pe = price / (eps * 4)
    return F.when(price.isNull() | eps.isNull(), F.lit(None)).when((eps <= 0) | (pe <= 0) | (pe > 500), 999.0).otherwise(js_round(pe, 1))


def trailing_pe(price: Column, eps4: Column) -> Column:
    pe = price / eps4
    return F.when(price.isNull() | eps4.isNull(), F.lit(None)).when((eps4 <= 0) | (pe <= 0) | (pe > 500), 999.0).otherwise(js_round(pe, 1))


def indian_grouping(x: Column) -> Column:
    """Digits grouped 3, then by 2: 1234567 is 12,34,567."""
    digits = F.abs(x).cast("long").cast("string")
    head = F.regexp_replace(digits, "(\\d{3})$", "")
    head = F.reverse(F.regexp_replace(F.reverse(head), "(\\d{2})(?=\\d)", "$1,"))
    tail = F.right(digits, F.lit(3))
    body = F.when(F.length(digits) > 3, F.concat(head, F.lit(","), tail)).otherwise(digits)
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def first_number(*xs: Column) -> Column:
    """The first of the texts that reads as a number."""
    return F.coalesce(*[parse_num(x) for x in xs])


def grouped(x: Column, least: int, most: int) -> Column:
    """A number with Indian grouping and from `least` to `most` decimals."""
    fixed = F.format_string(f"%.{most}f", F.abs(x.cast("double")))
    whole = indian_grouping(F.substring_index(fixed, ".", 1).cast("long"))
    part = F.substring_index(fixed, ".", -1) if most else F.lit("")
    kept = F.concat(F.left(part, F.lit(least)), F.regexp_replace(F.substring(part, least + 1, 20), "0+$", "")) if most else part
    return F.concat(F.when(x < 0, "-").otherwise(""), whole, F.when(kept != "", F.concat(F.lit("."), kept)).otherwise(""))


def _shown(x: Column, said: Column, none: str = "—") -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), none).otherwise(said)


def quarter_value(x: Column, decimals: int) -> Column:
    return _shown(x, grouped(x, 2, 2) if decimals == 2 else grouped(x, 0, 0))


def yoy_shown(x: Column) -> Column:
    return _shown(x, F.concat(F.when(x > 0, "+").otherwise(""), grouped(x, 0, 1), F.lit("%")), "N/M")


def rupees(x: Column) -> Column:
    return _shown(x, F.concat(F.lit("₹"), F.when(x < 10, grouped(x, 2, 2)).otherwise(grouped(x, 0, 2))))


def mcap_shown(x: Column) -> Column:
    return _shown(x, grouped(x, 0, 1))


def pe_shown(x: Column) -> Column:
    return _shown(x, F.when(x >= 500, "N/M").otherwise(grouped(x, 0, 1)))
