"""Scalar helpers, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def money(text) -> Column:
    """A currency string as decimal(18,4): spaces, thousands separators and a leading currency mark go; null if it isn't a number."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.trim(c), r"(?i)^(nt\$|us\$|\$)|,", "").try_cast("decimal(18,4)")


def normal_text(text) -> Column:
    """Lower case, full-width digits and letters made half-width, white space trimmed and single."""
    c = F.col(text) if isinstance(text, str) else text
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    plain = "".join(chr(0x21 + i) for i in range(94)) + " "
    return F.trim(F.regexp_replace(F.lower(F.translate(c, wide, plain)), r"\s+", " "))


def business_date(local, cutoff_hours) -> Column:
    """The trading day of a local time: times before the store's cutoff belong to the day before."""
    local = F.col(local) if isinstance(local, str) else local
    hours = F.lit(cutoff_hours) if isinstance(cutoff_hours, int) else cutoff_hours
    return F.to_date(local - F.make_dt_interval(hours=hours))


def percent_to_ratio(col, unit) -> Column:
    return F.when(F.lit(unit) == "percent", col / 100).otherwise(col)


def unless_sentinel(col, *sentinels) -> Column:
    """Null where the value is one of the contract's stand-ins for "missing"."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~c.isin(*sentinels), c)


def logit(p) -> Column:
    return F.ln(p / (1 - p))


def box_cox(x, lam: float) -> Column:
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x, lam: float) -> Column:
    """The four branches of the Yeo-Johnson transform for a given lambda."""
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def display_number(value, n, decimals: int = 2, small: int = 5) -> Column:
    """Text of a figure for reports: "-" without a sample, "<5" for tiny groups, "N/A" where it can't be computed."""
    return F.when(n.isNull() | (n == 0), "-").when(n < small, f"<{small}").when(value.isNull(), "N/A").otherwise(F.format_number(value, decimals))
