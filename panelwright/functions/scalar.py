"""Column helpers shared by every operator.  A missing value is always NULL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and both infinities become NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def positive(x) -> Column:
    """Only finite values above zero survive."""
    x = finite(x)
    return F.when(x > 0, x)


def ratio(a, b) -> Column:
    """Division; a zero denominator gives NULL instead of an error."""
    return F.try_divide(col(a), col(b))


def clip(x, lo=None, hi=None) -> Column:
    """Bound a value; a missing value stays missing (``greatest`` alone would not)."""
    x = col(x)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def all_present(*xs) -> Column:
    return reduce(lambda a, b: a & b, [col(x).isNotNull() for x in xs])


def strict_max(*xs) -> Column:
    """Row-wise maximum that is missing if any input is missing."""
    cols = [col(x) for x in xs]
    return F.when(all_present(*cols), F.greatest(*cols))


def category_code(x, mapping: dict) -> Column:
    """Map category labels onto ordinals; unknown labels are missing."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.element_at(F.create_map(*pairs), col(x))


def label_or(x, default: str = "unknown") -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(default))


def to_number(x) -> Column:
    """Lenient numeric cast: unreadable or non-finite text becomes NULL."""
    return finite(col(x).try_cast("double"))


def to_day(x) -> Column:
    """Lenient date cast."""
    return col(x).try_cast("date")


def local_day(ts, zone: str = "Asia/Tokyo") -> Column:
    """Calendar day of an instant in the exchange's zone, with the zone dropped."""
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def accounting_basis(document) -> Column:
    """Text after the statement marker of a document type; NULL without marker."""
    parts = F.split(col(document), "FinancialStatements_", 2)
    return F.when(F.size(parts) == 2, parts[1])


def fixed_bins(x, edges, labels) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; outside values are missing."""
    x = col(x)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > F.lit(lo)) & (x <= F.lit(hi)), F.lit(label)).otherwise(out)
    return out


def first_argmax(names, columns=None) -> Column:
    """Name of the largest of several columns, the first one winning ties."""
    columns = [col(c) for c in (columns or names)]
    top = F.greatest(*columns)
    return F.coalesce(*[F.when(c == top, F.lit(n)) for n, c in zip(names, columns)])


def rounded(x, digits: int = 8) -> Column:
    """Rounded double without negative zero.

    The value is first moved up by about a thousandth of the last digit, so that
    exact halves round alike whatever order their sums were taken in.
    """
    nudge = 1.37 * 10.0 ** -(digits + 3)
    return F.round(col(x).cast("double") + F.lit(nudge), digits) + F.lit(0.0)


def day_text(x="date") -> Column:
    return F.date_format(col(x), "yyyy-MM-dd")


def normal_density(x) -> Column:
    return F.exp(-col(x) * col(x) / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x) -> Column:
    """Distribution function of the standard normal, absolute error below 1e-14.

    The power series around zero times the density; beyond 8.5 deviations the
    value is 0 or 1 to that error.
    """
    x = F.greatest(F.least(col(x), F.lit(8.5)), F.lit(-8.5))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step)["total"]
    return F.greatest(F.least(0.5 + normal_density(x) * series, F.lit(1.0)), F.lit(0.0))


def normal_quantile(p) -> Column:
    """Quantile of the standard normal for ``0 < p < 1``; NULL elsewhere.

    Newton steps from the middle on the upper half, where the distribution
    function is concave, so they never pass the quantile.  The error is that
    of the distribution function over the density: below 1e-9 up to five
    deviations.
    """
    p = col(p)
    upper = F.greatest(p, 1 - p)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.lit(0.0), lambda x, _k: x + (upper - normal_cdf(x)) / normal_density(x))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -x).otherwise(x))
