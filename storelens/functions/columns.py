"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero, on a decimal so that ties are real ties."""
    return F.round(_col(c).cast("decimal(38,10)"), digits).cast("double")


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """Round ties to the even digit, as the data-frame operators report."""
    return F.bround(_col(c).cast("decimal(38,10)"), digits).cast("double")


def money_sum(c: Column | str) -> Column:
    """Sum of an amount, exact for decimals, rounded to cents."""
    return F.round(F.sum(_col(c)), 2).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as a double, NULL where den is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def share_pct(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole at two digits."""
    return round_half_up(F.try_divide(100.0 * _col(part).cast("double"), _col(whole).cast("double")))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact seconds between two zoneless timestamps, free of the session zone."""
    return (_col(later) - _col(earlier)).cast("interval second").cast("decimal(18,6)")


def whole_days_between(later: Column | str, earlier: Column | str) -> Column:
    """Days rounded down, so two hours early is -1."""
    return F.floor(seconds_between(later, earlier) / SECONDS_PER_DAY).cast("int")


def city_label(city: Column | str = "customer_city", state: Column | str = "customer_state") -> Column:
    """`city (ST)`."""
    return F.concat(_col(city), F.lit(" ("), _col(state), F.lit(")"))


def short_id(c: Column | str, n: int = 10) -> Column:
    """The first n characters followed by an ellipsis, for display."""
    return F.concat(F.substring(_col(c).cast("string"), 1, n), F.lit("..."))


def hash_number(*parts: Column | str) -> Column:
    """A number in [0, 2^32) from the md5 of the parts; the same on every engine."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_fraction(*parts: Column | str) -> Column:
    """A reproducible stand-in for a uniform draw in [0, 1)."""
    return hash_number(*parts) / F.lit(2.0**32)
