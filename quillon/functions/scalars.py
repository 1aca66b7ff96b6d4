"""Column helpers whose null, zero and calendar rules all operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` where it is a number; null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where undefined or not finite."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def period_key(date: Column, months: int = 1) -> Column:
    """First day of the calendar bucket of ``months`` months that holds ``date``."""
    if months == 1:
        return F.trunc(date, "MM")
    month = (F.floor((F.month(date) - 1) / months) * months + 1).cast("int")
    return F.make_date(F.year(date), month, F.lit(1))


def clip(x: Column, low: Column, high: Column) -> Column:
    """``x`` within [low, high]; a null stays null, a null bound is open."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def masked(mask: Column, x: Column) -> Column:
    return F.when(mask, x)


def in_universe(industry: Column, prefix: str | None) -> Column:
    """Whether a row belongs to a sub-universe, by the start of its industry; no prefix means all."""
    return F.lit(True) if prefix is None else F.coalesce(industry.startswith(prefix), F.lit(False))


def tenor_years(label: Column) -> Column:
    """``"18M"`` to 1.5; null without digits."""
    digits = F.regexp_extract(label, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("double") / 12)


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null columns of a row; null if there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, n.cast("double"))


def compound(x: Column) -> Column:
    """Product of 1 + x over a group or frame, less 1; nulls count as 0, an empty group gives 0."""
    return F.coalesce(F.product(x + 1), F.lit(1.0)) - 1


def quarter_label(date: Column) -> Column:
    return F.format_string("%dQ%d", F.year(date), F.quarter(date))
