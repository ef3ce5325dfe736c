"""Exact money sums and small numeric expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

_UNIT = 1_000_000


def exact_sum(value: Column, where: Column | None = None) -> Column:
    """Sum of long values as decimal(38,0).

    Two long sums (millions and remainder) stay in the fast fixed-width aggregate path; the decimal
    appears once per group. Overflow raises under ANSI mode instead of wrapping.
    """
    if where is not None:
        value = F.when(where, value)
    low_part = F.pmod(value, F.lit(_UNIT))
    high = F.sum(F.call_function("div", value - low_part, F.lit(_UNIT)))
    low = F.sum(low_part)
    return (high.cast("decimal(28,0)") * F.lit(_UNIT).cast("decimal(7,0)")
            + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def ratio(top: Column, bottom: Column) -> Column:
    """Double ratio, NULL when the bottom is zero or NULL."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return F.when(old != 0, (new.cast("double") / old.cast("double") - 1) * 100)
