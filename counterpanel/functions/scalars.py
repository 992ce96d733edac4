"""Column expressions and driver-side scalars shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAIN_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def present(value: Column) -> Column:
    """True for a usable number: neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def member(value: Column, pool: Iterable[str]) -> Column:
    """Membership flag that is FALSE (not NULL) for a NULL value."""
    return F.coalesce(value.isin(list(pool)), F.lit(False))


def is_post(t: Column, treatment_date: Column) -> Column:
    """Post-treatment flag, FALSE when either date is NULL."""
    return F.coalesce(t >= treatment_date, F.lit(False))


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Closed date range whose bounds are both optional."""
    return (start.isNull() | (t >= start)) & (end.isNull() | (t <= end))


def shift_back(day: Column, periods: Column, grain: str = "month") -> Column:
    """Move a date back by whole periods; month ends clamp to the shorter month."""
    if grain == "day":
        return F.date_sub(day, periods.cast("int"))
    return F.add_months(day, -periods.cast("int") * F.lit(GRAIN_MONTHS[grain]))


def round_to_step(value: Column, decimals: int) -> Column:
    """Half-even rounding to the number of decimals of a grid step."""
    return F.bround(value, decimals)


def step_decimals(step: float) -> int:
    """Decimals of a grid step, also for steps that print in scientific form."""
    if not 0 < step < 1:
        raise ValueError(f"step must be a number between 0 and 1. Got {step}.")
    return max(0, -Decimal(str(step)).normalize().as_tuple().exponent)


def pct_change(value: Column, base: Column) -> Column:
    """Percent change, NULL where the base is zero or missing."""
    return F.try_divide(value - base, base) * F.lit(100.0)


def placebo_tag(shift: Column) -> Column:
    """'FALSE' for the real treatment date, 'time_<n>' for a placebo shift."""
    return F.when(shift == 0, F.lit("FALSE")).otherwise(
        F.concat(F.lit("time_"), shift.cast("string"))
    )


def joined_key(*parts: Column) -> Column:
    """Text key of several columns; length prefixes keep it free of collisions."""
    pieces = []
    for part in parts:
        text = F.coalesce(part.cast("string"), F.lit(""))
        pieces += [F.length(text).cast("string"), text]
    return F.concat_ws("|", *pieces)


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t: closed form for 1 and 2 degrees of freedom,
    otherwise bisection on the CDF from the finite trigonometric series."""
    if df == 1:
        return math.tan(math.pi * (p - 0.5))
    if df == 2:
        a = 2 * p - 1
        return a * math.sqrt(2 / (1 - a * a))

    def cdf(x: float) -> float:
        angle = math.atan(x / math.sqrt(df))
        c2 = math.cos(angle) ** 2
        if df % 2:
            term, total = math.cos(angle), math.cos(angle)
            for k in range(3, df - 1, 2):
                term *= c2 * (k - 1) / k
                total += term
            return 0.5 + (angle + math.sin(angle) * total) / math.pi
        term = total = 1.0
        for k in range(2, df - 1, 2):
            term *= c2 * (k - 1) / k
            total += term
        return 0.5 + math.sin(angle) * total / 2

    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2
