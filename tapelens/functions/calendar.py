"""Period keys and period text."""
from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: first day of the longest history on offer.
EARLIEST = date(2003, 1, 1)


def week_end(c) -> Column:
    """Friday that closes the week of a date."""
    return F.next_day(F.date_sub(c, 1), "FRI")


def month_number(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c)


def period_start(period: str, today: date) -> date:
    """First day of ``3y``, ``6mo``, ``10d`` or ``max`` counted back from today."""
    m = re.fullmatch(r"(-?\d+)(mo|y|d)", str(period).strip().lower())
    if m is None:
        return EARLIEST
    n = int(m.group(1))
    days = {"mo": n * 31, "y": n * 365 + n // 4, "d": n}[m.group(2)]
    return today - timedelta(days=days)


def rebalance_calendar(days: DataFrame, day: str = "date") -> DataFrame:
    """Last traded day of each Friday week: (week_end, as_of)."""
    return days.groupBy(week_end(day).alias("week_end")).agg(F.max(day).alias("as_of"))
