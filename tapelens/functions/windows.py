"""Window helpers.

Every per-instrument window runs over bars, which hold one row per (ticker, date)
after the print-level pre-aggregation. A window partition is therefore bounded by
the trading calendar however many prints one instrument has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(order: str = "date", key: str = "ticker") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_n(n: int, order: str = "date", key: str = "ticker") -> WindowSpec:
    return series(order, key).rowsBetween(-(n - 1), 0)


def running(order: str = "date", key: str = "ticker") -> WindowSpec:
    return series(order, key).rowsBetween(Window.unboundedPreceding, 0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_mean(c, n: int, **spec) -> Column:
    """Mean of the last n rows, null unless all n are present and non-null."""
    w = last_n(n, **spec)
    return F.when(F.count(_col(c)).over(w) == n, F.avg(_col(c)).over(w))


def full_sum(c, n: int, **spec) -> Column:
    w = last_n(n, **spec)
    return F.when(F.count(_col(c)).over(w) == n, F.sum(_col(c)).over(w))


def sample_std(c, n: int, min_periods: int | None = None, **spec) -> Column:
    """Sample deviation over n rows; a constant frame is null, as no score exists."""
    w = last_n(n, **spec)
    need = n if min_periods is None else min_periods
    spread = F.max(_col(c)).over(w) > F.min(_col(c)).over(w)
    return F.when((F.count(_col(c)).over(w) >= need) & spread, F.stddev_samp(_col(c)).over(w))


def zscore(c, keys: list[str]) -> Column:
    """Population z-score within ``keys``.

    A constant group scores 0 for its non-null members, an all-null group stays
    null. The keys always hold the as-of date, so a group has at most one row per
    instrument and its frame spills like any sort; every score of a date shares one
    shuffle and nothing is joined back.
    """
    c = _col(c).cast("double")
    w = Window.partitionBy(*keys)
    spread = F.max(c).over(w) > F.min(c).over(w)
    return F.when(spread, (c - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(c * 0.0)


def forward_drawdowns(df: DataFrame, price: str, lengths: list[int], window: WindowSpec) -> DataFrame:
    """Largest fall from a running peak over this and the next rows, as ``_fall_<rows>`` per length.

    Spans of 1, 2, 4, ... rows keep their highest and lowest price and their fall; two spans that
    follow each other join into one. All of them read the same ordered window, so nothing is
    collected or sorted again.
    """
    own = df.columns
    df = df.withColumns({"_hi1": F.col(price), "_lo1": F.col(price), "_dd1": F.lit(0.0)})
    size = 1
    while 2 * size <= max(lengths):
        ahead = [F.lead(f"_{x}{size}", size).over(window) for x in ("hi", "lo", "dd")]
        df = df.withColumns(_joined([F.col(f"_{x}{size}") for x in ("hi", "lo", "dd")], ahead, 2 * size))
        size *= 2
    for length in lengths:
        offset, span = 0, None
        for bit in range(length.bit_length() - 1, -1, -1):
            if length >> bit & 1:
                part = [F.lead(f"_{x}{1 << bit}", offset).over(window) for x in ("hi", "lo", "dd")]
                df = df.withColumns(dict(zip(("_a", "_b", "_c"), part)))
                part = [F.col("_a"), F.col("_b"), F.col("_c")]
                step = _joined(span, part, "s") if span is not None else dict(zip(("_his", "_los", "_dds"), part))
                df = df.withColumns(step)
                span = [F.col("_his"), F.col("_los"), F.col("_dds")]
                offset += 1 << bit
        df = df.withColumn(f"_fall_{length}", span[2])
    return df.select(*own, *[f"_fall_{n}" for n in lengths])


def _joined(first: list[Column], second: list[Column], name) -> dict[str, Column]:
    (hi, lo, dd), (hi2, lo2, dd2) = first, second
    return {f"_hi{name}": F.greatest(hi, hi2), f"_lo{name}": F.least(lo, lo2), f"_dd{name}": F.least(dd, dd2, lo2 / hi - 1)}
