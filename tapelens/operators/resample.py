"""Daily bars to weekly and monthly bars."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import week_end


def _first(c: str):
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)


def _last(c: str):
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)


def _roll_up(bars: DataFrame, key, name: str) -> DataFrame:
    """First/last skip nulls, as a period's open is its first known open."""
    aggs = [
        _first("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        _last("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.max("date").alias("last_date"),
    ]
    aggs += [_last(c) for c in ("adj_close", "price") if c in bars.columns]
    return bars.groupBy("ticker", key.alias(name)).agg(*aggs)


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Bars per Friday week, traded weeks only."""
    return _roll_up(bars, week_end("date"), "week_end")


def monthly_bars(bars: DataFrame) -> DataFrame:
    """Bars per calendar month, traded months only (R2)."""
    return _roll_up(bars, F.last_day("date"), "month_end")


def weekly_spine(weekly: DataFrame) -> DataFrame:
    """Add the empty weeks between traded ones, with null prices and zero volume.

    Each traded week emits itself and the empty weeks up to the next traded one,
    so the spine costs one window on data already keyed by ticker and no join.
    """
    w = Window.partitionBy("ticker").orderBy("week_end")
    until = F.coalesce(F.date_sub(F.lead("week_end").over(w), 7), F.col("week_end"))
    spread = weekly.withColumn("_until", until).withColumn(
        "_week", F.explode(F.sequence("week_end", "_until", F.expr("interval 7 days")))
    )
    traded = F.col("_week") == F.col("week_end")
    keep = [c for c in weekly.columns if c not in ("ticker", "week_end", "volume")]
    return spread.select(
        "ticker",
        F.col("_week").alias("week_end"),
        traded.alias("traded"),
        *[F.when(traded, F.col(c)).alias(c) for c in keep if c != "_until"],
        F.when(traded, F.col("volume")).otherwise(F.lit(0.0)).alias("volume"),
    )
