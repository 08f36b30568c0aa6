"""The end-to-end plans: score now, and replay every rebalance date at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import rebalance_calendar
from ..operators.flow import flow_indicators
from ..operators.pillars import daily_pillars, eligible, week_close_indicators, with_faber, year_return
from ..operators.scoring import composite, flow_composite, neutral_lanes
from ..operators.states import with_state
from ..session import staged
from ..sources.tables import BAR_COLUMNS, BENCH, CASH, TOP_PER_CLASS, days_from_prints, prints, ticker_class, with_price


def day_table(spark, root: str) -> DataFrame:
    """Bars and sums of every ticker and day: aggregated from prints once, then read by every branch."""
    return staged(spark, root, "days", lambda: days_from_prints(prints(spark, root)))


def priced_bars(spark, root: str) -> DataFrame:
    """The bars of the day table."""
    return with_price(day_table(spark, root).select(*BAR_COLUMNS))


def panel_calendar(b: DataFrame) -> DataFrame:
    """Rebalance dates of the price panel: it starts once every instrument has a price."""
    first = b.groupBy("ticker").agg(F.min("date").alias("_first")).agg(F.max("_first")).scalar()
    return rebalance_calendar(b.where(F.col("date") >= first).select("date"))


def daily_readings(b: DataFrame) -> DataFrame:
    """Every daily indicator in one chain of windows over one shuffle of the bars."""
    return flow_indicators(with_faber(daily_pillars(b.withColumn("year_return", year_return()))))


def snapshots(
    b: DataFrame, calendar: DataFrame, bench: str = BENCH, cash: str = CASH, klass: Column | None = None
) -> DataFrame:
    """Indicators and flow of every instrument as known at every rebalance date.

    An instrument's row holds from its own last traded week until its next one, so
    each row is spread over the weeks it covers; no date re-scans history. Cash and
    the benchmark's history length are read inside the date's cross-section.
    """
    rows = week_close_indicators(daily_readings(b), bench)
    w = Window.partitionBy("ticker").orderBy("week_end")
    end = calendar.agg(F.max("week_end")).scalar()
    rows = rows.withColumn("_until", F.date_sub(F.lead("week_end").over(w), 7))
    rows = rows.withColumn("_until", F.greatest(F.coalesce("_until", end), F.col("week_end")))
    spread = rows.select(
        *[c for c in rows.columns if c not in ("week_end", "_until")],
        F.explode(F.sequence("week_end", "_until", F.expr("interval 7 days"))).alias("week_end"),
    )
    dated = spread.join(calendar, "week_end")
    day = Window.partitionBy("as_of")
    cash_return = F.max(F.when(F.col("ticker") == cash, F.col("year_return"))).over(day)
    dated = dated.withColumn("antonacci", (F.col("year_return") > cash_return).cast("int"))
    return eligible(dated, cash).withColumn("class", ticker_class() if klass is None else klass)


def replay(b: DataFrame, calendar: DataFrame | None = None, top_n: int = TOP_PER_CLASS) -> DataFrame:
    """Score and state at every rebalance date with neutral provider lanes."""
    calendar = panel_calendar(b) if calendar is None else calendar
    snap = flow_composite(neutral_lanes(snapshots(b, calendar)))
    return with_state(composite(snap, top_n=top_n))


def latest(scored: DataFrame) -> DataFrame:
    """The newest cross-section."""
    return scored.where(F.col("as_of") == scored.agg(F.max("as_of")).scalar())


def targets(scored: DataFrame) -> DataFrame:
    """Equal weight over the selected instruments of each date."""
    picked = scored.where("selected").select("as_of", "ticker")
    size = picked.groupBy("as_of").agg(F.count("*").alias("_n"))
    return picked.join(size, "as_of").select("as_of", "ticker", (1.0 / F.col("_n")).alias("weight"))


def brand_calendar(spark, root: str) -> DataFrame:
    return staged(spark, root, "calendar", lambda: panel_calendar(priced_bars(spark, root)))


def scored_table(spark, root: str) -> DataFrame:
    """The replay as a written table."""
    return staged(spark, root, "scored", lambda: replay(priced_bars(spark, root), brand_calendar(spark, root)))
