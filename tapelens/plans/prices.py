"""Registered queries: bars, price indicators, flow indicators."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.calendar import rebalance_calendar
from ..functions.columns import rounded
from ..operators import flow, pillars, resample
from ..sources.tables import BENCH, CASH, bars, with_price
from .methodology import priced_bars


def priced(spark, root):
    return with_price(bars(spark, root))


def _weekly(spark, root):
    out = resample.weekly_spine(resample.weekly_bars(priced(spark, root)))
    return rounded(out.select("ticker", "week_end", "traded", "open", "high", "low", "close", "price", "volume"))


def _monthly(spark, root):
    out = resample.monthly_bars(priced(spark, root))
    return rounded(out.select("ticker", "month_end", "open", "high", "low", "close", "price", "volume"))


def _daily(*columns):
    return lambda spark, root: rounded(pillars.daily_pillars(priced(spark, root)).select("ticker", "date", *columns))


def _weekly_signal(build, *columns):
    def run(spark, root):
        rel = pillars.weekly_relative(priced(spark, root), BENCH)
        return rounded(build(rel).where("traded").select("ticker", "week_end", *columns))

    return run


def _flow(*columns, digits=6):
    def run(spark, root):
        return rounded(flow.flow_indicators(priced(spark, root)).select("ticker", "date", *columns), digits)

    return run


def _dollar_flow(spark, root):
    """Dollar volume on a log scale: six digits then mean the same at every size."""
    f = flow.flow_indicators(priced(spark, root))
    return rounded(f.select("ticker", "date", "net_flow_21d", F.ln("adv_20d").alias("ln_adv_20d")), net_flow_21d=4)


QUERIES = {
    "bars_daily": lambda s, d: rounded(bars(s, d)),
    "bars_weekly": _weekly,
    "bars_monthly": _monthly,
    "rebalance_calendar": lambda s, d: rebalance_calendar(priced(s, d).select("date")),
    "momentum": _daily("mom_12_1", "return_1d", "return_2d", "return_5d"),
    "breadth": _daily("breadth_50d"),
    "faber_signal": lambda s, d: pillars.with_faber(priced(s, d)).select("ticker", "date", "faber"),
    "antonacci_signal": lambda s, d: pillars.antonacci_signal(priced_bars(s, d), CASH),
    "stage": _weekly_signal(
        pillars.stage_analysis, "stage", "above_30wma", "ma_slope_pos", "sma30w", "mansfield_rs"
    ),
    "rrg": _weekly_signal(pillars.rotation, "rrg_quadrant", "rs_ratio", "rs_momentum"),
    "relative_strength_lines": lambda s, d: rounded(pillars.relative_strength_lines(priced_bars(s, d), BENCH)),
    "weekly_chart": lambda s, d: rounded(pillars.weekly_chart(priced(s, d), 104)),
    "chart_relative_strength": lambda s, d: rounded(pillars.chart_relative_strength(priced_bars(s, d), BENCH)),
    "cmf_obv_mfi": _flow("cmf21", "obv", "obv_slope", "mfi14", "rvol"),
    "dollar_flow": _dollar_flow,
    "distribution_days": _flow("dist_days_25", "obv_divergence"),
    "chart_flow": lambda s, d: rounded(flow.chart_flow(priced(s, d))),
    "lookback_filter": lambda s, d: rounded(flow.lookback(priced(s, d), "6M").select("ticker", "date", "price")),
    "visible_clip": lambda s, d: rounded(
        flow.visible_since(flow.flow_indicators(priced(s, d)), date(1999, 6, 1)).select("ticker", "date", "cmf21")
    ),
}
