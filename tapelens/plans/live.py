"""Registered queries: composite, states and board with live provider lanes at every date."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.columns import rounded
from ..operators import board, lanes
from ..operators.scoring import composite, flow_composite, with_lanes
from ..operators.states import with_state
from ..session import staged
from ..sources.tables import PRINT_ORDER, TOP_PER_CLASS, crowd, monthly_funds, ordered_prints
from .boards import _short_records
from .methodology import brand_calendar, day_table, latest, priced_bars, snapshots


def lane_history(spark, root):
    """Readings of the scoring lanes by ticker and date they became known."""
    days = day_table(spark, root)
    etf = lanes.etf_flow(monthly_funds(days)).where("etf_flow_5d_pct is not null")
    month = lambda df, day: df.withColumn("as_of", F.last_day(day))
    block = lanes.block_ratio(
        month(ordered_prints(spark, root), "date"), ["ticker", "as_of"], ["date", *PRINT_ORDER, "size", "price"], 45.0, 90000.0, crowd=month(crowd(days), "_b")
    ).where("block_up_ratio is not null")
    short = lanes.short_interest_history(_short_records(spark, root)).where("si_delta_15d is not null")
    return {
        "etf_flow_5d_pct": etf,
        "block_up_ratio": block.select("ticker", "as_of", "block_up_ratio"),
        "si_delta_15d": short.withColumnRenamed("settlement", "as_of"),
    }


def live_replay(spark, root):
    """Score and state at every rebalance date, each with the lanes known by then."""
    snap = snapshots(priced_bars(spark, root), brand_calendar(spark, root))
    known = snap.select("ticker", "as_of").distinct()
    for name, history in lane_history(spark, root).items():
        known = asof_backward(known, history, ["ticker"], "as_of", [name])
    scored = composite(flow_composite(with_lanes(snap, known, ["ticker", "as_of"])), top_n=TOP_PER_CLASS)
    return with_state(scored)


def live_table(spark, root):
    return staged(spark, root, "live", lambda: live_replay(spark, root))


def _composite(spark, root):
    out = live_table(spark, root).withColumn("rank_in_class", F.col("rank_in_class").cast("bigint"))
    return rounded(out.select("as_of", "ticker", "class", "S_score", "F_score", "flow_z", "S_score_after_veto", "veto", "rank_in_class", "selected"))


def _extremes(spark, root):
    """Weakest and strongest five by the flow score of the newest date."""
    return rounded(board.flow_extremes(latest(live_table(spark, root)), by="F_score"))


QUERIES = {
    "live_composite": _composite,
    "live_states": lambda s, d: live_table(s, d).select("as_of", "ticker", "state"),
    "live_vetoes": lambda s, d: live_table(s, d).groupBy("class").agg(F.count_if("veto").alias("vetoed"), F.count(F.lit(1)).alias("rows")),
    "live_flow_extremes": _extremes,
}
