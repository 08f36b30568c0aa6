"""Registered queries: debrief, holdings, trades, watch lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import debrief as db
from ..operators import holdings as hd
from ..operators.macro import condition_label, series_stats
from ..sources.tables import bars, decisions, holdings, macro, table, trades
from .methodology import latest, priced_bars, scored_table


def _outcomes(spark, root):
    return db.outcomes(decisions(spark, root), priced_bars(spark, root))


def _outcome_rows(spark, root):
    out = _outcomes(spark, root).select(
        "run_id", "ticker", "action", "horizon", "days", "status", "start_date", "end_date", "start_price", "end_price",
        "forward_return", "max_drawdown", "hit",
    )
    return rounded(out, start_price=10, end_price=10)


def _macro_debrief(spark, root):
    """Every run carries the reading of its month's series."""
    stats = series_stats(macro(spark, root)).select("series_id", F.col("date").alias("month"), "delta", "yoy_pct")
    d = decisions(spark, root)
    runs = d.select("run_id", "series_id", F.trunc("started_at", "month").alias("month")).join(stats, ["series_id", "month"])
    cond = runs.select("run_id", "series_id", condition_label(F.col("delta"), F.col("yoy_pct")).alias("condition"))
    out = db.outcomes(d.drop("series_id"), priced_bars(spark, root), {"4w": 20})
    return rounded(db.macro_summary(out, cond))


def _review(spark, root):
    """Misses with the state and score of the week before the run."""
    out = db.review_candidates(_outcomes(spark, root), min_abs=0.5)
    return rounded(out.select("run_id", "ticker", "action", "horizon", "forward_return"))


def _with_scores(spark, root):
    """Decisions of the latest rebalance weeks with that week's scores."""
    s = scored_table(spark, root).select(
        F.date_format("as_of", "yyyy-MM-dd").alias("run_id"), "ticker", "state", F.col("S_score").alias("s_score"), F.col("F_score").alias("f_score")
    )
    d = decisions(spark, root).select(F.date_format("started_at", "yyyy-MM-dd").alias("run_id"), F.col("run_id").alias("decision_id"), "ticker", "action")
    return rounded(db.with_scores(d, s.withColumn("ticker", F.upper("ticker"))).drop("f_score"))


def _analysis(spark, root):
    return hd.analyze_holdings(holdings(spark, root), latest(scored_table(spark, root)))


def _holdings(spark, root):
    out = _analysis(spark, root).withColumn("rank_in_class", F.col("rank_in_class").cast("bigint"))
    return rounded(out.select("account", "ticker", "analysis_weight", "state", "asset_class", "s_score", "rank_in_class", "selected", "missing", "action"))


def _pnl(spark, root):
    h = holdings(spark, root)
    p = hd.latest_closes(bars(spark, root)).where("ticker not in ('BRAND#5', 'BRAND#8')")
    return hd.position_pnl(h.withColumn("shares", F.when(F.col("account") % 11 != 0, F.col("shares"))), p)


def _aligned(spark, root):
    return hd.trade_alignment(trades(spark, root), scored_table(spark, root).select("ticker", "as_of", "state"))


def _lists(spark, root):
    """One list per nation: the brands its suppliers ship, by first line number, and an unknown one."""
    item = table(spark, root, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supp = table(spark, root, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("list_id"))
    known = item.join(part, "l_partkey").join(supp, "l_suppkey").groupBy("list_id", F.col("p_brand").alias("ticker")).agg(F.min("l_orderkey").alias("pos"))
    extra = supp.select("list_id").distinct().select("list_id", F.lit("BRAND-X").alias("ticker"), F.lit(-1).cast("bigint").alias("pos"))
    return known.unionByName(extra)


def _universe(spark, root):
    return hd.custom_universe(_lists(spark, root), latest(scored_table(spark, root)))


QUERIES = {
    "debrief_outcomes": _outcome_rows,
    "debrief_summary": lambda s, d: rounded(db.summary(_outcomes(s, d))),
    "debrief_macro": _macro_debrief,
    "debrief_review": _review,
    "debrief_scores": _with_scores,
    "holdings_analysis": _holdings,
    "holdings_exposure": lambda s, d: rounded(hd.exposure(_analysis(s, d))),
    "pnl_positions": lambda s, d: rounded(_pnl(s, d).select("account", "ticker", "status", "cost", "current_value", "unrealized_pnl", "unrealized_pct"), 3, unrealized_pct=6),
    "pnl_rollup": lambda s, d: rounded(hd.pnl_rollup(_pnl(s, d)), 3, unrealized_pct=6),
    "asof_trades": lambda s, d: _aligned(s, d).groupBy("ticker", "trade_date", "side", "state_date", "state", "alignment").agg(F.count("*").alias("trades")),
    "trade_alignment": lambda s, d: rounded(hd.alignment_summary(_aligned(s, d))),
    "custom_universe": lambda s, d: rounded(_universe(s, d)),
    "universe_counts": lambda s, d: hd.universe_counts(_universe(s, d)),
}
