"""Registered queries: provider lanes and report tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import board, lanes
from ..operators.scoring import NEUTRAL, flow_composite, with_lanes
from ..operators.states import decide_state
from ..session import materialise
from ..sources.tables import PRINT_ORDER, crowd, intraday, monthly_funds, ordered_prints, shares_outstanding, table
from .methodology import daily_readings, day_table, latest, priced_bars, scored_table


def _now(spark, root):
    return materialise(latest(scored_table(spark, root)))


def _tape(spark, root):
    minute = F.date_trunc("minute", "ts")
    return lanes.block_ratio(intraday(spark, root), ["ticker"], ["event_key"], 50000.0, 2000000.0, minute)


def _directions(spark, root):
    d = lanes.tick_direction(intraday(spark, root), ["ticker"], ["event_key"], F.date_trunc("hour", "ts"))
    return d.select("ticker", "seq", F.signum(F.col("price") - F.col("prev_price")).alias("direction"))


def _dark_records(spark, root):
    venue = [F.struct(F.lit(name).alias("summary_type"), c.alias("shares")) for name, c in (("ATS_W_SMBL", F.col("third_lines")), ("OTC_W_SMBL", F.col("reported") - F.coalesce("third_lines", F.lit(0.0))))]
    return day_table(spark, root).select("ticker", F.next_day("date", "MON").alias("week"), F.inline(F.array(*venue)))


def _short_records(spark, root):
    m = day_table(spark, root).groupBy("ticker", F.last_day("date").alias("settlement")).agg(F.sum("volume").alias("position"))
    odd = F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5
    return m.select("ticker", "settlement", F.when(odd == 0, 12.5).alias("reported"), "position", F.when(odd == 1, F.col("position") * 0.8).alias("previous"))


def _filings(spark, root):
    item = table(spark, root, "lineitem")
    rec = item.select(F.concat(F.lit("c "), F.col("l_partkey").cast("string")).alias("cusip"), F.trunc("l_shipdate", "quarter").alias("period"), F.col("l_quantity").alias("shares"))
    part = table(spark, root, "part")
    m = part.select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("cusip"), F.col("p_brand").alias("ticker"))
    return lanes.filings_net_buys(rec, m)


def _lane_table(spark, root):
    """Latest reading of every lane per brand; some brands lack some lanes."""
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    days = day_table(spark, root)
    etf = lanes.etf_flow(monthly_funds(days))
    etf = etf.groupBy("ticker").agg(F.max_by("etf_flow_5d_pct", "as_of").alias("etf_flow_5d_pct")).where(n % 6 != 0)
    block = lanes.block_ratio(ordered_prints(spark, root), ["ticker"], ["date", *PRINT_ORDER, "size", "price"], 45.0, 90000.0, crowd=crowd(days)).select("ticker", "block_up_ratio")
    dark = lanes.dark_pool_share(_dark_records(spark, root)).select("ticker", "dark_pool_pct")
    short = lanes.short_interest_delta(_short_records(spark, root)).where(n % 7 != 0)
    out = dark
    for x in (etf, block, short, _filings(spark, root)):
        out = out.join(x, "ticker", "left")
    return out


def _flow_signals(spark, root):
    b = priced_bars(spark, root)
    d = daily_readings(b)
    last = d.groupBy("ticker").agg(F.max_by(F.struct("cmf21", "obv_slope", "mfi14", "rvol", "dist_days_25"), "date").alias("r")).select("ticker", "r.*")
    return flow_composite(with_lanes(last, materialise(_lane_table(spark, root)), ["ticker"]).withColumn("as_of", F.lit("latest")))


def _signals(spark, root):
    cols = [c for name in NEUTRAL for c in (name, f"{name}_live")]
    return rounded(_flow_signals(spark, root).select("ticker", "cmf21", "obv_slope", "rvol", *cols))


def _lane_runs(spark, root):
    """Orders as runs of the lanes: one brand and lane each, finished ones as healthy."""
    o, key = table(spark, root, "orders"), F.col("o_orderkey") % 5
    lane = F.element_at(F.array(*[F.lit(name) for name in NEUTRAL]), (key + 1).cast("int"))
    done = F.col("o_orderstatus") == "F"
    return o.select(
        lane.alias("lane"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"),
        F.when(done, "healthy").otherwise("warning").alias("status"), F.when(done, "live ok").otherwise("neutral fallback").alias("mode"),
        F.col("o_orderdate").alias("completed_at"),
    )


def _signals_run(spark, root):
    """Lane readings that are live by each brand's last run."""
    b = priced_bars(spark, root).select("ticker").distinct()
    out = with_lanes(b, materialise(_lane_table(spark, root)), ["ticker"], lanes.last_runs(_lane_runs(spark, root)))
    return rounded(out.select("ticker", *[c for name in NEUTRAL for c in (name, f"{name}_live")]))


def _lane_states(spark, root):
    """States with live lanes: the gates of a lane apply only where it is live."""
    cols = [c for name in ("etf_flow_5d_pct", "block_up_ratio") for c in (name, f"{name}_live")]
    live = _flow_signals(spark, root).select("ticker", *cols)
    now = _now(spark, root).drop(*cols).join(live, "ticker")
    return now.select("ticker", decide_state(now).alias("state"), board.flow_confirmation().alias("confirmed"))


def _health_events(spark, root):
    e = table(spark, root, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    failed = (k % 10 == 0) & (F.col("event_type") != "view")
    return e.select(
        F.col("event_type").alias("lane"), F.format_string("U%03d", F.col("user_id")).alias("ticker"),
        F.when(failed, "warning").otherwise("healthy").alias("status"),
        F.when(failed, F.when(k % 20 == 0, "fallback cache").otherwise("neutral fallback")).otherwise("live ok").alias("mode"), F.col("ts").alias("completed_at"),
    )


LANES = [("click", "Clicks", False, ""), ("view", "Views", False, ""), ("error", "Errors", True, ""), ("purchase", "Purchases", False, "API_KEY"), ("other", "Other", False, "")]


def _readiness(spark, root):
    config = spark.createDataFrame(LANES, "lane string, label string, stubbed boolean, missing string")
    return lanes.readiness(config, lanes.run_health(_health_events(spark, root)))


def _board_sorts(spark, root):
    """Peer ranks of every board key in both directions; the made-up name of a brand reads it backwards."""
    now = _now(spark, root).withColumn("identity", F.concat_ws(" ", F.reverse("ticker"), "class"))
    parts = [
        board.board(now, key, down, "identity").select(F.lit(key).alias("key"), F.lit(down).alias("descending"), "class", "ticker", "peer_rank")
        for key in board.BOARD_KEYS
        for down in (True, False)
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "block_tape": lambda s, d: rounded(_tape(s, d)),
    "tick_direction": _directions,
    "etf_flow": lambda s, d: rounded(lanes.etf_flow(shares_outstanding(s, d))),
    "dark_pool": lambda s, d: rounded(lanes.dark_pool_share(_dark_records(s, d))),
    "short_interest": lambda s, d: rounded(lanes.short_interest_delta(_short_records(s, d))),
    "thirteen_f": lambda s, d: rounded(_filings(s, d)),
    "flow_signals": _signals,
    "flow_signals_run": _signals_run,
    "flow_composite": lambda s, d: rounded(_flow_signals(s, d).select("ticker", "F_score")),
    "lane_states": _lane_states,
    "provider_health": lambda s, d: lanes.run_health(_health_events(s, d)),
    "provider_readiness": _readiness,
    "action_lists": lambda s, d: board.action_lists(_now(s, d)),
    "full_table": lambda s, d: rounded(board.full_table(_now(s, d), "state").select("ticker", "state", "S_score", "pillar_count")),
    "class_board": lambda s, d: rounded(board.board(_now(s, d))),
    "board_sorts": _board_sorts,
    "comparison_basket": lambda s, d: board.comparison_basket(_now(s, d), "brand#9", 6),
    "board_stats": lambda s, d: rounded(board.board_stats(_now(s, d))),
    "flow_cards": lambda s, d: rounded(board.flow_cards(_now(s, d))),
    "flow_extremes": lambda s, d: rounded(board.flow_extremes(_now(s, d))),
    "quadrant_cube": lambda s, d: board.quadrant_cube(_now(s, d)),
    "escalation": lambda s, d: board.escalation(_now(s, d)),
    "momentum_bars": lambda s, d: rounded(board.momentum_bars(_now(s, d))),
    "leaders_risks": lambda s, d: rounded(board.leaders_and_risks(_now(s, d))),
    "gate_rows": lambda s, d: board.gate_rows(_now(s, d)),
    "flow_lanes": lambda s, d: rounded(board.flow_lanes(_now(s, d))),
    "row_pressure": lambda s, d: rounded(board.row_pressure(_now(s, d))),
}
