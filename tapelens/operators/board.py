"""Report tables of a scored cross-section: action lists, sorts, groups, gates.

Inputs are one cross-section, one row per instrument; top-k limits are the reports'
own feature.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import signed
from .holdings import EXIT_STATES
from .scoring import PILLARS, WEIGHTS
from .states import RISK_STATES

# Display order of states and quadrants.
STATE_ORDER = {"STAGE_2_BULLISH": 0, "HOLD": 1, "STAGE_1_BASING": 2, "WARNING": 3, "EXIT": 4, "BEARISH_STAGE_4": 5}
QUADRANT_ORDER = {"Leading": 0, "Improving": 1, "Weakening": 2, "Lagging": 3}


def _order(c: str, ranks: dict[str, int]) -> Column:
    out = F.lit(99)
    for name, rank in ranks.items():
        out = F.when(F.col(c) == name, rank).otherwise(out)
    return out


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _notes(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def action_lists(scored: DataFrame) -> DataFrame:
    """Exit, watch and buy lists with up to three notes each, in list order."""
    state = F.col("state")
    kind = (
        F.when(state.isin(*EXIT_STATES), "exit").when(state == "WARNING", "warn").when(state == "STAGE_2_BULLISH", "buy")
    )
    cmf = F.concat(F.lit("CMF "), signed(_n("cmf21")))
    s_note = F.concat(F.lit("S "), signed("S_score"))
    exits = _notes(
        F.when(~F.col("above_30wma"), "below 30wMA"),
        F.when(_n("cmf21") < -0.05, cmf),
        F.when(F.col("rrg_quadrant") == "Lagging", "RRG Lagging"),
        F.when(F.col("veto"), "flow veto"),
    )
    warns = _notes(
        F.when(F.col("rrg_quadrant") == "Weakening", "RRG Weakening"),
        F.when(F.col("breadth_50d") < 0.5, F.concat(F.lit("breadth "), F.format_string("%.0f%%", F.col("breadth_50d") * 100))),
        F.when(_n("cmf21") < 0, cmf),
    )
    buys = _notes(
        s_note,
        F.when(_n("F_score") > 0, F.concat(F.lit("F "), signed("F_score"))),
        F.when(_n("mom_12_1") > 0, F.concat(F.lit("mom +"), F.format_string("%.0f%%", F.col("mom_12_1") * 100))),
    )
    df = scored.withColumn("kind", kind).where("kind is not null")
    notes = F.when(F.col("kind") == "exit", exits).when(F.col("kind") == "warn", warns).otherwise(buys)
    notes = F.when(F.size(notes) > 0, notes).otherwise(F.array(s_note))
    key = F.when(F.col("kind") == "exit", F.col("S_score")).otherwise(-F.col("S_score"))
    w = Window.partitionBy("kind").orderBy(key.asc_nulls_last(), "ticker")
    return df.select("kind", "ticker", F.row_number().over(w).alias("position"), F.array_join(F.slice(notes, 1, 3), " | ").alias("note"))


def pillar_count() -> Column:
    """Supportive pillars out of seven."""
    checks = [
        _n("mom_12_1") > 0,
        F.coalesce(F.col("faber"), F.lit(0)) == 1,
        F.coalesce(F.col("stage"), F.lit(0)) == 2,
        F.coalesce(F.col("antonacci"), F.lit(0)) == 1,
        F.coalesce(F.col("rrg_quadrant").isin("Leading", "Improving"), F.lit(False)),
        _n("breadth_50d") >= 0.5,
        _n("F_score") > 0,
    ]
    return sum((c.cast("int") for c in checks), F.lit(0))


def full_table(scored: DataFrame, field: str = "S_score", descending: bool = True) -> DataFrame:
    """Cross-section sorted by any column with state and quadrant ranks, nulls last."""
    df = scored.withColumn("pillar_count", pillar_count())
    if field == "state":
        key, descending = _order("state", STATE_ORDER), not descending
    elif field == "rrg_quadrant":
        key, descending = _order("rrg_quadrant", QUADRANT_ORDER), not descending
    else:
        key = F.col(field if field in df.columns else "S_score")
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(first, F.col("S_score").desc_nulls_last(), "ticker")


BOARD_KEYS = ("S_score", "F_score", "mom_12_1", "trend", "pillar_sum", "state", "ticker", "identity")
# Rank of states on a board, the worst first; an unknown state stands below them.
STATE_RANK = {"BEARISH_STAGE_4": 0, "EXIT": 1, "WARNING": 2, "STAGE_1_BASING": 3, "HOLD": 4, "STAGE_2_BULLISH": 5}


def trend_proxy() -> Column:
    return _n("mom_12_1") * 100 * 0.84 + _n("mansfield_rs") * 0.15


def state_rank() -> Column:
    return F.coalesce(F.get(F.array_compact(F.array(*[F.when(F.col("state") == name, rank) for name, rank in STATE_RANK.items()])), F.lit(0)), F.lit(-1))


def pillar_sum() -> Column:
    """Sum of the weighted terms of S."""
    return sum((F.coalesce(WEIGHTS[c] * F.col(c), F.lit(0.0)) for c in PILLARS.values()), F.lit(0.0))


def board_key(name: str, identity: str) -> Column:
    """What a board is sorted by."""
    other = {
        "trend": trend_proxy, "pillar_sum": lambda: F.round(pillar_sum(), 9), "state": state_rank,
        "ticker": lambda: F.upper("ticker"), "identity": lambda: F.upper(identity),
    }
    return other.get(name, lambda: _n(name))()


def board(scored: DataFrame, key: str = "S_score", descending: bool = True, identity: str = "ticker") -> DataFrame:
    """Class boards sorted by a key, with trend proxy, grade and peer rank.

    Ties stand by S, then by ticker, all in the direction of the key; an unknown key is S.
    ``identity`` is the column with the display name.
    """
    trend = trend_proxy()
    s = F.col("S_score")
    grade = F.when(s.isNull(), "?").when(s >= 1, "A").when(s >= 0, "B").when(s >= -1, "C").when(s >= -1.5, "D").otherwise("F")
    order = [board_key(key if key in BOARD_KEYS else "S_score", identity), _n("S_score"), F.upper("ticker")]
    w = Window.partitionBy("class").orderBy(*[c.desc() if descending else c.asc() for c in order])
    n = F.count("*").over(Window.partitionBy("class"))
    return scored.select(
        "class", "ticker", F.row_number().over(w).alias("peer_rank"), n.alias("peers"), trend.alias("trend"), grade.alias("grade")
    )


def comparison_basket(scored: DataFrame, current: str | None = None, limit: int = 4) -> DataFrame:
    """Current ticker, then selected by rank, then best S, up to a basket."""
    now = F.upper(F.col("ticker")) == (current or "").strip().upper()
    tier = F.when(now, 0).when(F.col("selected"), 1).otherwise(2)
    rank = F.when(tier == 1, F.col("rank_in_class").cast("double"))
    ordered = scored.orderBy(tier, rank.asc_nulls_last(), F.col("S_score").desc_nulls_last(), "ticker").limit(limit)
    return ordered.select("ticker", tier.alias("tier"), "class", "state")


def board_stats(scored: DataFrame) -> DataFrame:
    """Counts, averages and the board phase, one row."""
    risk = F.col("state").isin(*RISK_STATES)
    a = scored.agg(
        F.count("*").alias("instruments"),
        F.count_if(F.col("state").isin(*EXIT_STATES)).alias("exits"),
        F.count_if(F.col("state") == "WARNING").alias("warnings"),
        F.count_if(risk).alias("risks"),
        F.count_if(F.col("state") == "STAGE_2_BULLISH").alias("bullish"),
        F.avg(_n("S_score")).alias("average_s"),
        F.avg(_n("F_score")).alias("average_f"),
        F.avg(_n("breadth_50d")).alias("breadth"),
        F.avg(_n("mom_12_1") * 100).alias("average_momentum"),
        F.count_if(_n("cmf21") < 0).alias("negative_cmf"),
    )
    phase = (
        F.when(F.col("instruments") == 0, "NO DATA")
        .when((F.col("average_s") < 0) | (F.col("breadth") < 0.45) | (F.col("risks") > F.col("instruments") * 0.40), "RISK-OFF")
        .when((F.col("average_f") < 0) | (F.col("breadth") < 0.55) | (F.col("risks") > 0), "NARROWING")
        .otherwise("RISK-ON")
    )
    return a.withColumn("phase", phase)


def flow_cards(scored: DataFrame) -> DataFrame:
    """Average flow, risk count and size per class."""
    return scored.groupBy("class").agg(
        F.avg(_n("F_score")).alias("average_f"), F.count_if(F.col("state").isin(*RISK_STATES)).alias("risks"), F.count("*").alias("members")
    )


def flow_extremes(scored: DataFrame, by: str = "cmf21", k: int = 5) -> DataFrame:
    """Weakest and strongest k by a flow reading."""
    low = scored.orderBy(_n(by).asc(), "ticker").limit(k).select(F.lit("outflow").alias("side"), "ticker", _n(by).alias("reading"))
    high = scored.orderBy(_n(by).desc(), "ticker").limit(k).select(F.lit("inflow").alias("side"), "ticker", _n(by).alias("reading"))
    return low.unionByName(high)


def quadrant_cube(scored: DataFrame) -> DataFrame:
    """Members by class and quadrant with all subtotals."""
    g = scored.select("class", F.coalesce("rrg_quadrant", F.lit("Unknown")).alias("quadrant")).cube("class", "quadrant").agg(
        F.count("*").alias("members"), F.grouping("class").alias("_c"), F.grouping("quadrant").alias("_q")
    )
    return g.select(
        F.when(F.col("_c") == 1, "All").otherwise(F.col("class")).alias("class"),
        F.when(F.col("_q") == 1, "All").otherwise(F.col("quadrant")).alias("quadrant"),
        "members",
    )


def escalation(scored: DataFrame) -> DataFrame:
    """Supportive pillar count and the exit gates now tripped."""
    support = [
        F.coalesce(F.col(c), F.lit(0.0)) >= 0
        for c in ("mom_12_1_z", "mansfield_rs_z", "rs_ratio_z", "rs_momentum_z", "binary_filters", "cycle_tilt", "flow_z")
    ]
    reasons = _notes(
        F.when(~F.coalesce(F.col("above_30wma"), F.lit(False)), "close < 30wMA"),
        F.when(_n("mansfield_rs") < 0, "Mansfield RS < 0"),
        F.when(_n("cmf21") < -0.10, "CMF < -0.10"),
        F.when(F.col("rrg_quadrant") == "Lagging", "RRG Lagging"),
    )
    return scored.select("ticker", sum((c.cast("int") for c in support), F.lit(0)).alias("supportive"), F.array_join(reasons, ", ").alias("tripped"))


def momentum_bars(scored: DataFrame, k: int = 16) -> DataFrame:
    """Top momentum, bar width relative to the largest."""
    top = scored.select("ticker", (_n("mom_12_1") * 100).alias("momentum_pct")).orderBy(F.desc("momentum_pct"), "ticker").limit(k)
    peak = F.greatest(F.lit(5.0), F.max(F.abs("momentum_pct")).over(Window.partitionBy(F.lit(1))))
    return top.withColumn("width", F.least(F.lit(50.0), F.abs("momentum_pct") / peak * 50))


def leaders_and_risks(scored: DataFrame, k: int = 8) -> DataFrame:
    """Best and worst k by S."""
    top = scored.orderBy(_n("S_score").desc(), "ticker").limit(k).select(F.lit("leader").alias("side"), "ticker", "S_score")
    low = scored.orderBy(_n("S_score").asc(), "ticker").limit(k).select(F.lit("risk").alias("side"), "ticker", "S_score")
    return top.unionByName(low)


def counts(scored: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Members by state and by quadrant in one pass, decisions by action.

    A decision without an action asks for a review.
    """
    g = scored.select("state", F.coalesce("rrg_quadrant", F.lit("Unknown")).alias("quadrant")).groupingSets([["state"], ["quadrant"]], "state", "quadrant").agg(
        F.count("*").alias("members"), F.grouping("state").alias("_q")
    )
    out = g.select(
        F.when(F.col("_q") == 1, "quadrant").otherwise("state").alias("dimension"),
        F.when(F.col("_q") == 1, F.col("quadrant")).otherwise(F.col("state")).alias("label"),
        "members",
    )
    if decisions is None:
        return out
    action = F.coalesce(F.nullif(F.trim("action"), F.lit("")), F.lit("REVIEW"))
    return out.unionByName(decisions.groupBy(F.lit("action").alias("dimension"), action.alias("label")).agg(F.count("*").alias("members")))


def gate_rows(scored: DataFrame) -> DataFrame:
    """Stage-2 checklist and gate list per instrument; unknown stays null."""

    def rows(name: str, checks: list[tuple[str, Column]]) -> list[Column]:
        return [
            F.struct(F.lit(name).alias("list"), F.lit(i).alias("position"), F.lit(label).alias("label"), ok.alias("ok"))
            for i, (label, ok) in enumerate(checks, 1)
        ]

    c, no = F.col, lambda x: F.coalesce(x, F.lit(False))
    checklist = [
        ("Price is above the 30-week moving average", no(c("above_30wma"))),
        ("30-week moving average is rising", no(c("ma_slope_pos"))),
        ("Mansfield relative strength is positive", no(c("mansfield_rs") > 0)),
        ("RRG quadrant is Leading", no(c("rrg_quadrant") == "Leading")),
        ("Breadth is at least 60%", no(c("breadth_50d") >= 0.60)),
        ("CMF21 is above +0.05", no(c("cmf21") > 0.05)),
        ("ETF flow is non-negative", no(c("etf_flow_5d_pct") >= 0)),
        ("Hard flow veto is not active", ~no(c("veto"))),
    ]
    gates = [
        ("RRG quadrant", ~no(c("rrg_quadrant").isin("Lagging", "Weakening"))),
        ("Breadth >= 50%", c("breadth_50d") >= 0.5),
        ("CMF stayed > 0", c("cmf21") > 0),
        ("No OBV divergence", ~c("obv_divergence")),
        ("ETF flow non-negative", c("etf_flow_5d_pct") >= 0),
        ("Price > 30wMA", c("above_30wma")),
        ("MA slope positive", c("ma_slope_pos")),
        ("Mansfield RS > 0", c("mansfield_rs") > 0),
        ("Antonacci > T-bill", c("antonacci") == 1),
    ]
    short = [
        ("RRG not weakening", ~no(c("rrg_quadrant").isin("Weakening", "Lagging"))),
        ("Breadth >= 50%", _n("breadth_50d") >= 0.5),
        ("CMF stayed > 0", _n("cmf21") > 0),
        ("Flow veto avoided", _n("F_score") >= -0.5),
        ("Close above 30wMA", no(c("above_30wma"))),
        ("Mansfield RS >= 0", _n("mansfield_rs") >= 0),
    ]
    every = rows("checklist", checklist) + rows("gates", gates) + rows("short", short)
    return scored.select("ticker", F.explode(F.array(*every)).alias("g")).select("ticker", "g.*")


def flow_confirmation() -> Column:
    """False on veto, else any known check passes, null when none is known."""
    ratio = F.when(F.col("block_up_ratio").between(0.0, 1.0), F.col("block_up_ratio"))
    best = F.greatest(
        (F.col("F_score") >= 0).cast("int"), (F.col("cmf21") >= 0.05).cast("int"), (F.col("etf_flow_5d_pct") >= 0).cast("int"), (ratio >= 0.70).cast("int")
    )
    return F.when(F.coalesce(F.col("veto"), F.lit(False)), False).otherwise(best == 1)


def flow_lanes(scored: DataFrame, k: int = 10) -> DataFrame:
    """Pressure lanes from the k strongest outflows to the k strongest inflows.

    Both sides are capped top-k lists, so the lanes are at most k x k report rows;
    each outflow carries the inflow list as an array.
    """
    signal = F.coalesce("cmf21", "F_score", "S_score", F.lit(0.0))
    df = scored.select("ticker", signal.alias("sig"))
    size = F.greatest(F.lit(0.05), F.abs("sig"))
    out = df.where("sig < 0").orderBy("sig", "ticker").limit(k).select(F.col("ticker").alias("source"), size.alias("m_out"))
    inn = df.where("sig > 0").orderBy(F.desc("sig"), "ticker").limit(k).select(F.col("ticker").alias("target"), size.alias("m_in"))
    lanes = out.withColumn("total_out", F.sum("m_out").over(Window.partitionBy(F.lit(1))))
    targets = inn.agg(F.collect_list(F.struct("target", "m_in"))).scalar()
    lanes = lanes.withColumn("_t", targets)
    total_in = F.aggregate("_t", F.lit(0.0), lambda acc, x: acc + x["m_in"])
    lanes = lanes.withColumn("total_in", total_in).withColumn("t", F.explode("_t"))
    share = F.col("m_out") / F.greatest("total_out", F.lit(0.1)) * F.col("t.m_in") / F.greatest("total_in", F.lit(0.1))
    return lanes.select("source", F.col("t.target").alias("target"), share.alias("share"), (share * F.least("total_out", "total_in")).alias("pressure"))


def row_pressure(scored: DataFrame) -> DataFrame:
    """F + CMF + 0.35 S, strongest first."""
    p = _n("F_score") + _n("cmf21") + _n("S_score") * 0.35
    return scored.select("ticker", p.alias("pressure")).orderBy(F.desc(F.abs("pressure")), "ticker")
