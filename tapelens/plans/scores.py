"""Registered queries: composite, states, transitions."""
from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import scoring, states
from ..session import materialise
from ..sources.tables import BENCH, CASH, TOP_PER_CLASS, table, ticker_class
from .methodology import brand_calendar, latest, priced_bars, scored_table, snapshots, targets
from .prices import priced


def _composite(spark, root):
    return rounded(
        scored_table(spark, root).select(
            "as_of", "ticker", "class", "S_score", "F_score", "S_score_after_veto", "veto",
            F.col("rank_in_class").cast("bigint").alias("rank_in_class"), "selected",
        )
    )


def _snapshot_indicators(spark, root):
    b = priced_bars(spark, root)
    return rounded(
        snapshots(b, brand_calendar(spark, root)).select(
            "as_of", "ticker", "class", "mom_12_1", "return_5d", "faber", "stage", "above_30wma", "ma_slope_pos",
            "mansfield_rs", "antonacci", "rs_ratio", "rs_momentum", "rrg_quadrant", "breadth_50d", "cmf21",
            "obv_slope", "mfi14", "rvol", "dist_days_25", "obv_divergence",
        )
    )


def _journal(spark, root):
    return states.transitions(scored_table(spark, root))


def _journal_table(spark, root):
    return materialise(_journal(spark, root))


def _journal_append(spark, root):
    """History before 2000 is the journal; everything arrives again, doubled."""
    t = _journal_table(spark, root)
    return states.append_transitions(t.where("date < date'2000-01-01'"), t.unionByName(t))


def _display(spark, root):
    out = states.annotate_display(scored_table(spark, root))
    return out.select("as_of", "ticker", "pullback_risk", "pullback_risk_reason", "state_display_label")


def _reasons(spark, root):
    out = states.annotate_display(latest(scored_table(spark, root)))
    return out.select("ticker", "state", F.array_join(states.state_reasons(), " | ").alias("reasons"))


def _stored(spark, root):
    """Stored states: one per brand from its last order up to NOW."""
    o = table(spark, root, "orders").where(F.col("o_orderdate") <= F.lit(NOW))
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    key = F.struct("o_orderdate", "o_orderkey", "o_custkey", "o_orderstatus")
    status = F.col("_m.o_orderstatus")
    return (
        o.groupBy(brand.alias("ticker"))
        .agg(F.max(key).alias("_m"))
        .select(
            "ticker",
            F.when(status == "F", "EXIT").when(status == "O", "HOLD").otherwise("").alias("state"),
            F.col("_m.o_orderdate").alias("updated"),
        )
    )


NOW = datetime(2001, 1, 2)


def _reconcile(spark, root):
    out = states.reconcile(latest(scored_table(spark, root)), _stored(spark, root), NOW)
    return out.select("ticker", "state", "state_storage_reconciled", "rendered_state")


def _health(spark, root):
    out = states.storage_health(_stored(spark, root), _journal(spark, root), NOW)
    return out.select("by_ticker_count", "journal_count", "latest_transition_date", "age_seconds", "freshness")


def _live(spark, root):
    out = states.live_transitions(latest(scored_table(spark, root)), _stored(spark, root), date(2001, 11, 5))
    return out


def _ad_hoc(spark, root):
    b = priced_bars(spark, root)
    snap = latest(snapshots(b, brand_calendar(spark, root)))
    flow = scoring.flow_composite(scoring.neutral_lanes(snap))
    out = states.with_state(scoring.ad_hoc_scores(flow, ["brand#7", "Brand#12", "Brand#99"], BENCH, CASH))
    out = out.withColumn("rank_in_class", F.col("rank_in_class").cast("bigint"))
    return rounded(out.select("ticker", "class", "S_score", "rank_in_class", "selected", "state", "analysis_scope"))


def _tilt(spark, root):
    """Brands as sectors: those whose number starts with 1 are favoured in the early phase."""
    b = priced(spark, root).select("ticker").distinct()
    favoured = {"EARLY": ("Brand#1", "Brand#10", "Brand#11"), "LATE": ("Brand#5",)}
    cols = [
        scoring.cycle_tilt(F.col("ticker"), p, favoured, "Brand#1").alias(p.lower()) for p in ("EARLY", "LATE", "UNKNOWN")
    ]
    return b.select("ticker", *cols)


def _config(spark, root):
    """The frozen baseline hashed with the universe found in the data."""
    universe = priced(spark, root).select("ticker", ticker_class("ticker").alias("class"))
    return scoring.config_hash(universe, scoring.baseline_configuration({f"C{i}": TOP_PER_CLASS for i in range(4)}, BENCH, CASH))


def _class_lookup(spark, root):
    """Part types as the universe, two brands overridden, small sizes unlisted."""
    part = table(spark, root, "part")
    dim = part.where("p_size > 3").groupBy(F.col("p_name").alias("ticker")).agg(F.min("p_type").alias("class"))
    over = part.where("p_brand in ('Brand#1', 'Brand#2')").groupBy(F.col("p_name").alias("ticker")).agg(F.min("p_brand").alias("class"))
    names = part.select(F.col("p_name").alias("ticker")).unionByName(table(spark, root, "customer").select(F.col("c_name").alias("ticker")))
    return scoring.with_class(names, dim, over.where("ticker like 'red%'")).groupBy("class").agg(F.count("*").alias("members"))


def _weights(spark, root):
    return rounded(targets(scored_table(spark, root)))


QUERIES = {
    "snapshot_indicators": _snapshot_indicators,
    "composite_rank": _composite,
    "states": lambda s, d: scored_table(s, d).select("as_of", "ticker", "state"),
    "pullback_display": _display,
    "state_reasons": _reasons,
    "contributions": lambda s, d: rounded(scoring.contributions(scored_table(s, d)).select("as_of", "ticker", "pillar", "contribution")),
    "display_contributions": lambda s, d: rounded(scoring.display_contributions(latest(scored_table(s, d)))),
    "target_weights": _weights,
    "transitions": _journal,
    "transition_append": _journal_append,
    "recent_transitions": lambda s, d: states.newest(_journal(s, d), 25),
    "transition_feed": lambda s, d: states.feed_items(_journal(s, d)).select("ticker", "date", "title", "uid"),
    "transition_digest": lambda s, d: states.digest(_journal(s, d), date(2001, 6, 29)),
    "transition_pulse": lambda s, d: states.pulse(_journal(s, d), date(2001, 6, 29)),
    "transition_rate": lambda s, d: rounded(states.transition_rate(scored_table(s, d))),
    "live_transitions": _live,
    "state_reconcile": _reconcile,
    "state_health": _health,
    "ad_hoc_scores": _ad_hoc,
    "cycle_tilt": _tilt,
    "class_lookup": _class_lookup,
    "config_universe": _config,
}
