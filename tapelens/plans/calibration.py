"""Registered queries: labels, splits, candidate search, bootstrap, gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import calibrate as cal
from ..operators import labels as lb
from ..session import materialise
from ..sources.tables import BENCH, table
from .backtests import Inputs
from .methodology import brand_calendar

BENCH_BY_CLASS = {"C0": "Brand#4", "C2": "Brand#6"}
HORIZONS = (4, 13, 26, 52)
RULES = [
    {"candidate_id": "baseline"},
    {"candidate_id": "pos_30", "positive_min": 0.3},
    {"candidate_id": "pos_60", "positive_min": 0.6},
    {"candidate_id": "neg_20", "negative_max": -0.2},
    {"candidate_id": "neg_50", "negative_max": -0.5},
    {"candidate_id": "both", "positive_min": 0.3, "negative_max": -0.2},
]
SPLIT = {"years": 6, "calibration_years": 2, "minimum_calibration_years": 1}


def _calendar(spark, root):
    return brand_calendar(spark, root)


def _labels(x):
    return lb.forward_labels(x.scored(), x.panel, x.calendar, BENCH_BY_CLASS, BENCH, HORIZONS)


def _forward(spark, root):
    out = _labels(Inputs(spark, root)).drop("veto", "S_score", "S_score_after_veto", "rs_ratio_z", "actual_positive", "actual_negative", "selected")
    return rounded(out)


def _search_short(spark, root):
    """A search over more years than the tables hold: no folds, one row that says so."""
    x = Inputs(spark, root)
    splits = lb.walk_forward_splits(x.calendar, years=10, calibration_years=5)
    out = cal.candidate_search(cal.fold_windows(_labels(x), splits), RULES, splits=splits, horizons=HORIZONS)
    return out.select("candidate_id", "horizon_weeks", "gate_status", "promotion_label", "rejection_reasons", "selected_by_calibration", "final_holdout_evaluated", "final_holdout_rows_used", "live_promotion_allowed")


def _raw_labels(spark, root):
    """Labels on raw prices: gaps make them unavailable."""
    x = Inputs(spark, root)
    out = lb.path_returns(x.bars.select("ticker", "date", "price"), x.calendar, (2, 4))
    return rounded(out)


def _search(spark, root):
    x = Inputs(spark, root)
    splits = lb.walk_forward_splits(x.calendar, **SPLIT)
    out = cal.candidate_search(materialise(cal.fold_windows(_labels(x), splits)), RULES, splits=splits, horizons=HORIZONS)
    return rounded(
        out.select(
            "candidate_id", "horizon_weeks", "gate_status", "promotion_label", "selected_by_calibration", "final_holdout_evaluated",
            "directions_changed", "fold_count", "rejection_reasons", "final_holdout_rows_used", "calibration_pos_n", "calibration_neg_n", "validation_pos_n", "validation_neg_n",
            "calibration_pos_delta", "calibration_neg_delta", "validation_pos_delta", "validation_neg_delta",
            "calibration_objective_delta", "min_fold_delta", "final_holdout_pos_delta", "final_holdout_neg_delta",
        )
    )


def _blocks(spark, root):
    x = Inputs(spark, root)
    return materialise(cal.grid_blocks(_labels(x), lb.train_holdout_split(x.calendar, 4, 2, 3)))


def _grid(spark, root):
    out = cal.grid_metrics(_blocks(spark, root))
    return rounded(out)


def _bootstrap(spark, root):
    b = _blocks(spark, root).where("window = 'holdout'")
    return cal.block_bootstrap(b, ["candidate_id", "horizon_weeks"])


def _unpaired(spark, root):
    b = _blocks(spark, root).where("window = 'holdout'")
    return cal.unpaired_row_bootstrap(b, ["candidate_id", "horizon_weeks"])


def _promoted(spark, root):
    blocks = _blocks(spark, root)
    boot = cal.block_bootstrap(blocks.where("window = 'holdout'"), ["candidate_id", "horizon_weeks"])
    return cal.grid_promotion(cal.grid_metrics(blocks), boot)


def _promotion(spark, root):
    return _promoted(spark, root).select("candidate_id", "horizon_weeks", "promotion_label", "rejection_reasons")


def _overrides(spark, root):
    out = cal.sector_overrides(_promoted(spark, root))
    return rounded(out.select("candidate_id", "horizon_weeks", "sector", "sector_weight_multiplier", "promotion_label", "promotion_requires"))


def _override_guardrail(spark, root):
    """Supplier rows as override proposals."""
    s = table(spark, root, "supplier").select(
        F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 27).cast("string")).alias("sector"),
        (1 + F.col("s_acctbal") / 40000).alias("sector_weight_multiplier"),
        F.lit("sector_candidate").alias("promotion_label"),
        (F.col("s_suppkey") % 50 == 3).alias("live_promotion_allowed"),
        F.lit("separate_reviewed_live_promotion_ticket").alias("promotion_requires"),
    )
    return cal.override_guardrail(s, [f"Brand#{i}" for i in range(1, 26)])


def _config_guardrail(spark, root):
    """Orders as candidate configurations."""
    k = F.col("o_orderkey")
    c = table(spark, root, "orders").select(
        k.alias("config_id"),
        (k % 11 == 0).alias("live_promotion_allowed"),
        (k % 13 == 0).alias("candidate_live_promotion_allowed"),
        (k % 7 != 0).alias("research_only"),
        F.when(k % 5 == 0, "later").otherwise("separate_ticket_required").alias("candidate_promotion"),
        F.when(k % 2 == 0, "Candidate").otherwise("do not promote").alias("promotion_label"),
        (k % 3 == 0).alias("final_holdout_evaluated"),
        (k % 40).cast("int").alias("final_holdout_rows_used"),
        F.when(k % 17 == 0, "passed_final_holdout_research").otherwise("draft").alias("config_status"),
    )
    agg = cal.config_guardrail(c)
    return agg.groupBy("status", "reasons").agg(F.count("*").alias("configs"), F.min("config_id").alias("first_config"))


def _promotion_gate(spark, root):
    """Customers' segments as tickets, priorities as variants."""
    o = table(spark, root, "orders")
    c = table(spark, root, "customer")
    s = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    rows = s.select(
        F.col("c_mktsegment").alias("ticket"),
        F.col("o_orderpriority").alias("variant"),
        F.when(F.col("v") > 255000, " Candidate ").when(F.col("v") > 245000, "needs more testing").alias("promotion_label"),
    )
    return cal.promotion_gate(rows)


QUERIES = {
    "walk_forward_splits": lambda s, d: lb.walk_forward_splits(_calendar(s, d), **SPLIT),
    "split_summary": lambda s, d: lb.split_summary(lb.walk_forward_splits(_calendar(s, d), **SPLIT), 6),
    "train_holdout_split": lambda s, d: lb.train_holdout_split(_calendar(s, d), 4, 2, 3),
    "forward_labels": _forward,
    "raw_path_returns": _raw_labels,
    "confusion_metrics": lambda s, d: rounded(lb.label_metrics(_labels(Inputs(s, d)))),
    "candidate_search": _search,
    "candidate_search_short": _search_short,
    "candidate_grid": _grid,
    "block_bootstrap": _bootstrap,
    "unpaired_bootstrap": _unpaired,
    "grid_promotion": _promotion,
    "sector_overrides": _overrides,
    "override_guardrail": _override_guardrail,
    "config_guardrail": _config_guardrail,
    "promotion_gate": _promotion_gate,
}
