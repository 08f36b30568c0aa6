from __future__ import annotations

from datetime import date, datetime

import pytest

from tapelens.operators import scoring, states

BASE = {
    "stage": 2, "above_30wma": True, "ma_slope_pos": True, "mansfield_rs": 5.0, "antonacci": 1, "rrg_quadrant": "Leading",
    "breadth_50d": 0.70, "cmf21": 0.08, "return_5d": 0.01, "etf_flow_5d_pct": 0.0, "block_up_ratio": 1.0, "obv_divergence": False, "dist_days_25": 0,
}
SCHEMA = (
    "id int, stage int, above_30wma boolean, ma_slope_pos boolean, mansfield_rs double, antonacci int, rrg_quadrant string, breadth_50d double, "
    "cmf21 double, return_5d double, etf_flow_5d_pct double, block_up_ratio double, obv_divergence boolean, dist_days_25 int"
)
CASES = [
    ({}, "STAGE_2_BULLISH"),
    ({"above_30wma": False, "ma_slope_pos": False, "mansfield_rs": -2.0, "cmf21": -0.2}, "BEARISH_STAGE_4"),
    ({"mansfield_rs": -1.0}, "EXIT"),
    ({"antonacci": 0}, "EXIT"),
    ({"rrg_quadrant": "Lagging"}, "EXIT"),
    ({"etf_flow_5d_pct": -2.0}, "EXIT"),
    ({"block_up_ratio": 0.6}, "EXIT"),
    ({"rrg_quadrant": "Weakening"}, "WARNING"),
    ({"obv_divergence": True}, "WARNING"),
    ({"dist_days_25": 4}, "WARNING"),
    ({"return_5d": -0.04}, "WARNING"),
    ({"breadth_50d": 0.55}, "HOLD"),
    ({"rrg_quadrant": "Improving"}, "HOLD"),
    ({"return_5d": None}, "STAGE_2_BULLISH"),
    ({"stage": 1}, "STAGE_1_BASING"),
    ({"stage": None, "above_30wma": None, "mansfield_rs": None, "antonacci": None, "rrg_quadrant": None, "breadth_50d": None, "cmf21": None}, "HOLD"),
]


def test_rule_order(spark):
    rows = [(i, *{**BASE, **over}.values()) for i, (over, _) in enumerate(CASES)]
    out = states.with_state(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()
    assert [r.state for r in out] == [want for _, want in CASES]


def test_dead_lane_opens_its_gates(spark):
    df = spark.createDataFrame([(0, *{**BASE, "etf_flow_5d_pct": -9.0, "block_up_ratio": 0.1}.values())], SCHEMA)
    from pyspark.sql import functions as F

    dead = df.withColumns({"etf_flow_5d_pct_live": F.lit(None).cast("boolean"), "block_up_ratio_live": F.lit(False)})
    assert states.with_state(dead).first().state == "STAGE_2_BULLISH"


def test_flow_composite_is_zero_without_live_lanes(spark):
    rows = [("a", "t", 0.1, 0.2, 1.0), ("b", "t", 0.3, -0.2, 2.0)]
    df = scoring.neutral_lanes(spark.createDataFrame(rows, "ticker string, as_of string, cmf21 double, obv_slope double, rvol double"))
    assert [r.F_score for r in scoring.flow_composite(df).collect()] == [0.0, 0.0]


def test_composite_null_input_is_never_selected(spark):
    cols = "as_of string, ticker string, class string, mom_12_1 double, mansfield_rs double, rs_ratio double, rs_momentum double, F_score double, faber int, stage int, antonacci int"
    rows = [("t", t, "C", m, 1.0 * i, 100.0 + i, 100.0 - i, 0.0, 1, 2, 1) for i, (t, m) in enumerate([("a", 0.1), ("b", 0.3), ("c", None)])]
    out = {r.ticker: r for r in scoring.composite(spark.createDataFrame(rows, cols), top_n=1).collect()}
    assert out["c"].S_score is None and out["c"].rank_in_class is None and out["c"].selected is False
    assert out["b"].selected and not out["a"].selected
    one = scoring.contributions(scoring.composite(spark.createDataFrame(rows, cols), top_n=1)).where("ticker = 'b'").collect()
    assert sum(r.contribution for r in one) == pytest.approx(out["b"].S_score)


def test_transition_journal_dedupes(spark):
    s = spark.createDataFrame([("A", date(2024, 1, 5), "HOLD"), ("A", date(2024, 1, 12), "EXIT"), ("A", date(2024, 1, 19), "EXIT")], "ticker string, as_of date, state string")
    t = states.transitions(s)
    assert [(r.from_state, r.to_state) for r in t.collect()] == [("HOLD", "EXIT")]
    assert states.append_transitions(t, t.unionByName(t)).count() == 0
    assert states.append_transitions(t.where("false"), t.unionByName(t)).count() == 1


def test_fresh_storage_overrides(spark):
    comp = spark.createDataFrame([("A", "HOLD"), ("B", "HOLD")], "ticker string, state string")
    stored = spark.createDataFrame([("A", "EXIT", datetime(2024, 1, 1)), ("B", "EXIT", datetime(2023, 1, 1))], "ticker string, state string, updated timestamp")
    out = {r.ticker: r.state for r in states.reconcile(comp, stored, datetime(2024, 1, 2)).collect()}
    assert out == {"A": "EXIT", "B": "HOLD"}
