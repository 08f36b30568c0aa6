"""Band cube, last runs of a lane, data-health lanes, counts by action, configuration hash."""
from __future__ import annotations

from datetime import date, datetime
from itertools import product

from tapelens.operators import board, calibrate, health, lanes, scoring


def test_grid_blocks_equal_counts_per_rule(spark):
    scores = (None, -1.2, -1.0, -0.6, 0.0, 0.7, 0.8, 1.0, 1.1, 1.3)
    rows = []
    for i, (s, strength) in enumerate(product(scores, (None, -0.1, 0.0, 2.0))):
        rows.append(("T%d" % (i % 3), "C%d" % (i % 2), date(2020, 1, 1 + i % 2), date(2020, 2, 1), 4, s, strength, i % 3 != 0, i % 4 != 0, i % 5 == 0, i % 2 == 0, i % 7 != 0, i / 10, i / 20, -i / 30))
    columns = "ticker string, class string, as_of date, end_date date, horizon_weeks int, S_score_after_veto double, rs_ratio_z double, positive_signal boolean, negative_signal boolean, positive_success boolean, negative_success boolean, label_available boolean, forward_return double, excess_return double, drawdown double"
    labels = spark.createDataFrame(rows, columns)
    split = spark.createDataFrame(
        [("ready", date(2020, 1, 1), date(2020, 3, 1), date(2021, 1, 1), date(2021, 2, 1))], "status string, train_start date, train_end date, holdout_start date, holdout_end date"
    )
    got = {(r.candidate_id, r.scope, r.sector, r.as_of): r for r in calibrate.grid_blocks(labels, split).collect()}
    seen = set()
    for rule, (ticker, cls), day in product(calibrate.grid_rules(), [(t, c) for t in (None, "T0", "T1", "T2") for c in (None, "C0", "C1")], (1, 2)):
        if cls is None and ticker is not None:
            continue
        up = rule["direction"] == "positive"
        mine = [x for x in rows if (cls is None or x[1] == cls) and (ticker is None or x[0] == ticker) and x[2].day == day]
        base = [x for x in mine if x[7 if up else 8] and x[11]]
        chosen = [x for x in base if x[5] is not None and (x[5] >= rule["limit"] if up else x[5] <= rule["limit"]) and not (rule["strength"] and (x[6] is None or x[6] < 0))]
        if not mine:
            continue
        prefix = (ticker or cls or "global").lower()
        r = got[(f"{prefix}_{rule['suffix']}", cls or "global", ticker, date(2020, 1, day))]
        seen.add(id(r))
        hits = lambda part: sum(1 for x in part if x[9 if up else 10])
        assert (r.base_n, r.base_hit, r.cand_n, r.cand_hit) == (len(base), hits(base), len(chosen), hits(chosen))
        assert abs((r.sum_return or 0) - sum(x[12] for x in chosen)) < 1e-9
    assert len(seen) == len(got)


def test_last_run_decides_a_lane(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    events = spark.createDataFrame(
        [("a", "X", "healthy", "live ok", at(1)), ("a", "X", "warning", "cache", at(2)), ("a", "Y", "warning", "cache", at(1)), ("a", "Y", "healthy", "live ok, 3 rows", at(2)),
         ("b", "X", "healthy", "cache", at(1)), ("b", "Y", "warning", "cache", at(5)), ("b", "Y", "healthy", "live ok", at(5)), ("b", "Z", None, None, at(5))],
        "lane string, ticker string, status string, mode string, completed_at timestamp",
    )
    got = {(r.lane, r.ticker): r.live for r in lanes.last_runs(events).collect()}
    assert got == {("a", "X"): False, ("a", "Y"): True, ("b", "X"): False, ("b", "Y"): True, ("b", "Z"): False}
    readings = spark.createDataFrame([("X", 2.0), ("Y", 3.0), ("Z", None)], "ticker string, etf_flow_5d_pct double")
    runs = spark.createDataFrame([("etf_flow_5d_pct", "X", False), ("etf_flow_5d_pct", "Y", True), ("etf_flow_5d_pct", "Z", True)], "lane string, ticker string, live boolean")
    out = {r.ticker: r.etf_flow_5d_pct_live for r in scoring.with_lanes(readings.select("ticker"), readings, ["ticker"], runs).collect()}
    assert out == {"X": False, "Y": True, "Z": False}


def test_compute_lane(spark):
    now = datetime(2024, 1, 1, 12)
    for at, want in ((datetime(2024, 1, 1, 11), ("healthy", "60m old")), (datetime(2024, 1, 1, 10, 58), ("warning", "62m old")), (datetime(2024, 1, 1, 13), ("healthy", "0m old")), (None, ("warning", "missing"))):
        r = health.compute_health(spark.createDataFrame([(at,)], "created_at timestamp_ntz"), now).first()
        assert (r.status, r.freshness) == want


def test_market_lane_names_its_sources(spark):
    bars = spark.createDataFrame(
        [("A", date(2024, 1, 1), "old"), ("A", date(2024, 1, 5), "beta"), ("B", date(2024, 1, 4), "alpha"), ("C", date(2024, 1, 5), "beta")], "ticker string, date date, provider string"
    )
    expected = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "ticker string")
    r = health.bar_health(bars, expected, date(2024, 1, 6)).first()
    assert (r.status, r.loaded, r.expected, r.detail) == ("stale", 3, 4, "source mix alpha 1, beta 2")


def test_counts_by_action(spark):
    scored = spark.createDataFrame([("HOLD", None), ("EXIT", "Lagging")], "state string, rrg_quadrant string")
    decisions = spark.createDataFrame([("BUY",), (None,), (" ",), ("BUY",)], "action string")
    got = {(r.dimension, r.label): r.members for r in board.counts(scored, decisions).collect()}
    assert got[("action", "BUY")] == 2 and got[("action", "REVIEW")] == 2 and got[("quadrant", "Unknown")] == 1 and len(got) == 6


def test_config_hash_sees_universe_and_values(spark):
    config = scoring.baseline_configuration({"C0": 2}, "SPY", "BIL")
    pairs = [("A", "C0"), ("B", "C1"), ("B", "C1")]
    table = lambda rows: spark.createDataFrame(rows, "ticker string, class string")
    one = scoring.config_hash(table(pairs), config).first()
    assert one == scoring.config_hash(table(pairs[::-1]).repartition(3), config).first() and one.universe_count == 2
    assert one.config_sha256 != scoring.config_hash(table([("A", "C1"), ("B", "C1")]), config).first().config_sha256
    assert one.config_sha256 != scoring.config_hash(table(pairs), scoring.baseline_configuration({"C0": 2}, "SPY", "BIL", cost_bps=3.0)).first().config_sha256
    assert scoring.config_hash(table([]), config).first().universe_count == 0
