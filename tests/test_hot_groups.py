"""Hot ticker-days, month-end records, lane health, board order, searches without folds, sampled hits."""
from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelens.operators import board, calibrate, labels, lanes
from tapelens.sources import tables


def tape(spark, n=3000):
    """One ticker-day holds a third of all prints."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append(("HOT" if hot else f"T{i % 7}", 1 if hot else int(rng.integers(1, 9)), int(rng.integers(1, 6)) * 10.0, 20000.0, i * i))
    return spark.createDataFrame(rows, "ticker string, day int, price double, size double, number long")


def directions(rows):
    last, up, down = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.ticker, r.day, r.number)):
        before = last.get(r.ticker)
        if before is not None and r.price != before:
            side = up if r.price > before else down
            side[r.ticker] = side.get(r.ticker, 0.0) + r.price * r.size
        last[r.ticker] = r.price
    return {t: (up.get(t, 0.0), down.get(t, 0.0)) for t in last}


@pytest.mark.parametrize("most", [40, 333, 10**6])
def test_hot_ticker_day_in_ranges(spark, most):
    df = tape(spark)
    out = lanes.block_ratio(df, ["ticker"], ["day", "number"], most=most)
    assert {r.ticker: (r.up_notional, r.down_notional) for r in out.collect()} == directions(df.collect())
    ranges = lanes.sequence_ranges(df.withColumn("_b", F.col("day")), ["ticker", "_b"], "number", most)
    hot = ranges.where("ticker = 'HOT'").select("_r").distinct().count()
    assert hot == 1 if most > 1000 else hot > 1000 // most // 3


def test_block_tape_sorts_no_prints_for_its_edges(spark):
    plan = lanes.block_ratio(tape(spark), ["ticker"], ["day", "number"])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "SortAggregate" not in plan


def test_later_prints_change_no_earlier_fund_record(spark, tmp_path):
    days = [datetime(2020, m, d) for m in range(1, 10) for d in (3, 28)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    rows = [(k, 1, 1, 1, 10.0 + k, (10.0 + k) * 20, 0.0, d) for k, d in enumerate(days)]
    spark.createDataFrame([(1, "Brand#9")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    records = tables.shares_outstanding(spark, str(tmp_path))
    known = {r.ticker_month: r.last for r in tables.prints(spark, str(tmp_path)).groupBy(F.trunc("date", "month").alias("ticker_month")).agg(F.max("date").alias("last")).collect()}
    assert all(r.as_of >= known[r.as_of.replace(day=1)] for r in records.collect())
    before = {r.as_of: r.etf_flow_5d_pct for r in lanes.etf_flow(records).collect()}
    more = [(100, 1, 1, 1, 5000.0, 100000.0, 0.0, datetime(2020, 9, 29)), (101, 1, 1, 1, 70.0, 700.0, 0.0, datetime(2020, 11, 2))]
    spark.createDataFrame(more, schema).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    after = {r.as_of: r.etf_flow_5d_pct for r in lanes.etf_flow(tables.shares_outstanding(spark, str(tmp_path))).collect()}
    assert {d: v for d, v in after.items() if d < date(2020, 9, 29)} == {d: v for d, v in before.items() if d < date(2020, 9, 29)}


def test_lane_health(spark):
    t = [datetime(2026, 5, 1, 10, m) for m in range(9)]
    rows = [("one", "spy", "warning", "fallback cache", t[0])]
    rows += [("many", f"t{m % 7}", "warning" if m == 2 else "healthy", "neutral" if m == 2 else "live ok", t[m]) for m in range(9)]
    got = {r.lane: r for r in lanes.run_health(spark.createDataFrame(rows, "lane string, ticker string, status string, mode string, completed_at timestamp")).collect()}
    assert (got["one"].status, got["one"].mode, got["one"].detail) == ("warning", "fallback cache", "last completed 2026-05-01 10:00:00 UTC; SPY fallback cache")
    many = got["many"]
    assert (many.status, many.mode, many.samples) == ("warning", "8 live ok / 1 warning", "T0, T1, T2, T3, T4")
    assert (many.status_counts, many.mode_counts) == ("healthy=8, warning=1", "live ok=8, neutral=1")
    assert many.events.startswith("T0 live ok; T1 live ok; T2 neutral;") and many.detail.endswith("sample tickers: T0, T1, T2, T3, T4; warnings: T2 neutral")


def test_board_order(spark):
    rows = [("A", "HOLD", 1.0), ("B", "STAGE_2_BULLISH", 0.5), ("C", "HOLD", 1.0), ("D", "BEARISH_STAGE_4", 2.0), ("E", "HOLD", 3.0), ("F", None, 9.0)]
    df = spark.createDataFrame(rows, "ticker string, state string, S_score double")
    for c in ("F_score", "mom_12_1", "mansfield_rs", *board.PILLARS.values()):
        df = df.withColumn(c, F.lit(0.0)) if c not in df.columns else df
    df = df.withColumn("class", F.lit("X")).withColumn("name", F.translate("ticker", "ABCDEF", "fedcba"))

    def order(*args):
        return "".join(r.ticker for r in board.board(df, *args).orderBy("peer_rank").collect())

    assert order("state") == "BECADF" and order("state", False) == "FDACEB"
    assert order("S_score") == "FEDCAB" and order("S_score", False) == "BACDEF"
    assert order("identity", True, "name") == "ABCDEF" and order("no such key") == order("S_score")


def test_search_without_folds(spark):
    schema = "as_of date, horizon_weeks int, S_score_after_veto double, label_available boolean, positive_signal boolean, negative_signal boolean, positive_success boolean, negative_success boolean, fold string, window string"
    windowed = spark.createDataFrame([], schema)
    splits = spark.createDataFrame([], "name string")
    for given in ({"splits": splits}, {"splits": splits, "horizons": (13, 4)}, {}):
        (row,) = calibrate.candidate_search(windowed, [{"candidate_id": "baseline"}, {"candidate_id": "p", "positive_min": 0.3}], **given).collect()
        assert (row.candidate_id, row.gate_status, row.promotion_label) == ("no_ready_walk_forward_splits", "skipped_insufficient_history", "do not promote")
        assert row.horizon_weeks == (4 if "horizons" in given else None) and row.rejection_reasons == "no_ready_walk_forward_splits"
        assert not row.selected_by_calibration and row.final_holdout_rows_used == 0


def test_path_lows_by_weeks(spark):
    """Sparse table against the plain minimum, with missing days and whole missing weeks, any weekday."""
    rng = np.random.default_rng(2)
    rows, start = [], date(2020, 1, 1)
    for t in ("A", "B"):
        for k in range(500):
            if rng.random() < 0.6 and not (t == "B" and 100 < k < 160):
                rows.append((t, start + timedelta(days=k), float(rng.integers(50, 150))))
    df = spark.createDataFrame(rows, "ticker string, date date, price double")
    calendar = df.select(F.col("date").alias("as_of")).distinct().where("day(as_of) % 3 = 0")
    price = {(t, d): p for t, d, p in rows}
    days = sorted({d for _, d, _ in rows})
    asked = {r.as_of for r in calendar.collect()}
    got = {(r.ticker, r.as_of, r.horizon_weeks): r.path_low for r in labels.path_returns(df, calendar, (1, 2, 4, 13, 26)).collect()}
    checked = 0
    for t, a in price:
        for h in (1, 2, 4, 13, 26):
            end = next((d for d in days if d >= a + timedelta(weeks=h)), None)
            if a in asked and end is not None:
                last = price.get((t, end))
                low = min([p for (u, d), p in price.items() if u == t and a <= d <= a + timedelta(weeks=h)] + ([last] if last else []))
                assert got[t, a, h] == pytest.approx(low / price[t, a] - 1)
                checked += 1
    assert checked > 300


@pytest.mark.parametrize("n, hit", [(1, 1), (7, 0), (30, 9), (2000, 1200), (90_000, 300)])
def test_sampled_hits_follow_row_draws(spark, n, hit):
    """The sampler's interval against a bootstrap that draws every outcome."""
    blocks = spark.createDataFrame([("r", n, hit, n, hit)], "k string, base_n long, base_hit long, cand_n long, cand_hit long")
    row = calibrate.unpaired_bootstrap(blocks, ["k"], samples=2000).first()
    rng = np.random.default_rng(1)
    drawn = rng.binomial(n, hit / n, (2, 4000)) / n
    spread = (drawn[0] - drawn[1]).std()
    low, high = np.quantile(drawn[0] - drawn[1], [0.025, 0.975])
    assert row.mean_delta == 0 and row.candidate_sample_count == n
    assert abs(row.ci_low - low) <= 0.25 * spread + 1e-9 and abs(row.ci_high - high) <= 0.25 * spread + 1e-9


def test_binomial_table_is_the_distribution(spark):
    sides = spark.createDataFrame([("a", 12, 5)], "k string, n long, hit long")
    got = {r.hits: r.u / calibrate.UNIFORM for r in calibrate.binomial_table(sides, ["k"]).collect()}
    from math import comb

    p, total = 5 / 12, 0.0
    for k in range(13):
        total += comb(12, k) * p**k * (1 - p) ** (12 - k)
        assert got[k] == pytest.approx(total, abs=1e-8)
