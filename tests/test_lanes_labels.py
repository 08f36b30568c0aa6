from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapelens.operators import calibrate, debrief, holdings, labels, lanes
from tapelens.sources import bars, feeds, journal


def test_etf_flow(spark):
    rec = [("X", date(2026, 5, d), s * 1e6, n, a * 1e6) for d, s, n, a in [(12, 100, 50.0, 5000), (13, 100, 51.0, 5000), (14, 100, 52.0, 5000), (15, 100, 53.0, 5000), (18, 101, 50.0, 5050), (19, 102, 55.0, 5100)]]
    out = lanes.etf_flow(spark.createDataFrame(rec, "ticker string, as_of date, shares_outstanding double, nav double, aum double"))
    assert out.orderBy(F.desc("as_of")).first().etf_flow_5d_pct == pytest.approx(2.0588235294)


TAPE = [(100.0, 100.0, 1, 0), (101.0, 3000.0, 2, 0), (102.0, 500.0, 3, 0), (99.0, 4000.0, 4, 0), (98.0, 20000.0, 5, 1), (100.0, 10000.0, 6, 0)]


@pytest.mark.parametrize("bucket", ["ts", "floor(ts / 2)", "0"])
def test_block_ratio_does_not_depend_on_the_bucket(spark, bucket):
    df = spark.createDataFrame([("X", *r) for r in TAPE], "ticker string, price double, size double, ts int, correction int")
    out = lanes.block_ratio(df, ["ticker"], ["ts"], bucket=F.expr(bucket)).first()
    assert out.block_up_ratio == pytest.approx((101 * 3000 + 100 * 10000) / (99 * 4000))


def test_short_interest_and_dark_pool_and_filings(spark):
    s = "ticker string, settlement date, reported double, position double, previous double"
    one = [("X", date(2026, 5, 15), 12.5, None, None), ("X", date(2026, 4, 30), -3.0, None, None), ("Y", date(2026, 5, 15), None, 1250000.0, None), ("Y", date(2026, 4, 30), None, 1000000.0, None)]
    out = {r.ticker: r.si_delta_15d for r in lanes.short_interest_delta(spark.createDataFrame(one, s)).collect()}
    assert out == {"X": pytest.approx(12.5), "Y": pytest.approx(25.0)}
    d = [("X", date(2026, 5, 4), "ATS_W_SMBL", 100.0), ("X", date(2026, 5, 11), "ATS_W_SMBL", 400.0), ("X", date(2026, 5, 11), "OTC_W_SMBL", 600.0)]
    assert lanes.dark_pool_share(spark.createDataFrame(d, "ticker string, week date, summary_type string, shares double")).first().dark_pool_pct == pytest.approx(0.4)
    f = [("81369Y100", date(2025, 6, 30), 1000.0), ("81369y 100", date(2025, 9, 30), 1500.0), ("999999999", date(2025, 9, 30), 9999.0)]
    m = spark.createDataFrame([("81369Y100", "X")], "cusip string, ticker string")
    assert lanes.filings_net_buys(spark.createDataFrame(f, "cusip string, period date, shares double"), m).first().thirteen_f_q == pytest.approx(50.0)


def test_filing_and_fund_files(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("CUSIP\tREPORTCALENDARORQUARTER\tSSHPRNAMT\nab 1\t2025-06-30\t1,000\n")
    row = feeds.read_filings(spark, str(tmp_path / "info.tsv")).first()
    assert (row.cusip, row.period, row.shares) == ("AB1", date(2025, 6, 30), 1000.0)
    (tmp_path / "fund.csv").write_text("Fund report\nDate,Shares Outstanding,NAV,Net Assets\n5/12/2026,100.5M,$50.00,5.1B\n")
    r = feeds.read_fund_csv(spark, str(tmp_path / "fund.csv")).first()
    assert (r.as_of, r.shares_outstanding, r.nav, r.aum) == (date(2026, 5, 12), 100.5e6, 50.0, 5.1e9)
    (tmp_path / "funds").mkdir()
    (tmp_path / "funds" / "a.csv").write_text("Date,Shares Outstanding,NAV,Net Assets,Note\n5/12/2026,\"100,000\",$50.00,5.1B,\n5/13/2026,1M,51,5.2B,x\n")
    (tmp_path / "funds" / "b.csv").write_text("Preamble\nNAV,Net Assets,Sho,Date\n7,1M,2K,5/14/2026\n")
    got = sorted((x.as_of.day, x.shares_outstanding, x.nav, x.aum) for x in feeds.read_fund_csv(spark, str(tmp_path / "funds")).collect())
    assert got == [(12, 100_000.0, 50.0, 5.1e9), (13, 1e6, 51.0, 5.2e9), (14, 2e3, 7.0, 1e6)]


def test_wide_fund_files(spark, tmp_path):
    pad, cells = ",".join(f"x{i}" for i in range(90)), ",".join("0" for _ in range(90))
    (tmp_path / "wide.csv").write_text(f"{pad},Date,Shares Outstanding,NAV,Net Assets\n{cells},5/12/2026,1M,50,5.1B\n")
    (tmp_path / "narrow.csv").write_text("NAV,Net Assets,Sho,Date\n7,1M,2K,5/14/2026\n")
    got = sorted((x.as_of.day, x.shares_outstanding, x.nav, x.aum) for x in feeds.read_fund_csv(spark, str(tmp_path)).collect())
    assert got == [(12, 1e6, 50.0, 5.1e9), (14, 2e3, 7.0, 1e6)]


def test_header_spellings():
    aliases = {"shares": ("shares", "quantity"), "cost_basis": ("cost basis", "cost")}
    assert feeds.assign_columns(["Quantity", "SHARES ", "Cost_Basis", "Cost", "other"], aliases) == {"shares": "SHARES ", "cost_basis": "Cost_Basis"}


def label_inputs(spark):
    days = [date(2024, 1, 5), date(2024, 1, 12), date(2024, 2, 2), date(2024, 2, 9)]
    px = {"XLK": [100, 90, 110, 112], "XLF": [100, 85, 90, 88], "SPY": [100, 98, 105, 106]}
    prices = [(t, d, float(p)) for t, ps in px.items() for d, p in zip(days, ps)]
    scored = [(days[0], "XLK", "S", "STAGE_2_BULLISH", True), (days[0], "XLF", "S", "EXIT", False)]
    sc = spark.createDataFrame(scored, "as_of date, ticker string, class string, state string, selected boolean").withColumns(
        {"veto": F.lit(False), "S_score": F.lit(1.0), "S_score_after_veto": F.lit(1.0), "rs_ratio_z": F.lit(0.0)}
    )
    cal = spark.createDataFrame([(days[0],)], "as_of date")
    return prices, sc, cal


def test_forward_labels(spark):
    prices, sc, cal = label_inputs(spark)
    px = spark.createDataFrame(prices, "ticker string, date date, price double")
    out = {r.ticker: r for r in labels.forward_labels(sc, px, cal, {}, "SPY", (4,), -0.10).collect()}
    k, f = out["XLK"], out["XLF"]
    assert (k.forward_return, k.excess_return, k.drawdown) == (pytest.approx(0.10), pytest.approx(0.05), pytest.approx(-0.10))
    assert k.positive_success and not k.negative_success
    assert (f.forward_return, f.excess_return, f.drawdown) == (pytest.approx(-0.10), pytest.approx(-0.15), pytest.approx(-0.15))
    assert f.avoided_underperformance and f.failed_followthrough and f.avoided_drawdown and f.negative_success


def test_gap_in_the_path_makes_a_label_unavailable(spark):
    prices, sc, cal = label_inputs(spark)
    px = spark.createDataFrame([p for p in prices if p[:2] != ("XLK", date(2024, 1, 12))], "ticker string, date date, price double")
    out = {r.ticker: r.label_available for r in labels.forward_labels(sc, px, cal, {}, "SPY", (4,)).collect()}
    assert out == {"XLK": False, "XLF": True}


def test_walk_forward_folds_never_touch_the_holdout(spark):
    days = [date(2016, 1, 1) + timedelta(days=7 * i) for i in range(521)]
    cal = spark.createDataFrame([(d,) for d in days], "as_of date")
    folds = labels.walk_forward_splits(cal, years=9, calibration_years=5).collect()
    assert len(folds) >= 2
    for f in folds:
        assert f.calibration_start <= f.calibration_end < f.validation_start <= f.validation_end < f.final_holdout_start
    assert labels.walk_forward_splits(cal, years=15, calibration_years=5).count() == 0
    with pytest.raises(ValueError):
        labels.walk_forward_splits(cal, years=7, calibration_years=5)


def test_block_bootstrap_observed_delta(spark):
    b = [("r", 4, date(2024, 1, 5), 3, 1, 1, 1), ("r", 4, date(2024, 1, 12), 3, 0, 1, 0)]
    df = spark.createDataFrame(b, "candidate_id string, horizon_weeks int, as_of date, base_n bigint, base_hit bigint, cand_n bigint, cand_hit bigint")
    r = calibrate.block_bootstrap(df, ["candidate_id", "horizon_weeks"], samples=200, seed=17).first()
    assert (r.mean_delta, r.block_count, r.candidate_count, r.baseline_count, r.valid_resamples) == (0.333333, 2, 2, 6, 200)
    assert r.ci_low <= r.mean_delta <= r.ci_high


def test_grid_has_nine_rules_per_scope(spark):
    scopes = spark.createDataFrame([("global", None)] + [(f"C{i}", None) for i in range(4)] + [("C0", f"T{i}") for i in range(11)], "scope string, sector string")
    assert calibrate.scope_grid(scopes).count() == 144


def test_debrief(spark):
    days = [date(2026, 1, 2) + timedelta(days=i) for i in range(6)]
    px = [("UP", d, float(p)) for d, p in zip(days, (100, 101, 102, 103, 104, 110))] + [("DN", d, float(p)) for d, p in zip(days, (100, 99, 98, 97, 96, 92))]
    prices = spark.createDataFrame(px, "ticker string, date date, price double")
    dec = [(1, datetime(2026, 1, 2, 9), "UP", "BUY"), (1, datetime(2026, 1, 2, 9), "DN", "EXIT"), (1, datetime(2026, 1, 2), "NO", "BUY"), (1, datetime(2027, 1, 2), "UP", "BUY"), (1, datetime(2026, 1, 2), "UP", "PONDER")]
    d = spark.createDataFrame(dec, "run_id int, started_at timestamp, ticker string, action string")
    out = {(r.ticker, r.action, r.started_at.year): r for r in debrief.outcomes(d, prices, {"1w": 5}).collect()}
    up, dn = out[("UP", "BUY", 2026)], out[("DN", "EXIT", 2026)]
    assert (up.forward_return, up.hit, up.max_drawdown) == (pytest.approx(0.1), True, pytest.approx(0.0))
    assert (dn.forward_return, dn.hit, dn.max_drawdown) == (pytest.approx(-0.08), True, pytest.approx(-0.08))
    assert out[("NO", "BUY", 2026)].status == "missing_ticker"
    assert out[("UP", "BUY", 2027)].status == "no_baseline"
    assert out[("UP", "PONDER", 2026)].status == "unsupported_action"


def test_holdings_file(spark):
    raw = spark.createDataFrame([(2, "xlk", "2,500", "25%"), (3, "XLF", "oops", "25"), (4, "", "1", "")], ["row_number", "Symbol", "Quantity", "Weight"])
    parsed = feeds.parse_holdings(raw)
    ok = {r.ticker: r for r in parsed.where("ticker is not null").collect()}
    assert ok["XLK"].shares == 2500 and ok["XLK"].weight == 0.25 and ok["XLF"].weight == 0.25
    assert {(r.row_number, r.message) for r in feeds.error_rows(parsed).collect()} == {(3, "shares is not a number"), (4, "no ticker")}


def test_trade_alignment(spark):
    s = [("XLK", date(2024, 1, 2), "STAGE_2_BULLISH"), ("XLK", date(2024, 1, 4), "WARNING"), ("XLF", date(2024, 1, 2), "HOLD"), ("XLF", date(2024, 1, 4), "EXIT")]
    t = [("XLK", date(2024, 1, 3), "BUY"), ("XLF", date(2024, 1, 5), "SELL"), ("XLV", date(2024, 1, 5), "BUY")]
    out = holdings.trade_alignment(
        spark.createDataFrame(t, "ticker string, trade_date date, side string"), spark.createDataFrame(s, "ticker string, as_of date, state string")
    )
    assert {r.ticker: r.alignment for r in out.collect()} == {"XLK": "ALIGNED", "XLF": "ALIGNED", "XLV": "NO_METHOD_STATE"}


def test_bar_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1d", date(2024, 1, 2), 1.0), ("B", "1wk", date(2024, 1, 5), 2.0)], "ticker string, interval string, date date, close double")
    path = str(tmp_path / "bars")
    bars.write_bars(rows, path)
    bars.write_bars(rows.where("interval = '1d'").withColumn("close", F.lit(3.0)), path)
    got = {(r.ticker, r.close) for r in spark.read.parquet(path).collect()}
    assert got == {("A", 3.0), ("B", 2.0)}


def test_digest_ignores_row_order_and_ids(spark):
    a = spark.createDataFrame([("x", "A", 1.0), ("x", "B", 2.0)], "run_id string, ticker string, s double")
    b = spark.createDataFrame([("y", "B", 2.0), ("y", "A", 1.0)], "run_id string, ticker string, s double")
    c = spark.createDataFrame([("z", "A", 1.0), ("z", "B", 3.0)], "run_id string, ticker string, s double")
    d = [journal.run_digests(x).first().digest for x in (a, b, c)]
    assert d[0] == d[1] != d[2]


def test_csv_artifact(spark, tmp_path):
    journal.write_csv(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
