from __future__ import annotations

from datetime import date

import pytest
from conftest import BAR_SCHEMA, growth_rows, weekdays
from pyspark.sql import functions as F

from tapelens.functions.calendar import period_start, rebalance_calendar
from tapelens.operators import flow, pillars, resample
from tapelens.plans.methodology import daily_readings, panel_calendar, snapshots
from tapelens.sources.tables import with_price


def last(df, ticker):
    return df.where(F.col("ticker") == ticker).orderBy(F.desc("date")).first()


def test_short_history_has_no_readings(spark):
    b = with_price(spark.createDataFrame(growth_rows("AAA", 100, 0.001, 40), BAR_SCHEMA))
    row = last(daily_readings(b), "AAA")
    assert row.mom_12_1 is None and row.breadth_50d is None and row.faber is None and row.dist_days_25 is None


def test_momentum_is_rows_20_and_251_back(market):
    row = last(pillars.daily_pillars(with_price(market)), "XLK")
    assert row.mom_12_1 == pytest.approx(1.0014**231 - 1)
    assert row.return_5d == pytest.approx(1.0014**5 - 1)
    assert row.breadth_50d == 1.0


def test_return_needs_a_positive_session_count():
    with pytest.raises(ValueError):
        pillars.row_return(0)


def test_growing_sector_against_benchmark(market):
    b = with_price(market)
    s = snapshots(b, panel_calendar(b), "SPY", "BIL")
    row = s.where("ticker = 'SOXX'").orderBy(F.desc("as_of")).first()
    assert (row.stage, row.above_30wma, row.ma_slope_pos, row.antonacci, row.faber) == (2, True, True, 1, 1)
    assert row.mansfield_rs > 0
    assert s.where("ticker in ('BIL', '^TNX')").count() == 0


def test_no_lookahead(market):
    """Readings at a date do not change when later rows are removed."""
    b = with_price(market)
    cut = date(2022, 6, 30)
    cols = ["ticker", "date", "mom_12_1", "faber", "cmf21", "obv_slope", "breadth_50d"]
    full = daily_readings(b).where(F.col("date") == cut).select(*cols).orderBy("ticker").collect()
    short = daily_readings(b.where(F.col("date") <= cut)).where(F.col("date") == cut).select(*cols).orderBy("ticker").collect()
    assert full == short


def test_flat_close_near_high_gives_cmf(spark):
    rows = [("A", d, 9.0, 10.0, 0.0, 9.0, 9.0, 1000.0) for d in weekdays(date(2024, 1, 1), 30)]
    row = last(flow.flow_indicators(spark.createDataFrame(rows, BAR_SCHEMA)), "A")
    assert row.cmf21 == pytest.approx(0.8)
    assert row.obv_slope is None


def test_relative_volume_excludes_today(spark):
    days = weekdays(date(2024, 1, 1), 21)
    rows = [("A", d, 1.0, 1.0, 1.0, 1.0, 1.0, 100.0 if i < 20 else 250.0) for i, d in enumerate(days)]
    assert last(flow.flow_indicators(spark.createDataFrame(rows, BAR_SCHEMA)), "A").rvol == pytest.approx(2.5)


def test_rebalance_date_without_friday(spark):
    days = spark.createDataFrame([(date(2024, 3, d),) for d in (25, 26, 27, 28)], "date date")
    assert rebalance_calendar(days).first().as_of == date(2024, 3, 28)


def test_weekly_spine_keeps_empty_weeks(spark):
    rows = [("A", date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 5.0), ("A", date(2024, 1, 23), 2.0, 2.0, 2.0, 2.0, 2.0, 7.0)]
    out = resample.weekly_spine(resample.weekly_bars(with_price(spark.createDataFrame(rows, BAR_SCHEMA)))).orderBy("week_end").collect()
    assert [(r.traded, r.price, r.volume) for r in out] == [(True, 1.0, 5.0), (False, None, 0.0), (False, None, 0.0), (True, 2.0, 7.0)]


@pytest.mark.parametrize(
    "text, start",
    [("3y", date(2021, 1, 1)), ("6mo", date(2023, 6, 29)), ("10d", date(2023, 12, 22)), ("max", date(2003, 1, 1)), ("soon", date(2003, 1, 1))],
)
def test_period_text(text, start):
    assert period_start(text, date(2024, 1, 1)) == start
