"""Queries that have to do their whole job: every outcome drawn, readings that are read."""
from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapelens.operators import calibrate, lanes
from tapelens.plans.methodology import latest, scored_table
from tapelens.sources import feeds, tables

ROOT = "/root/testdata/sf0.001"


def test_every_outcome_of_a_resample_is_drawn(spark):
    """Interval of the row draws, made anew one outcome at a time; sides beyond one chunk too."""
    p, samples, sides = 2147483647, 40, {"cand": (5000, 1700, 42), "base": (37, 9, 49)}

    def rate(n, hit, salt, s):
        hits = 0
        for j in range(n):
            h = (s * 1000003 + j * 10007 + salt) % p
            h = (h * h + 12345) % p
            h = (h * 48271 + j) % p
            hits += (h * h % p) % n < hit
        return hits / n

    d = [rate(*sides["cand"], s) - rate(*sides["base"], s) for s in range(samples)]
    blocks = spark.createDataFrame([("r", 37, 9, 5000, 1700)], "k string, base_n long, base_hit long, cand_n long, cand_hit long")
    row = calibrate.unpaired_row_bootstrap(blocks, ["k"], samples=samples).first()
    low, high = np.quantile(d, [0.025, 0.975])
    assert (row.ci_low, row.ci_high) == (round(low, 6), round(high, 6))
    assert (row.candidate_sample_count, row.baseline_sample_count) == (5000, 37)


def test_flow_extremes_rank_a_reading(spark):
    """The neutral flow score of the plain replay is 0 everywhere and ranks nothing."""
    now = {r.ticker: r.cmf21 or 0.0 for r in latest(scored_table(spark, ROOT)).select("ticker", "cmf21").collect()}
    got = {(r.side, r.ticker): r.reading for r in entry.queries()["flow_extremes"](spark, ROOT).collect()}
    low, high = sorted(now, key=lambda t: (now[t], t))[:5], sorted(now, key=lambda t: (-now[t], t))[:5]
    assert set(got) == {("outflow", t) for t in low} | {("inflow", t) for t in high}
    assert len(set(got.values())) > 2 and all(abs(v - now[t]) < 1e-6 for (_, t), v in got.items())


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tape(spark):
    """Prints of two tickers; a third of them on one day, some orders twice on a line."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(4000):
        hot = i % 3 == 0
        day = date(2020, 1, 10) if hot else date(2020, 1, 1) + timedelta(days=int(rng.integers(0, 60)))
        rows.append(("HOT" if hot or i % 2 else "B", day, int(rng.integers(1, 9)) * 10.0, 20000.0, int(rng.integers(0, 900)), int(rng.integers(1, 4)), int(rng.integers(1, 50)), i))
    return spark.createDataFrame(rows, "ticker string, date date, price double, size double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")


@pytest.mark.parametrize("most", [25, 10**6])
def test_block_ratio_by_plain_order_columns(spark, most):
    """Prints ordered by several columns, crowded days cut by a table that is given."""
    df = _tape(spark)
    order, crowds = ["date", *tables.PRINT_ORDER, "size", "price"], df.groupBy("ticker", F.col("date").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.col("l_orderkey").cast("double")).alias("_low"), F.max(F.col("l_orderkey").cast("double")).alias("_high"))
    last, up, down = {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.ticker, *[r[c] for c in order])):
        before = last.get(r.ticker, r.price)
        up[r.ticker] = up.get(r.ticker, 0.0) + r.price * r.size * (r.price > before)
        down[r.ticker] = down.get(r.ticker, 0.0) + r.price * r.size * (r.price < before)
        last[r.ticker] = r.price
    for crowd in (None, crowds):
        got = lanes.block_ratio(df, ["ticker"], order, most=most, crowd=crowd).collect()
        assert {r.ticker: (r.up_notional, r.down_notional) for r in got} == {t: (up[t], down[t]) for t in last}


def test_block_ratio_reads_the_tape_once(spark):
    """Beside the count of crowded days, which a table may give, prints are read and sorted once."""
    df = _tape(spark)
    given = df.groupBy("ticker", F.col("date").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.lit(0.0).alias("_low"), F.lit(1.0).alias("_high")).localCheckpoint()
    plan = _optimized(lanes.block_ratio(df, ["ticker"], ["date", *tables.PRINT_ORDER], crowd=given))
    assert sum("LogicalRDD" in line and "l_orderkey" in line for line in plan.splitlines()) == 1


def test_day_table_tells_the_lanes(spark):
    """Funds, venues and positions of the day table are those of the prints."""
    p = tables.prints(spark, ROOT)
    days = tables.days_from_prints(p)
    plain = {(r.ticker, r.as_of): r for r in tables.shares_outstanding(spark, ROOT).collect()}
    funds = {(r.ticker, r.as_of): r for r in tables.monthly_funds(days).collect()}
    assert set(plain) == set(funds) and all(
        funds[k].shares_outstanding == r.shares_outstanding and funds[k].nav == pytest.approx(r.nav) and funds[k].aum == pytest.approx(r.aum) for k, r in plain.items()
    )
    bars = {tuple(r) for r in tables.bars(spark, ROOT).collect()}
    assert {tuple(r) for r in days.select(*tables.BAR_COLUMNS).collect()} == bars


def test_a_holdings_cell_is_read_once(spark):
    """Neither the errors nor a filter that Spark derives from them parse a cell again."""
    raw = spark.createDataFrame([(1, "aa", "7", "$1", "5%"), (2, " ", "x", "", ""), (3, "b b", "x", "", ""), (4, "cc", "x", "y", "1,0%")], "row_number long, Symbol string, Quantity string, Value string, Weight string")
    errors = feeds.error_rows(feeds.parse_holdings(raw))
    assert sorted((r.row_number, r.message) for r in errors.collect()) == [
        (2, "no ticker"), (3, "ticker with characters outside the allowed set"), (4, "market_value is not a number"), (4, "shares is not a number")]
    plan = _optimized(errors)
    assert plan.count("RLIKE") == 1 and plan.count("as double") == 3


def test_filings_meet_their_map_before_they_are_summed(spark):
    """One sum per ticker and period; cusips of two spellings, two tickers or none."""
    rows = [("c 1", date(2020, 1, 1), 10.0)] * 50 + [("C1", date(2020, 4, 1), 700.0), ("c2", date(2020, 4, 1), 50.0), ("c9", date(2020, 4, 1), 9.0), ("c2", date(2020, 4, 1), None)]
    cusips = spark.createDataFrame([("C1", "A"), ("c 1", "A"), ("C2", "A"), ("C2", "B")], "cusip string, ticker string")
    out = lanes.filings_net_buys(spark.createDataFrame(rows, "cusip string, period date, shares double"), cusips)
    assert {r.ticker: r.thirteen_f_q for r in out.collect()} == {"A": pytest.approx(50.0), "B": None}
    assert sum("Aggregate" in line and "sum(shares" in line for line in _optimized(out).splitlines()) == 1
