"""Registered queries against their DuckDB statements on the smallest tables."""
from __future__ import annotations

import duckdb
import pytest
from check_oracle import TABLES, compare

import __spark_entry__ as entry
from tapelens.plans import catalog

ROOT = "/root/testdata/sf0.001"
FAST = (
    "bars_daily bars_weekly momentum stage rrg cmf_obv_mfi distribution_days macro_stats macro_phase macro_mask price_panel block_tape etf_flow "
    "dark_pool short_interest thirteen_f provider_readiness pnl_rollup bars_upsert fund_records holdings_errors trades_errors ticker_lists "
    "cache_coverage data_health config_guardrail class_lookup stream_bars composite_rank backtest_metrics forward_labels debrief_summary "
    "config_universe snapshot_counts flow_signals_run fund_csv filing_table csv_artefact candidate_grid "
    "live_composite board_sorts stream_dedupe journal_new_runs journal_decisions journal_runs snapshot_upsert stream_journal"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert compare([tuple(x) for x in df.collect()], df.columns, cur.fetchall(), cols) == ""


def test_every_query_has_a_statement():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
