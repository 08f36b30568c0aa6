"""Registered queries: macro statistics, phase, context, conditions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.columns import rounded
from ..operators import macro as m
from ..operators.pillars import with_faber
from ..sources.bars import pseudo_bars
from ..sources.tables import BENCH, macro, table
from .methodology import brand_calendar
from .prices import priced

# Configured series: id, group, label, unit, higher_up, by_year.
DIMENSION = [
    ("1-URGENT", "Growth", "Urgent", "index", True, True),
    ("2-HIGH", "Rates", "High", "percent", False, False),
    ("3-MEDIUM", "Liquidity", "Medium", "millions_usd", True, False),
    ("4-NOT SPECIFIED", "Credit", "Open", "number", False, False),
    ("5-LOW", "Liquidity", "Low", "billions_usd", True, True),
    ("6-NONE", "FX", "None", "index", False, False),
]
RULES = [
    {"rule": "urgent_rising", "series_id": "1-URGENT", "condition": "rising", "threshold": 0.0, "lookback": 3, "lag_days": 30, "multiplier": 0.5},
    {"rule": "high_falling", "series_id": "2-HIGH", "condition": "falling", "threshold": 2000.0, "lookback": 1, "lag_days": 0, "multiplier": 0.0},
    {"rule": "medium_above", "series_id": "3-MEDIUM", "condition": "above", "threshold": 252000.0, "lookback": 1, "lag_days": 5, "multiplier": 0.25},
    {"rule": "low_flat", "series_id": "5-LOW", "condition": "flat", "threshold": 4000.0, "lookback": 2, "lag_days": 10, "multiplier": 0.75},
]


def dimension(spark):
    return spark.createDataFrame(DIMENSION, "series_id string, `group` string, label string, unit string, higher_up boolean, by_year boolean")


def roles(spark, root):
    """The five series scaled into the classifier's inputs."""
    v, s = F.col("value"), F.col("series_id")
    gap = v / 250000 - 1
    name = (
        F.when(s == "1-URGENT", "INDPRO").when(s == "2-HIGH", "T10Y2Y").when(s == "3-MEDIUM", "T10Y3M")
        .when(s == "4-NOT SPECIFIED", "NFCI").otherwise("RECPROUSM156N")
    )
    scaled = (
        F.when(s == "1-URGENT", v).when(s == "2-HIGH", gap * 100 + 3).when(s == "3-MEDIUM", gap * 100 + 3)
        .when(s == "4-NOT SPECIFIED", gap * 20).otherwise(F.abs(gap) * 300)
    )
    return macro(spark, root).select(name.alias("series_id"), "date", scaled.alias("value"))


def _phase(spark, root):
    readings = m.wide_readings(roles(spark, root)).withColumn("ticker", F.lit(BENCH))
    signal = with_faber(priced(spark, root).where(F.col("ticker") == BENCH)).select("ticker", "date", (F.col("faber") == 1).alias("risk_on"))
    out = m.assess_regime(asof_backward(readings, signal.where("risk_on is not null"), ["ticker"], "date", ["risk_on"]))
    return rounded(out.drop("ticker"))


def _context(spark, root):
    out = m.context_rows(macro(spark, root), dimension(spark))
    return out.select("series_id", "group", "label", "value_text", "change", "tone", "sentiment_label", "trend_label", "trend_symbol", "gauge_pct")


def _snapshot(spark, root):
    out = m.snapshot_map(macro(spark, root), dimension(spark))
    entries = F.transform(
        F.map_entries("macro_snapshot"),
        lambda e: F.concat_ws(":", e["key"], e["value"]["label"], F.date_format(e["value"]["latest_date"], "yyyy-MM-dd"),
                              F.format_string("%.2f", e["value"]["latest_value"])),
    )
    return out.select(F.array_join(entries, ";").alias("snapshot"), F.size("macro_snapshot").alias("series"))


def _clean(spark, root):
    """Raw observations with repeated dates: every order is one, nulls in between."""
    o = table(spark, root, "orders")
    raw = o.select(
        F.col("o_orderpriority").alias("series_id"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("value"),
        F.struct("o_orderkey", "o_custkey", "o_totalprice").alias("ingest_order"),
    )
    return rounded(m.clean_series(raw))


QUERIES = {
    "macro_stats": lambda s, d: rounded(m.series_stats(macro(s, d)), 5),
    "macro_latest": lambda s, d: rounded(m.latest_stats(macro(s, d)), 5),
    "macro_clean": _clean,
    "macro_phase": _phase,
    "macro_context": _context,
    "macro_snapshot": _snapshot,
    "macro_pseudo_bars": lambda s, d: rounded(pseudo_bars(macro(s, d), 0.01)),
    "market_proxies": lambda s, d: rounded(m.market_proxies(priced(s, d)).drop("price")),
    "session_range": lambda s, d: rounded(m.session_range(priced(s, d))),
    "yield_curve_sign": lambda s, d: m.yield_curve_sign(
        priced(s, d).where("ticker = 'Brand#3'"), priced(s, d).where("ticker = 'Brand#4'")
    ),
    "macro_mask": lambda s, d: m.condition_mask(macro(s, d), brand_calendar(s, d).select("as_of"), RULES),
}
