"""Cross-sectional composite: z-scores per class, veto, rank and selection."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import zscore

# Composite weights, filter count and veto rule.
WEIGHTS = {
    "mom_12_1_z": 0.22,
    "mansfield_rs_z": 0.12,
    "rs_ratio_z": 0.15,
    "rs_momentum_z": 0.08,
    "binary_filters": 0.12,
    "cycle_tilt": 0.08,
    "flow_z": 0.23,
}
FILTER_COUNT = 3.0
VETO_BELOW = -0.5
VETO_SCORE = -9.99
# Weights of the flow composite.
FLOW_WEIGHTS = {"cmf": 0.30, "obv": 0.20, "etf": 0.20, "block": 0.10, "rvol": 0.10, "short": -0.10}
# Neutral reading of each provider lane.
NEUTRAL = {
    "etf_flow_5d_pct": 0.0,
    "block_up_ratio": 1.0,
    "dark_pool_pct": 0.40,
    "si_delta_15d": 0.0,
    "thirteen_f_q": 0.0,
}
# Sector symbols favoured in each business-cycle phase.
FAVOURED = {
    "EARLY": ("XLY", "XLF", "XLRE", "XLI", "XLK", "XLB"),
    "MID": ("XLK", "XLC", "XLI"),
    "LATE": ("XLE", "XLB", "XLP", "XLV"),
    "RECESSION": ("XLP", "XLU", "XLV"),
}
SECTOR_PREFIX = "XL"


def cycle_tilt(ticker: Column, phase: Column | str, favoured: dict | None = None, prefix: str = SECTOR_PREFIX) -> Column:
    """+1 for a favoured sector, -1 for another sector, 0 else or without a phase map."""
    favoured = FAVOURED if favoured is None else favoured
    phase = F.lit(phase) if isinstance(phase, str) else phase
    out = F.lit(0.0)
    for name, symbols in favoured.items():
        tilt = F.when(ticker.isin(*symbols), 1.0).when(ticker.startswith(prefix), -1.0).otherwise(0.0)
        out = F.when(phase == name, tilt).otherwise(out)
    return out


def with_class(df: DataFrame, dimension: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Class of a ticker: override, else the universe dimension, else Other (F2).

    Both tables hold one row per listed instrument; Spark broadcasts them itself while
    they are below its size threshold and shuffles them beyond it.
    """
    out = df.join(dimension.select("ticker", F.col("class").alias("_dim")), "ticker", "left")
    if overrides is not None:
        out = out.join(overrides.select("ticker", F.col("class").alias("_over")), "ticker", "left")
    else:
        out = out.withColumn("_over", F.lit(None).cast("string"))
    return out.withColumn("class", F.coalesce("_over", "_dim", F.lit("Other"))).drop("_dim", "_over")


def neutral_lanes(df: DataFrame) -> DataFrame:
    """Provider lanes at their neutral readings and not live."""
    for name, value in NEUTRAL.items():
        df = df.withColumn(name, F.lit(value)).withColumn(f"{name}_live", F.lit(False))
    return df


def with_lanes(df: DataFrame, lanes: DataFrame, keys: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Left-join lane readings; a missing reading is neutral and not live.

    ``runs`` has ticker, lane, live: what each ticker's last run of a lane said. With it a reading
    counts as live only if that run was.
    """
    out = df.join(lanes, keys, "left")
    if runs is not None:
        flags = [F.coalesce(F.bool_or(F.when(F.col("lane") == name, F.col("live"))), F.lit(False)).alias(f"_run_{name}") for name in NEUTRAL]
        out = out.join(runs.groupBy("ticker").agg(*flags), "ticker", "left")
    for name, value in NEUTRAL.items():
        reading = F.col(name) if name in lanes.columns else F.lit(None).cast("double")
        live = reading.isNotNull() if runs is None else reading.isNotNull() & F.coalesce(F.col(f"_run_{name}"), F.lit(False))
        out = out.withColumn(f"{name}_live", live).withColumn(name, F.coalesce(reading, F.lit(value)))
    return out.drop(*[f"_run_{name}" for name in NEUTRAL])


def flow_composite(df: DataFrame, as_of: str = "as_of") -> DataFrame:
    """F score over the whole flow cross-section.

    A lane that is not live is null, which nulls the sum and so gives 0.
    """

    def live(name: str) -> Column:
        flag = f"{name}_live"
        return F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(name)) if flag in df.columns else F.col(name)

    readings = {
        "cmf": F.col("cmf21"),
        "obv": F.col("obv_slope"),
        "etf": live("etf_flow_5d_pct"),
        "block": live("block_up_ratio"),
        "rvol": F.col("rvol"),
        "short": live("si_delta_15d"),
    }
    total = sum((FLOW_WEIGHTS[k] * zscore(v, [as_of]) for k, v in readings.items()), F.lit(0.0))
    return df.withColumn("F_score", F.coalesce(total, F.lit(0.0)))


def composite(
    df: DataFrame,
    phase: Column | str = "MID",
    top_n: dict[str, int] | int = 0,
    as_of: str = "as_of",
    favoured: dict | None = None,
    prefix: str = SECTOR_PREFIX,
) -> DataFrame:
    """S score, veto, rank in class and selection for every as-of date."""
    df = df.where("class <> 'Benchmark'").withColumn("cycle_tilt", cycle_tilt(F.col("ticker"), phase, favoured, prefix))
    sources = {
        "mom_12_1_z": "mom_12_1",
        "mansfield_rs_z": "mansfield_rs",
        "rs_ratio_z": "rs_ratio",
        "rs_momentum_z": "rs_momentum",
        "flow_z": "F_score",
    }
    z = df.withColumns({name: zscore(c, [as_of, "class"]) for name, c in sources.items()})
    filters = (
        F.coalesce(F.col("faber"), F.lit(0))
        + F.coalesce((F.col("stage") == 2).cast("int"), F.lit(0))
        + F.coalesce(F.col("antonacci"), F.lit(0))
    ) / FILTER_COUNT
    z = z.withColumn("binary_filters", filters)
    z = z.withColumn("S_score", sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)))
    # One reading among five equal ones puts the others at exactly -0.5: noise must not veto them.
    z = z.withColumn("veto", F.coalesce(F.round("flow_z", 9) < VETO_BELOW, F.lit(False)))
    z = z.withColumn("S_score_after_veto", F.when(F.col("veto"), VETO_SCORE).otherwise(F.col("S_score")))
    if isinstance(top_n, dict):
        target = F.lit(0)
        for name, n in top_n.items():
            target = F.when(F.col("class") == name, n).otherwise(target)
    else:
        target = F.lit(int(top_n))
    # A class holds at most one row per instrument on a date: the rank's sort is
    # bounded by the universe, and dates spread over the cluster.
    order = Window.partitionBy(as_of, "class").orderBy(F.col("S_score_after_veto").desc_nulls_last())
    ranked = z.withColumn(
        "rank_in_class", F.when(F.col("S_score_after_veto").isNotNull(), F.rank().over(order))
    ).withColumn("top_n_target", target)
    return ranked.withColumn(
        "selected", F.coalesce(F.col("rank_in_class") <= F.col("top_n_target"), F.lit(False))
    )


PILLARS = {
    "MOM": "mom_12_1_z",
    "MANS": "mansfield_rs_z",
    "RS-R": "rs_ratio_z",
    "RS-M": "rs_momentum_z",
    "FILT": "binary_filters",
    "CYC": "cycle_tilt",
    "FLOW": "flow_z",
}


def contributions(scored: DataFrame) -> DataFrame:
    """Weighted terms of S in long form; a null term counts 0."""
    pairs = [
        F.struct(
            F.lit(name).alias("pillar"), F.coalesce(WEIGHTS[c] * F.col(c), F.lit(0.0)).alias("contribution")
        )
        for name, c in PILLARS.items()
    ]
    return scored.select("as_of", "ticker", "class", "S_score", F.explode(F.array(*pairs)).alias("p")).select(
        "as_of", "ticker", "class", "S_score", "p.pillar", "p.contribution"
    )


def display_contributions(scored: DataFrame) -> DataFrame:
    """Clamped raw pillars rescaled so that they add up to S."""

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))

    raw = {
        "mom_12_1": clamp(F.col("mom_12_1")),
        "mansfield_rs": clamp(F.col("mansfield_rs") / 100),
        "rs_ratio": clamp((F.col("rs_ratio") - 100) / 30),
        "rs_momentum": clamp((F.col("rs_momentum") - 100) / 30),
        "breadth_50d": clamp((F.col("breadth_50d") - 0.5) * 2),
        "cmf21": clamp(F.col("cmf21") / 0.25),
    }
    terms = {k: F.when(F.col(k).isNull(), 0.0).otherwise(v) for k, v in raw.items()}
    total = sum(terms.values(), F.lit(0.0))
    s = F.coalesce(F.col("S_score"), F.lit(0.0))
    pairs = [
        F.struct(
            F.lit(k).alias("pillar"),
            F.when(F.abs(F.col("_raw")) < 1e-6, s / len(raw)).otherwise(v * s / F.col("_raw")).alias("contribution"),
        )
        for k, v in terms.items()
    ]
    return (
        scored.withColumn("_raw", total)
        .select("as_of", "ticker", F.explode(F.array(*pairs)).alias("p"))
        .select("as_of", "ticker", "p.pillar", "p.contribution")
    )


def peer_set(snapshot: DataFrame, requested: list[str], bench: str, cash: str, label: str = "Ad Hoc") -> DataFrame:
    """Requested tickers with every other loaded one as peers, all in one class."""
    wanted = [t.strip().upper() for t in requested]
    symbol = F.upper(F.trim("ticker"))
    return snapshot.where(~F.col("ticker").isin(bench, cash)).withColumns(
        {"class": F.lit(label), "requested": symbol.isin(*wanted)}
    )


def ad_hoc_scores(snapshot: DataFrame, requested: list[str], bench: str, cash: str, phase: str = "MID") -> DataFrame:
    """Score requested tickers against all peers; never selected."""
    scored = composite(peer_set(snapshot, requested, bench, cash), phase=phase, top_n=0)
    return scored.where("requested").withColumns(
        {"selected": F.lit(False), "top_n_target": F.lit(0), "analysis_scope": F.lit("ad_hoc_peer_relative")}
    )


def parameters(top_n: dict[str, int]) -> dict:
    """Scoring parameters as plain data."""
    from .states import PULLBACK, STATES, THRESHOLDS

    return {
        "composite_weights": dict(WEIGHTS),
        "binary_filter_count": FILTER_COUNT,
        "flow_veto": {"threshold_z": VETO_BELOW, "replacement_score": VETO_SCORE},
        "rank_method": "min",
        "rank_ascending": False,
        "selection_top_n_by_class": dict(top_n),
        "state_order": list(STATES),
        "state_machine": THRESHOLDS,
        "pullback_risk_modifier": PULLBACK,
    }


def baseline_configuration(
    top_n: dict[str, int],
    bench: str,
    cash: str,
    phase: str = "MID",
    cost_bps: float = 5.0,
    periods_per_year: int = 252,
    horizons_weeks: tuple[int, ...] = (4, 13, 26, 52),
    years: tuple[int, int, int, int] = (10, 5, 1, 1),
) -> dict:
    """The frozen baseline of a calibration run but for its universe.

    ``years``: history asked for, calibration, validation, final holdout.
    """
    if cost_bps < 0 or not cost_bps < float("inf"):
        raise ValueError("costs must be a number from 0 on")
    if not horizons_weeks or min(*horizons_weeks, *years, periods_per_year) < 1:
        raise ValueError("horizons, years and periods must be positive")
    names = ("requested_years", "calibration_years", "validation_years", "final_holdout_years")
    # Section names, policies and label names.
    return {
        "accounting": {"transaction_cost_bps": float(cost_bps), "periods_per_year": periods_per_year},
        "benchmarks": [bench, cash],
        "methodology": {
            "phase": phase,
            "bench_ticker": bench,
            "bil_ticker": cash,
            "selection_policy": "equal_weight_selected_tickers",
            "target_normalization": "absolute_weight_sum_capped_at_1",
        },
        "provider_flags": {"historical_provider_flow": "neutral_stub"},
        "rebalance": {"cadence": "W-FRI"},
        "safety": {"research_only": True, "live_promotion_requires_separate_ticket": True, "no_live_scoring_changes": True},
        "scoring_parameters": parameters(top_n),
        "signal_labels": {
            "forward_horizons_weeks": sorted(set(horizons_weeks)),
            "positive_success": ["forward_absolute_return", "forward_excess_return_vs_class_benchmark", "post_entry_drawdown"],
            "negative_success": [
                "avoided_underperformance", "avoided_drawdown", "failed_positive_follow_through", "risk_off_or_reduce_exposure_success",
            ],
        },
        "state_machine": {"historical_policy": "recompute_state_per_rebalance_snapshot", "state_file_writes": "disabled"},
        "walk_forward": dict(zip(names, years)),
    }


def canonical_json(config: dict) -> str:
    """Compact JSON with sorted keys; numbers that JSON lacks are refused."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False)


def config_hash(universe: DataFrame, config: dict) -> DataFrame:
    """Size and digest of a universe and the hash of a configuration with it, one row.

    ``universe`` has ticker and class. Each distinct pair is hashed where it lives and the hashes are
    summed in three parts, so the digest doesn't depend on the order and no task holds the universe.
    """
    h = F.sha2(F.concat_ws("|", "ticker", F.coalesce("class", F.lit("Other"))), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    one = universe.select("ticker", "class").distinct().agg(F.count(F.lit(1)).alias("universe_count"), *[part(i).alias(f"_h{i}") for i in (1, 13, 25)])
    digest = F.sha2(F.concat_ws("|", F.col("universe_count").cast("string"), "_h1", "_h13", "_h25"), 256)
    one = one.select("universe_count", digest.alias("universe_sha256"))
    return one.withColumn("config_sha256", F.sha2(F.concat_ws("|", F.lit(canonical_json(config)), "universe_sha256"), 256))


