"""Macro series: statistics, phase, context rows, conditions.

Macro tables are monthly or daily observations of a fixed list of series, so a
window per series is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.columns import signed

FLAT = 0.0001


def clean_series(raw: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Last non-null value per (series, date)."""
    return raw.where("value is not null").groupBy("series_id", "date").agg(F.max_by("value", order).alias("value"))


def series_stats(macro: DataFrame) -> DataFrame:
    """Per observation: delta, year change by 12 observations, momentum (M1-M3, M8)."""
    w = Window.partitionBy("series_id").orderBy("date")
    prev12 = F.lag("value", 12).over(w)
    momentum = F.avg("value").over(w.rowsBetween(-2, 0)) - F.avg("value").over(w.rowsBetween(-11, -3))
    seen = F.row_number().over(w)
    return macro.select(
        "series_id",
        "date",
        "value",
        (F.col("value") - F.lag("value").over(w)).alias("delta"),
        (F.col("value") / prev12 - 1).alias("yoy"),
        F.when(F.abs(prev12) > 1e-9, (F.col("value") / prev12 - 1) * 100).alias("yoy_pct"),
        F.when(seen >= 13, momentum).alias("momentum"),
        F.when(seen >= 5, F.col("value") > F.lag("value", 3).over(w)).alias("rising"),
    )


def latest_stats(macro: DataFrame) -> DataFrame:
    """Newest observation of each series with its statistics (M1)."""
    s = series_stats(macro)
    rest = F.struct("date", "value", "delta", "yoy", "yoy_pct", "momentum")
    return s.groupBy("series_id").agg(F.max_by(rest, "date").alias("_r")).select("series_id", "_r.*")


def wide_readings(macro: DataFrame) -> DataFrame:
    """One row per date with the classifier's inputs as last known on that date.

    Conditional aggregation gives one row per observation date, bounded by the
    calendar; slower series are carried forward over those rows.
    """
    s = series_stats(macro)

    def pick(series: str, c: str) -> Column:
        return F.max(F.when(F.col("series_id") == series, F.col(c)))

    wide = s.groupBy("date").agg(
        pick("INDPRO", "yoy").alias("indpro_yoy"),
        pick("INDPRO", "momentum").alias("indpro_accel"),
        pick("T10Y2Y", "value").alias("curve_2s10s"),
        pick("T10Y3M", "value").alias("curve_3m10y"),
        pick("RECPROUSM156N", "value").alias("recession_prob"),
        pick("NFCI", "value").alias("nfci"),
    )
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("date", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in wide.columns if c != "date"])


def classify_phase() -> Column:
    """Four-phase business cycle as one CASE (M6). The thresholds."""
    yoy, accel = F.col("indpro_yoy"), F.col("indpro_accel")

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    recession = known(F.col("recession_prob") > 25) | known(yoy < -0.02) | known(F.col("nfci") > 0.5)
    late = (
        known(F.col("curve_2s10s") < 0)
        | known(F.col("curve_3m10y") < 0)
        | known((accel < 0) & (F.coalesce(yoy, F.lit(0.0)) > 0))
    )
    early = known(yoy > 0.03) & known(accel > 0) & (F.col("recession_prob").isNull() | (F.col("recession_prob") < 5))
    return (
        F.when(recession, "RECESSION").when(late, "LATE").when(early, "EARLY").when(known(yoy > 0), "MID").otherwise("UNKNOWN")
    )


def assess_regime(readings: DataFrame) -> DataFrame:
    """Phase with the price fallback, from readings that carry ``risk_on`` (M4, M5, M7).

    Without industrial production the coarse two-signal proxy decides.
    """
    df = readings.withColumn("risk_on", F.coalesce(F.col("risk_on"), F.lit(False)))
    df = df.withColumn("phase", classify_phase())
    has_macro = F.col("indpro_yoy").isNotNull() | F.col("indpro_accel").isNotNull()
    positive = F.col("curve_2s10s") > 0
    coarse = (
        F.when(~F.col("risk_on"), "RECESSION").when(F.coalesce(~positive, F.lit(False)), "LATE").otherwise("MID")
    )
    hint = F.when(
        has_macro,
        F.when(F.col("phase") != "UNKNOWN", F.col("phase")).otherwise(
            F.when(F.col("risk_on"), "MID").otherwise("RECESSION")
        ),
    ).otherwise(coarse)
    return df.withColumn("yield_curve_positive", positive).withColumn("phase_hint", hint)


def yield_curve_sign(long_rate: DataFrame, short_rate: DataFrame) -> DataFrame:
    """Latest long yield above the latest short one, one row (M5)."""
    a = long_rate.agg(F.max_by("price", "date").alias("_a"), F.lit(1).alias("_k"))
    b = short_rate.agg(F.max_by("price", "date").alias("_b"), F.lit(1).alias("_k"))
    return a.join(b, "_k").select((F.col("_a") > F.col("_b")).alias("curve_positive"))


def _tone(delta: Column, higher_up: Column) -> Column:
    return (
        F.when(delta.isNull(), "warn")
        .when(F.abs(delta) <= FLAT, "flat")
        .when(delta > 0, F.when(higher_up, "up").otherwise("warn"))
        .otherwise(F.when(higher_up, "down").otherwise("up"))
    )


def decorate(df: DataFrame, delta: Column, higher_up: Column, scale: Column, tone: Column | None = None) -> DataFrame:
    """Tone, sentiment, trend and gauge of a change (M9)."""
    tone = _tone(delta, higher_up) if tone is None else tone
    sentiment = (
        F.when(tone == "up", "positive").when(tone.isin("warn", "down"), "negative").when(tone == "flat", "neutral")
    )
    trend = (
        F.when(delta.isNull(), "data pending")
        .when(F.abs(delta) <= FLAT, "flat")
        .when((delta > 0) == higher_up, "improving")
        .otherwise("worsening")
    )
    gauge = F.when(delta.isNull() | (F.abs(delta) <= FLAT), 50.0).otherwise(
        F.rint(F.least(F.lit(100.0), 50 + F.abs(delta) * scale))
    )
    symbol = F.when(sentiment == "positive", "+").when(sentiment == "negative", "!").otherwise("=")
    return df.select(
        "*",
        tone.alias("tone"),
        sentiment.alias("sentiment_label"),
        trend.alias("trend_label"),
        symbol.alias("trend_symbol"),
        gauge.cast("int").alias("gauge_pct"),
    )


def context_rows(macro: DataFrame, dimension: DataFrame) -> DataFrame:
    """Context rows per configured series (M9).

    ``dimension``: series_id, group, label, unit, higher_up, by_year. It is the
    fixed list of configured series.
    """
    rows = dimension.join(latest_stats(macro), "series_id", "left")
    by_year = F.col("by_year") & F.col("yoy_pct").isNotNull()
    delta = F.when(by_year, F.col("yoy_pct")).otherwise(F.col("delta"))
    scale = F.when(by_year, 10.0).when(F.col("unit") == "percent", 50.0).otherwise(1.0)
    missing = F.col("value").isNull()
    tone = F.when(missing, "warn").when(delta.isNull(), "flat").otherwise(_tone(delta, F.col("higher_up")))
    unit, v = F.col("unit"), F.col("value")
    value_text = (
        F.when(missing, "DATA PENDING")
        .when(unit == "percent", F.format_string("%.2f%%", v))
        .when(unit == "millions_usd", F.format_string("%.2fT", v / 1e6))
        .when(unit == "billions_usd", F.format_string("%.2fT", v / 1e3))
        .when(F.abs(v) >= 100000, F.format_string("%.0fK", v / 1000))
        .otherwise(F.format_string("%.2f", v))
    )
    change = (
        F.when(delta.isNull(), "-")
        .when(by_year, F.concat(signed("yoy_pct", 1), F.lit("% YoY")))
        .otherwise(F.concat(signed("delta"), F.when(unit == "percent", " pp").otherwise("")))
    )
    out = decorate(rows, delta, F.col("higher_up"), scale, tone)
    return out.withColumn("value_text", value_text).withColumn("change", change)


def snapshot_map(macro: DataFrame, dimension: DataFrame) -> DataFrame:
    """One map from series to its latest statistics, for run metadata.

    The map has one entry per configured series.
    """
    entry = F.struct("label", "group", F.col("date").alias("latest_date"), F.col("value").alias("latest_value"), "delta", "yoy_pct")
    rows = dimension.join(latest_stats(macro), "series_id")
    return rows.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("series_id"), entry)))).alias("macro_snapshot")
    )


def market_proxies(bars: DataFrame) -> DataFrame:
    """Last price and one-session change of each proxy instrument."""
    w = Window.partitionBy("ticker").orderBy("date")
    moved = bars.withColumn("_prev", F.lag("price").over(w))
    last = moved.groupBy("ticker").agg(F.max_by(F.struct("price", "_prev"), "date").alias("_r"))
    pct = F.when(F.abs(F.col("_r._prev")) > 1e-9, (F.col("_r.price") / F.col("_r._prev") - 1) * 100)
    rows = last.select("ticker", F.col("_r.price").alias("price"), pct.alias("change_pct"))
    return decorate(rows, F.col("change_pct"), F.lit(True), F.lit(4.0))


def session_range(bars: DataFrame) -> DataFrame:
    """Where the last close sits in its session's range."""
    last = bars.groupBy("ticker").agg(F.max_by(F.struct("high", "low", "price"), "date").alias("_r")).select("ticker", "_r.*")
    span = F.col("high") - F.col("low")
    flat = span <= 1e-9 * F.greatest(F.abs("high"), F.abs("low"))
    position = F.when(flat, 0.5).otherwise((F.col("price") - F.col("low")) / span)
    df = last.where("high >= low").withColumn("position", position)
    up, down = F.col("position") >= 0.75, F.col("position") <= 0.25
    return df.select(
        "ticker",
        "position",
        F.when(up, "up").when(down, "down").otherwise("flat").alias("tone"),
        F.when(flat, "flat range").when(up, "close near high").when(down, "close near low").otherwise("close mid range").alias("subtitle"),
        F.when(up, "buying pressure").when(down, "selling pressure").otherwise("balanced").alias("trend_label"),
        F.rint(F.col("position") * 100).cast("int").alias("gauge_pct"),
    )


RULE_FIELDS = ("rule", "series_id", "condition", "threshold", "lookback", "lag_days", "multiplier")


def rule_array(rules: list[dict]) -> Column:
    """A configured rule list as an array literal, so rows fan out by rule without a join."""
    types = {"threshold": "double", "lookback": "int", "lag_days": "int", "multiplier": "double"}
    return F.array(
        *[
            F.struct(*[F.lit(r[f]).cast(types.get(f, "string")).alias(f) for f in RULE_FIELDS])
            for r in rules
        ]
    )


def condition_values(macro: DataFrame, rules: list[dict]) -> DataFrame:
    """Rule conditions on each observation, dated by availability."""
    w = Window.partitionBy("series_id").orderBy("date")
    lags = sorted({int(r["lookback"]) for r in rules})
    if any(k <= 0 for k in lags):
        raise ValueError("lookback must be positive")
    df = macro.select("series_id", "date", "value", *[(F.col("value") - F.lag("value", k).over(w)).alias(f"_d{k}") for k in lags])
    df = df.withColumn("r", F.explode(rule_array(rules))).where("r.series_id = series_id")
    delta = F.coalesce(*[F.when(F.col("r.lookback") == k, F.col(f"_d{k}")) for k in lags])
    cond, t, v = F.col("r.condition"), F.col("r.threshold"), F.col("value")
    met = (
        F.when(cond == "rising", delta > t)
        .when(cond == "falling", delta < -t)
        .when(cond == "flat", F.abs(delta) <= t)
        .when(cond == "above", v > t)
        .when(cond == "below", v < t)
        .when(cond == "positive", v > 0)
        .when(cond == "negative", v < 0)
    )
    return df.select(
        F.col("r.rule").alias("rule"),
        F.date_add("date", F.col("r.lag_days")).alias("date"),
        F.coalesce(met, F.lit(False)).alias("met"),
    )


def condition_mask(macro: DataFrame, dates: DataFrame, rules: list[dict]) -> DataFrame:
    """Latest available condition at each rebalance date, false before the first."""
    asked = dates.select("as_of", F.explode(F.array(*[F.lit(r["rule"]) for r in rules])).alias("rule"))
    hit = asof_backward(
        asked.withColumnRenamed("as_of", "date"), condition_values(macro, rules), ["rule"], "date", ["met"]
    )
    return hit.select(F.col("date").alias("as_of"), "rule", F.coalesce("met", F.lit(False)).alias("active"))


def condition_label(delta: Column, yoy_pct: Column) -> Column:
    """Label of a stored reading."""
    return (
        F.when(delta.isNotNull(), F.when(F.abs(delta) <= FLAT, "flat").when(delta > 0, "rising").otherwise("falling"))
        .when(
            yoy_pct.isNotNull(),
            F.when(F.abs(yoy_pct) <= FLAT, "yoy_flat").when(yoy_pct > 0, "yoy_positive").otherwise("yoy_negative"),
        )
        .otherwise("level_available")
    )
