"""Freshness and coverage rows per data lane."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Age limits in days, of the compute lane in minutes.
BAR_FRESH, BAR_STALE, SERIES_FRESH = 5, 10, 7
COMPUTE_FRESH = 60
RANK = {"healthy": 0, "info": 0, "warning": 1, "stale": 2}
LABELS = {"healthy": "Data healthy", "info": "Data healthy", "warning": "Data warning", "stale": "Data stale"}


def age_days(c, today) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.lit(today), c))


def age_label(c, today) -> Column:
    age = age_days(c, today)
    return F.when(age.isNull(), "missing").when(age == 0, "today").otherwise(F.concat(age.cast("string"), F.lit("d old")))


def bar_health(bars: DataFrame, expected: DataFrame, today) -> DataFrame:
    """Market lane: oldest and newest last bars of the expected symbols, and their sources.

    The source mix counts symbols by the provider of their last bar (the least name, where several
    sent it), where bars have providers. Counts meet per provider before they meet in one row.
    """
    provider = F.min_by("provider", F.struct(F.datediff(F.lit(today), "date"), "provider")) if "provider" in bars.columns else F.lit(None).cast("string")
    last = bars.groupBy("ticker").agg(F.max("date").alias("last"), provider.alias("provider"))
    mix = expected.join(last, "ticker", "left").groupBy("provider").agg(
        F.max("last").alias("last"), F.min("last").alias("first"), F.count("last").alias("loaded"), F.count("*").alias("expected")
    )
    named = F.collect_list(F.when(F.col("provider").isNotNull(), F.format_string("%s %d", "provider", "loaded")))
    a = mix.agg(
        F.max("last").alias("latest"), F.min("first").alias("oldest"), F.sum("loaded").alias("loaded"), F.sum("expected").alias("expected"),
        F.array_join(F.array_sort(named), ", ").alias("mix"),
    )
    old = age_days("oldest", today)
    missing = F.col("expected") > F.col("loaded")
    status = (
        F.when(F.col("oldest").isNull() | (old > BAR_STALE) | missing, "stale").when(old > BAR_FRESH, "warning").otherwise("healthy")
    )
    return a.select(F.lit("market_ohlcv").alias("lane"), status.alias("status"), "latest", age_label("latest", today).alias("freshness"), "loaded", "expected",
                    F.when(F.col("mix") != "", F.concat(F.lit("source mix "), F.col("mix"))).alias("detail"))


def series_health(macro: DataFrame, limits: DataFrame, today) -> DataFrame:
    """Macro lane against each series' own age limit (D22). ``limits``: series_id, fresh_days."""
    last = macro.where("value is not null").groupBy("series_id").agg(F.max("date").alias("last"))
    j = limits.join(last, "series_id", "left")
    old = age_days("last", today) > F.coalesce("fresh_days", F.lit(SERIES_FRESH))
    a = j.agg(
        F.max("last").alias("latest"), F.count("last").alias("loaded"), F.count("*").alias("expected"), F.count_if(F.coalesce(old, F.lit(False))).alias("_stale")
    )
    status = F.when(F.col("loaded") == 0, "stale").when((F.col("_stale") > 0) | (F.col("loaded") < F.col("expected")), "warning").otherwise("healthy")
    return a.select(F.lit("macro").alias("lane"), status.alias("status"), "latest", age_label("latest", today).alias("freshness"), "loaded", "expected",
                    F.format_string("%d of %d series past their age limit", "_stale", "loaded").alias("detail"))


def provider_lane(readiness: DataFrame) -> DataFrame:
    """Worst provider status as one lane."""
    rank = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in RANK.items()], F.lit(1))
    a = readiness.agg(F.max_by("status", F.struct(rank, "lane")).alias("status"), F.count_if(F.col("status") == "healthy").alias("loaded"), F.count("*").alias("expected"))
    return a.select(F.lit("provider_flow").alias("lane"), "status", F.lit(None).cast("date").alias("latest"), F.lit("derived from market lane").alias("freshness"), "loaded", "expected", F.lit(None).cast("string").alias("detail"))


def compute_health(created: DataFrame, now) -> DataFrame:
    """Compute lane: age of the rendered analysis (D22). ``created``: one row, created_at, null if none was kept."""
    at = F.col("created_at").cast("timestamp_ntz")
    minutes = F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", at, F.lit(now).cast("timestamp_ntz")) / 60)))
    return created.select(
        F.lit("dashboard_compute").alias("lane"),
        F.when(minutes <= COMPUTE_FRESH, "healthy").otherwise("warning").alias("status"),
        at.cast("date").alias("latest"),
        F.coalesce(F.concat(minutes.cast("string"), F.lit("m old")), F.lit("missing")).alias("freshness"),
        F.when(at.isNotNull(), 1).otherwise(0).cast("long").alias("loaded"),
        F.lit(1).cast("long").alias("expected"),
        F.when(at.isNull(), "no time of a run was kept").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm")).alias("detail"),
    )


def health_rows(*lanes: DataFrame) -> DataFrame:
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out


def with_summary(rows: DataFrame) -> DataFrame:
    """The worst status over all lanes on every row (D23). One row per lane."""
    rank = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in RANK.items()], F.lit(1))
    worst = F.max(rank).over(Window.partitionBy(F.lit(1)))
    label = F.when(worst == 0, LABELS["healthy"]).when(worst == 1, LABELS["warning"]).otherwise(LABELS["stale"])
    return rows.withColumn("summary", label)
