"""Volume and money-flow indicators on raw close (P1), on every date."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import last_n, running, series


def _multiplier():
    """Position of the close in the day's range, -1 to 1; null on a flat day."""
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread


def flow_indicators(bars: DataFrame) -> DataFrame:
    """V1-V9 for every bar. All frames share the (ticker, date) order: one shuffle, one sort."""
    w = series()
    prior_close = F.lag("close").over(w)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    base = bars.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.coalesce(_multiplier() * F.col("volume"), F.lit(0.0)).alias("_mfv"),
        F.coalesce(_multiplier() * F.col("volume") * F.col("close"), F.lit(0.0)).alias("_mfd"),
        typical.alias("_typ"),
        F.lag(typical).over(w).alias("_typ1"),
        prior_close.alias("_close1"),
    )
    direction = F.coalesce(F.signum(F.col("close") - F.col("_close1")), F.lit(0.0))
    raw = F.col("_typ") * F.col("volume")
    base = base.select(
        "*",
        F.sum(direction * F.col("volume")).over(running()).alias("obv"),
        F.when(F.col("_typ") > F.col("_typ1"), raw).otherwise(0.0).alias("_pos"),
        F.when(F.col("_typ") < F.col("_typ1"), raw).otherwise(0.0).alias("_neg"),
        F.when(F.count("volume").over(last_n(20)) == 20, F.avg("volume").over(last_n(20))).alias("_vavg"),
    )
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    heavy = (
        ((F.col("close") - F.col("low")) / spread < 0.25)
        & (F.col("volume") >= 1.5 * F.col("_vavg"))
        & (F.col("close") < F.col("_close1"))
    )
    base = base.withColumn("_dist", F.coalesce(heavy.cast("int"), F.lit(0)))
    rn = F.col("_rn")
    n20, n21, n14 = last_n(20), last_n(21), last_n(14)
    before = series().rowsBetween(-20, -1)
    full = lambda frame, n: F.count("volume").over(frame) == n  # noqa: E731  a null volume leaves no value
    mfr = F.sum("_pos").over(n14) / F.nullif(F.sum("_neg").over(n14), F.lit(0.0))
    norm = F.avg(F.abs("obv")).over(n20)
    moves = F.max("obv").over(n20) > F.min("obv").over(n20)
    slope = F.regr_slope(F.col("obv"), rn.cast("double")).over(n20)
    new_high = F.col("close") >= F.max("close").over(n20)
    obv_high = F.col("obv") >= F.max("obv").over(n20)
    return base.select(
        *bars.columns,
        F.when((rn >= 22) & full(n21, 21), F.sum("_mfv").over(n21) / F.nullif(F.sum("volume").over(n21), F.lit(0.0))).alias("cmf21"),
        F.when(rn >= 21, F.sum("_mfd").over(n21)).alias("net_flow_21d"),
        F.col("obv"),
        F.when((rn >= 25) & moves, slope / F.when(norm == 0, 1.0).otherwise(norm)).alias("obv_slope"),
        F.when((rn >= 16) & full(n14, 14), 100 - 100 / (1 + mfr)).alias("mfi14"),
        F.when(rn >= 21, F.col("volume") / F.nullif(F.avg("volume").over(before), F.lit(0.0))).alias("rvol"),
        F.when(rn >= 20, F.avg(F.col("close") * F.col("volume")).over(n20)).alias("adv_20d"),
        F.when(rn >= 46, F.sum("_dist").over(series().rowsBetween(-23, 0))).cast("int").alias("dist_days_25"),
        F.when(rn >= 21, new_high & ~obv_high).alias("obv_divergence"),
    )


def chart_flow(bars: DataFrame) -> DataFrame:
    """Chart variants with partial windows and the end-point OBV slope."""
    w = series()
    volume = F.coalesce(F.col("volume"), F.lit(0.0))
    direction = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0))
    df = bars.select(
        "ticker",
        "date",
        (F.coalesce(_multiplier(), F.lit(0.0)) * volume).alias("_mfv"),
        volume.alias("_vol"),
        (direction * volume).alias("_signed"),
    )
    df = df.withColumn("obv", F.sum("_signed").over(running()))
    n21, n20 = last_n(21), last_n(20)
    norm = F.avg(F.abs("obv")).over(n20)
    delta = F.col("obv") - F.first("obv").over(n20)
    return df.select(
        "ticker",
        "date",
        (F.sum("_mfv").over(n21) / F.nullif(F.sum("_vol").over(n21), F.lit(0.0))).alias("cmf21"),
        "obv",
        F.when(
            F.count("obv").over(n20) >= 2, delta / F.when(norm == 0, 1.0).otherwise(norm)
        ).alias("obv_slope"),
    )


def lookback(bars: DataFrame, range_key: str = "1Y") -> DataFrame:
    """Rows within 3M/6M/1Y/3Y of each instrument's own last bar; MAX keeps all."""
    months = {"3M": 3, "6M": 6, "1Y": 12, "3Y": 36, "MAX": None}.get(range_key.upper(), 12)
    if months is None:
        return bars
    last = F.max("date").over(Window.partitionBy("ticker"))
    return bars.withColumn("_last", last).where(F.col("date") >= F.add_months("_last", -months)).drop("_last")


def visible_since(df: DataFrame, since, column: str = "date") -> DataFrame:
    """Clip after the indicator exists, so its window still sees earlier rows."""
    return df if since is None else df.where(F.col(column) >= F.lit(since))
