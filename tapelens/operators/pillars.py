"""Price indicators, for every instrument on every date in one plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_number, week_end
from ..functions.windows import full_mean, last_n, running, sample_std, series
from .resample import weekly_bars, weekly_spine

YEAR_ROWS = 252


def row_return(sessions: int, order: str = "date") -> Column:
    """Return over a number of sessions."""
    if sessions < 1:
        raise ValueError("sessions must be positive")
    return F.col("price") / F.lag("price", sessions).over(series(order)) - 1


def daily_pillars(bars: DataFrame) -> DataFrame:
    """Momentum, short returns and 50-day breadth on every date."""
    w = series()
    seen = F.row_number().over(w)
    out = bars.withColumn("_sma50", full_mean("price", 50)).withColumn("rn", seen)
    above = F.coalesce((F.col("price") > F.col("_sma50")).cast("int"), F.lit(0))
    return out.select(
        *bars.columns,
        "rn",
        (F.lag("price", 20).over(w) / F.lag("price", YEAR_ROWS - 1).over(w) - 1).alias("mom_12_1"),
        row_return(1).alias("return_1d"),
        row_return(2).alias("return_2d"),
        row_return(5).alias("return_5d"),
        F.when(F.col("rn") >= 100, F.avg(above).over(last_n(50))).alias("breadth_50d"),
    )


def with_faber(bars: DataFrame) -> DataFrame:
    """Price above its ten-month average, point in time on every date.

    The average holds the nine completed month closes and the price of the day, so
    a date inside a month never sees that month's later close. Bars carry no null
    close, so a month's close is the price of its last row.
    """
    w = series()
    df = bars.withColumn("_month", month_number("date"))
    closes = F.lead("_month").over(w) > F.col("_month")
    df = df.withColumn("_month_close", F.when(closes, F.col("price")))
    past = Window.partitionBy("ticker").orderBy("_month").rangeBetween(-9, -1)
    months = F.col("_month") - F.min("_month").over(Window.partitionBy("ticker")) + 1
    df = df.select(
        "*",
        months.alias("_months"),
        F.sum("_month_close").over(past).alias("_sum9"),
        F.count("_month_close").over(past).alias("_n9"),
    )
    above = (F.col("_n9") == 9) & (F.col("price") > (F.col("_sum9") + F.col("price")) / 10)
    return df.select(
        *bars.columns, F.when(F.col("_months") >= 11, F.coalesce(above.cast("int"), F.lit(0))).alias("faber")
    )


def year_return() -> Column:
    return F.col("price") / F.lag("price", YEAR_ROWS - 1).over(series()) - 1


def antonacci_signal(bars: DataFrame, cash: str) -> DataFrame:
    """Twelve-month return above that of cash, each on its own calendar (I8).

    Cash is one instrument, so its side holds at most one row per trading day. It
    is carried to every date on the calendar before the equi-join on date.
    """
    own = bars.select("ticker", "date", year_return().alias("_own"))
    one = bars.where(F.col("ticker") == cash).select("date", "price", F.lit(cash).alias("ticker"))
    one = one.select(
        F.col("date").alias("from_date"),
        F.date_sub(F.lead("date").over(series()), 1).alias("_until"),
        year_return().alias("_cash"),
    )
    horizon = bars.agg(F.max("date")).scalar()
    one = one.where("_cash is not null").select(
        F.explode(F.sequence("from_date", F.coalesce("_until", horizon))).alias("date"), "_cash"
    )
    flag = (F.col("_own") > F.col("_cash")).cast("int")
    return own.join(one, "date", "left").select("ticker", "date", flag.alias("antonacci"))


def with_benchmark(weekly: DataFrame, bench: str) -> DataFrame:
    """Benchmark's weekly price carried on each asset's weekly spine.

    The benchmark is read inside the week's cross-section instead of by a second
    scan of the bars: a week holds one row per instrument.
    """
    spine = weekly_spine(weekly).withColumn("weeks", F.row_number().over(series("week_end")))
    week = Window.partitionBy("week_end")
    is_bench = F.col("ticker") == bench
    seen = spine.select(
        "*",
        F.max(F.when(is_bench, F.col("price"))).over(week).alias("_pb"),
        F.max(F.when(is_bench, F.col("weeks"))).over(week).alias("_nb"),
    )
    run = running("week_end")
    return seen.select(
        *spine.columns,
        F.last("_pb", ignorenulls=True).over(run).alias("bench_price"),
        F.coalesce(F.max("_nb").over(run), F.lit(0)).alias("bench_weeks"),
    )


def weekly_relative(bars: DataFrame, bench: str) -> DataFrame:
    return with_benchmark(weekly_bars(bars), bench)


def stage_analysis(rel: DataFrame) -> DataFrame:
    """30-week average, its slope, Mansfield strength and the stage 1-4."""
    w = series("week_end")
    df = rel.withColumn("sma30w", full_mean("price", 30, order="week_end")).withColumn(
        "_ratio", F.col("price") / F.col("bench_price")
    )
    df = df.withColumn("_slope", (F.col("sma30w") - F.lag("sma30w", 5).over(w)) / 5).withColumn(
        "_rs", (F.col("_ratio") / F.lag("_ratio", 52).over(w) - 1) * 100
    )
    known = (F.col("weeks") >= 53) & (F.col("bench_weeks") >= 53) & F.col("sma30w").isNotNull() & (
        F.lag("_ratio", 52).over(w).isNotNull()
    )
    up = F.coalesce(F.col("_slope") > 0, F.lit(False))
    flat = F.coalesce(F.col("_slope") <= 0, F.lit(False))
    down = F.coalesce(F.col("_slope") < 0, F.lit(False))
    above = F.col("price") > F.col("sma30w")
    stage = (
        F.when(above & up & (F.col("_rs") > 0), 2)
        .when(above & (flat | (F.col("_rs") <= 0)), 3)
        .when(~above & down & (F.col("_rs") < 0), 4)
        .otherwise(1)
    )
    return df.withColumn("_known", known & F.col("traded")).select(
        *rel.columns,
        F.when(F.col("_known"), F.col("sma30w")).alias("sma30w"),
        F.when(F.col("_known"), above).alias("above_30wma"),
        F.when(F.col("_known"), up).alias("ma_slope_pos"),
        F.when(F.col("_known"), F.col("_rs")).alias("mansfield_rs"),
        F.when(F.col("_known"), stage).alias("stage"),
    )


def quadrant(ratio: Column, momentum: Column) -> Column:
    """Rotation quadrant, 100 counts as strong."""
    return (
        F.when(ratio.isNull() | momentum.isNull(), None)
        .when((ratio >= 100) & (momentum >= 100), "Leading")
        .when(ratio >= 100, "Weakening")
        .when(momentum < 100, "Lagging")
        .otherwise("Improving")
    )


def rotation(rel: DataFrame) -> DataFrame:
    """Relative-rotation ratio and momentum (I9-I11): a window over a window."""
    by = {"order": "week_end"}
    df = rel.withColumn("_rs100", 100 * (F.col("price") / F.col("bench_price")))
    df = df.withColumn(
        "_ratio",
        100 + (F.col("_rs100") - full_mean("_rs100", 63, **by)) / sample_std("_rs100", 252, 60, **by) * 10,
    )
    df = df.withColumn(
        "_momentum", 100 + (F.col("_ratio") - full_mean("_ratio", 5, **by)) / sample_std("_ratio", 21, **by) * 10
    )
    known = (F.col("weeks") >= 60) & (F.col("bench_weeks") >= 60) & F.col("_momentum").isNotNull() & F.col("traded")
    ratio, momentum = F.when(known, F.col("_ratio")), F.when(known, F.col("_momentum"))
    return df.select(
        *rel.columns,
        ratio.alias("rs_ratio"),
        momentum.alias("rs_momentum"),
        quadrant(ratio, momentum).alias("rrg_quadrant"),
    )


def eligible(df: DataFrame, cash: str) -> DataFrame:
    """Scored instruments: not cash, not an index (F1)."""
    return df.where((F.col("ticker") != cash) & ~F.col("ticker").startswith("^"))


def week_close_rows(daily: DataFrame) -> DataFrame:
    """Each instrument's last row of every traded week, keyed by the week."""
    keyed = daily.withColumn("week_end", week_end("date"))
    follow = F.lead("week_end").over(series())
    return keyed.withColumn("_next", follow).where("_next is null or _next > week_end").drop("_next")


def week_close_indicators(daily: DataFrame, bench: str) -> DataFrame:
    """Weekly stage and rotation beside the daily readings of the week's last bar.

    ``daily`` is the bars with their daily readings. The week's last row already
    holds the weekly close, so the weekly windows continue on those rows.
    """
    return rotation(stage_analysis(with_benchmark(week_close_rows(daily), bench))).where("traded").drop("traded")


def relative_strength_lines(bars: DataFrame, bench: str, lookback: int = 252) -> DataFrame:
    """Price over benchmark on shared days, rebased to 100, last ``lookback`` days."""
    b = bars.where((F.col("ticker") == bench) & F.col("price").isNotNull()).select(
        "date", F.col("price").alias("_pb")
    )
    shared = bars.where((F.col("ticker") != bench) & F.col("price").isNotNull()).join(b, "date")
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    tail = shared.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= max(2, lookback))
    tail = tail.withColumn("_ratio", F.col("price") / F.nullif(F.col("_pb"), F.lit(0.0))).where("_ratio is not null")
    whole = Window.partitionBy("ticker").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    lines = tail.select(
        "ticker",
        "date",
        (F.col("_ratio") / F.first("_ratio").over(whole) * 100).alias("line"),
        F.count("*").over(whole).alias("_n"),
    ).where("_n >= 2")
    latest = lines.groupBy("ticker").agg(F.max_by("line", "date").alias("latest"))
    return lines.drop("_n").join(latest, "ticker")


def weekly_chart(bars: DataFrame, points: int, ma: int = 30) -> DataFrame:
    """Weekly close and its moving average from the first bar on."""
    weekly = weekly_bars(bars).where("close is not null")
    newest = Window.partitionBy("ticker").orderBy(F.desc("week_end"))
    return (
        weekly.withColumn("ma30w", F.avg("price").over(last_n(ma, order="week_end")))
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= points)
        .select(
            "ticker", "week_end", F.col("price").alias("close"), "ma30w", (F.col("price") >= F.col("ma30w")).alias("above_ma")
        )
    )


def chart_relative_strength(bars: DataFrame, bench: str) -> DataFrame:
    """Weekly relative strength rebased at the first shared week (I16)."""
    weekly = weekly_bars(bars).where("close is not null and price > 0").select("ticker", "week_end", "price")
    b = weekly.where(F.col("ticker") == bench).select("week_end", F.col("price").alias("_pb"))
    shared = weekly.where(F.col("ticker") != bench).join(b, "week_end")
    w = series("week_end")
    newest = Window.partitionBy("ticker").orderBy(F.desc("week_end"))
    ratio = F.col("price") / F.col("_pb")
    df = shared.select(
        "ticker",
        "week_end",
        (ratio / F.first(ratio).over(running("week_end")) * 100).alias("rs_ratio"),
        (F.col("price") / F.lag("price", 12).over(w) - 1).alias("momentum_12w"),
        (F.col("price") / F.lag("price", 52).over(w) - 1).alias("momentum_52w"),
        F.row_number().over(newest).alias("_back"),
    )
    span = last_n(12, order="week_end")
    slope = F.last("rs_ratio").over(span) - F.first("rs_ratio").over(span)
    return df.withColumn("slope_12", slope).drop("_back")
