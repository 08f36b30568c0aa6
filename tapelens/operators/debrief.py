"""What happened after each journalled decision."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_forward
from ..functions.windows import forward_drawdowns

# Horizons in sessions and the reading of each action.
WINDOWS = {"1w": 5, "4w": 20, "13w": 65, "26w": 130}
POSITIVE = ("BUY", "ADD", "HOLD")
DEFENSIVE = ("EXIT", "WATCH", "SELL", "TRIM")


def hit(action: Column, ret: Column) -> Column:
    """Was the call right."""
    return F.when(action.isin(*POSITIVE), ret > 0).when(action.isin(*DEFENSIVE), ret <= 0)


def forward_paths(prices: DataFrame, windows: dict[str, int] = WINDOWS, starts: DataFrame | None = None) -> DataFrame:
    """Outcome of each horizon from every bar (J10, D1): one row per bar and horizon.

    It depends on the bar and not on the decision, so it is computed once per bar and any
    number of decisions join it. End prices and drawdowns are read ahead in one ordered
    window; only bars that open a path (``starts``: ticker, start_date) fan out by horizon.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    df = forward_drawdowns(prices.where("price is not null").select("ticker", "date", "price"), "price", [n + 1 for n in windows.values()], w)
    ends = {f"_end_{n}": F.lead(F.struct("date", "price"), n).over(w) for n in windows.values()}
    df = df.withColumns(ends)
    if starts is not None:
        df = df.join(starts.select("ticker", F.col("start_date").alias("date")).distinct(), ["ticker", "date"], "left_semi")
    spec = F.array(
        *[
            F.struct(F.lit(k).alias("horizon"), F.lit(n).alias("days"), F.col(f"_end_{n}").alias("end"), F.col(f"_fall_{n + 1}").alias("fall"))
            for k, n in windows.items()
        ]
    )
    df = df.select("ticker", "date", "price", F.explode(spec).alias("h"))
    last = F.col("h.end")
    ready = last.isNotNull() & (F.col("price") > 0)
    return df.select(
        "ticker",
        F.col("date").alias("start_date"),
        F.col("price").alias("start_price"),
        F.col("h.horizon").alias("horizon"),
        F.col("h.days").alias("days"),
        F.when(ready, last["date"]).alias("end_date"),
        F.when(ready, last["price"]).alias("end_price"),
        F.when(ready, last["price"] / F.col("price") - 1).alias("forward_return"),
        F.when(ready, F.col("h.fall")).alias("max_drawdown"),
        F.when(F.col("price") <= 0, "invalid_baseline").when(~ready, "insufficient_history").otherwise("available").alias("path_status"),
    )


def outcomes(decisions: DataFrame, prices: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Decisions with their forward outcomes.

    Decisions meet bars on (ticker, start date): a ticker with a third of all
    decisions still spreads over its dates.
    """
    d = decisions.withColumn("ticker", F.upper("ticker")).withColumn("action", F.upper("action")).withColumn("run_date", F.to_date("started_at"))
    p = prices.where("price is not null").withColumn("ticker", F.upper("ticker"))
    asked = d.select("ticker", "run_date").distinct().withColumnRenamed("run_date", "date")
    starts = asof_forward(asked, p.select("ticker", "date", F.col("date").alias("start_date")), ["ticker"], "date", ["start_date"])
    listed = p.select("ticker").distinct().withColumn("_listed", F.lit(True))
    starts = starts.join(listed, "ticker", "left").withColumnRenamed("date", "run_date")
    spec = F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(n).alias("days")) for k, n in windows.items()])
    starts = starts.withColumn("h", F.explode(spec)).select(
        "ticker", "run_date", "start_date", "_listed", F.col("h.horizon").alias("horizon"), F.col("h.days").alias("days")
    )
    paths = forward_paths(p, windows, starts).drop("days")
    per = starts.join(paths, ["ticker", "start_date", "horizon"], "left")
    df = d.join(per, ["ticker", "run_date"])
    known = F.col("action").isin(*POSITIVE, *DEFENSIVE)
    status = (
        F.when(F.col("_listed").isNull(), "missing_ticker")
        .when(F.col("start_date").isNull(), "no_baseline")
        .when((F.col("path_status") == "available") & ~known, "unsupported_action")
        .otherwise(F.col("path_status"))
    )
    return df.withColumn("status", status).withColumn("hit", hit(F.col("action"), F.col("forward_return"))).drop("_listed", "path_status")


def summary(out: DataFrame) -> DataFrame:
    """Hit rate and mean return by action and horizon."""
    ok = F.col("forward_return").isNotNull() & F.col("hit").isNotNull()
    n = F.count_if(ok)
    return out.groupBy("action", "horizon").agg(
        F.count("*").alias("decision_count"),
        n.alias("available_count"),
        F.when(n > 0, F.count_if(ok & F.col("hit")) / n).alias("hit_rate"),
        F.avg(F.when(ok, F.col("forward_return"))).alias("average_forward_return"),
    )


def macro_summary(out: DataFrame, conditions: DataFrame, horizon: str = "4w") -> DataFrame:
    """Outcomes by the macro condition recorded with the run.

    ``conditions``: run_id, series_id, condition. Groups with nothing matured drop out.
    """
    ok = F.col("forward_return").isNotNull() & F.col("hit").isNotNull()
    n = F.count_if(ok)
    j = out.where(F.col("horizon") == horizon).join(conditions, "run_id")
    return (
        j.groupBy("series_id", "condition", "action")
        .agg(
            F.count("*").alias("decision_count"),
            n.alias("available_count"),
            F.when(n > 0, F.count_if(ok & F.col("hit")) / n).alias("hit_rate"),
            F.avg(F.when(ok, F.col("forward_return"))).alias("average_forward_return"),
            F.avg(F.when(ok, F.col("max_drawdown"))).alias("average_max_drawdown"),
        )
        .where("available_count > 0")
    )


def with_scores(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """Decisions with the state and scores of their own run."""
    s = scores.select("run_id", F.upper("ticker").alias("ticker"), "state", "s_score", "f_score")
    return decisions.withColumn("ticker", F.upper("ticker")).join(s, ["run_id", "ticker"], "left")


def review_candidates(out: DataFrame, horizon: str = "4w", min_abs: float = 0.02) -> DataFrame:
    """Misses that moved, largest first (F8)."""
    return out.where((F.col("horizon") == horizon) & ~F.col("hit") & (F.abs("forward_return") >= min_abs)).orderBy(
        F.desc(F.abs("forward_return"))
    )
