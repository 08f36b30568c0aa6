"""User tables: holdings, watch lists, profit and loss, trades."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_backward

EXIT_STATES = ("EXIT", "BEARISH_STAGE_4")
# States a trade side agrees with.
BUY_ALIGNED = ("STAGE_2_BULLISH", "HOLD")
SELL_ALIGNED = ("WARNING", "EXIT", "BEARISH_STAGE_4")


def analysis_weights(holdings: DataFrame, key: str = "account") -> DataFrame:
    """Explicit weights, else market values, else equal weights, per portfolio.

    The portfolio totals combine map-side and join back: a portfolio with a third of
    all positions is never held by one task.
    """
    w, v = F.col("weight"), F.col("market_value")
    tot = holdings.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.count_if(w.isNotNull() & (w >= 0)).alias("_nw"),
        F.sum(w).alias("_w"),
        F.count_if(v.isNotNull() & (v > 0)).alias("_nv"),
        F.sum(v).alias("_v"),
    )
    df = holdings.join(tot, key)
    weight = (
        F.when((F.col("_nw") == F.col("_n")) & (F.col("_w") > 0), w / F.col("_w"))
        .when((F.col("_nv") == F.col("_n")) & (F.col("_v") > 0), v / F.col("_v"))
        .otherwise(1.0 / F.col("_n"))
    )
    return df.withColumn("analysis_weight", weight).drop("_n", "_nw", "_w", "_nv", "_v")


def action_group(state: Column, selected: Column | None = None) -> Column:
    """Action list of a state; a custom universe also counts selection as bullish."""
    bull = state == "STAGE_2_BULLISH"
    if selected is not None:
        bull = bull | F.coalesce(selected, F.lit(False))
    return F.when(state.isin(*EXIT_STATES), "exit").when(state == "WARNING", "warning").when(bull, "bullish")


def analyze_holdings(holdings: DataFrame, scored: DataFrame, key: str = "account") -> DataFrame:
    """Weighted holdings with their state; unknown tickers are marked."""
    s = scored.select(
        "ticker", "state", F.col("class").alias("asset_class"), F.col("S_score").alias("s_score"), "rank_in_class", "selected", "veto",
        F.lit(True).alias("_known"),
    )
    held = analysis_weights(holdings, key).withColumn("ticker", F.upper("ticker"))
    df = held.join(s.withColumn("ticker", F.upper("ticker")), "ticker", "left")
    return df.withColumn("missing", F.col("_known").isNull()).withColumn("action", action_group(F.col("state"))).drop("_known")


def exposure(analysis: DataFrame, key: str = "account") -> DataFrame:
    """Weight by state and by class in one pass with grouping sets."""
    label = lambda c: F.when(F.col("missing"), "MISSING").otherwise(F.coalesce(c, F.lit("UNKNOWN")))
    df = analysis.select(key, label("state").alias("state"), label("asset_class").alias("asset_class"), "analysis_weight")
    g = df.groupingSets([[key, "state"], [key, "asset_class"]], key, "state", "asset_class").agg(
        F.grouping("state").alias("_by_class"), F.sum("analysis_weight").alias("weight"), F.count("*").alias("positions")
    )
    return g.select(
        key,
        F.when(F.col("_by_class") == 1, "class").otherwise("state").alias("dimension"),
        F.when(F.col("_by_class") == 1, F.col("asset_class")).otherwise(F.col("state")).alias("label"),
        "weight",
        "positions",
    )


def latest_closes(bars: DataFrame) -> DataFrame:
    """Last positive close per ticker."""
    last = bars.where("close is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.max_by("close", "date").alias("price"))
    return last.where("price > 0")


def position_pnl(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised profit per position; the market value stands in for a missing price."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    df = holdings.withColumn("ticker", F.upper("ticker")).join(prices, "ticker", "left")
    shares, basis, price, value = positive("shares"), positive("cost_basis"), positive("price"), positive("market_value")
    reason = (
        F.when(shares.isNull(), "shares missing")
        .when(basis.isNull(), "cost basis missing")
        .when(price.isNull() & value.isNull(), "current price missing")
    )
    df = df.withColumn("status", F.coalesce(reason, F.lit("OK")))
    ok = F.col("status") == "OK"
    df = df.withColumn("cost", F.when(ok, shares * basis)).withColumn("current_value", F.when(ok, F.coalesce(shares * price, value)))
    return df.withColumn("unrealized_pnl", F.col("current_value") - F.col("cost")).withColumn(
        "unrealized_pct", F.when(F.col("cost") > 0, F.col("unrealized_pnl") / F.col("cost"))
    )


def pnl_rollup(positions: DataFrame, key: str = "account") -> DataFrame:
    """Totals per portfolio and overall."""
    g = positions.rollup(key).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("current_value"), F.lit(0.0)).alias("total_value"),
        F.count_if(F.col("status") != "OK").alias("missing_count"),
        F.grouping(key).alias("_all"),
    )
    g = g.withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise(F.col(key).cast("string")))
    gain = F.col("total_value") - F.col("total_cost")
    return g.select(
        "scope", "total_cost", "total_value", gain.alias("unrealized_pnl"), F.when(F.col("total_cost") > 0, gain / F.col("total_cost")).alias("unrealized_pct"), "missing_count"
    )


def trade_alignment(trades: DataFrame, states: DataFrame) -> DataFrame:
    """Trades against the last state known on their date.

    The as-of step runs on the distinct (ticker, date) pairs; the trades themselves
    only take part in the equi-join that follows.
    """
    s = states.where("state is not null").select(
        F.upper("ticker").alias("ticker"), F.col("as_of").alias("date"), F.col("as_of").alias("state_date"), "state"
    )
    t = trades.withColumn("ticker", F.upper("ticker")).withColumnRenamed("trade_date", "date")
    df = asof_backward(t, s, ["ticker"], "date", ["state_date", "state"])
    good = F.when(F.col("side") == "BUY", F.col("state").isin(*BUY_ALIGNED)).otherwise(F.col("state").isin(*SELL_ALIGNED))
    alignment = F.when(F.col("state").isNull(), "NO_METHOD_STATE").when(good, "ALIGNED").otherwise("AGAINST_METHOD")
    return df.withColumn("alignment", alignment).withColumnRenamed("date", "trade_date")


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """Counts per side and overall, with the aligned share."""
    g = aligned.rollup("side").agg(
        F.count("*").alias("trades"),
        F.count_if(F.col("alignment") == "ALIGNED").alias("aligned"),
        F.count_if(F.col("alignment") == "AGAINST_METHOD").alias("against"),
        F.count_if(F.col("alignment").startswith("NO_")).alias("unavailable"),
        F.grouping("side").alias("_all"),
    )
    return g.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("side")).alias("side"),
        "trades", "aligned", "against", "unavailable", (F.col("aligned") / F.col("trades")).alias("aligned_rate"),
    )


def custom_universe(tickers: DataFrame, scored: DataFrame) -> DataFrame:
    """A ticker list ranked by S, unknown tickers last.

    ``tickers``: list_id, ticker, pos. A list is user input of one row per ticker.
    """
    s = scored.select(
        "ticker", "state", F.col("class").alias("asset_class"), F.col("S_score").alias("s_score"), "selected", F.lit(True).alias("_known")
    )
    df = tickers.join(s, "ticker", "left").withColumn("missing", F.col("_known").isNull())
    w = Window.partitionBy("list_id").orderBy("missing", F.col("s_score").isNull(), F.desc("s_score"), "pos")
    return df.select(
        "list_id", "ticker", "pos", "missing",
        F.when(~F.col("missing"), F.row_number().over(w)).alias("custom_rank"),
        "state", "asset_class", "s_score",
        action_group(F.col("state"), F.col("selected")).alias("action"),
    )


def universe_counts(analysis: DataFrame) -> DataFrame:
    """Members by class and by state."""
    label = lambda c: F.when(F.col("missing"), "MISSING").otherwise(F.coalesce(c, F.lit("UNKNOWN")))
    df = analysis.select("list_id", F.explode(F.array(
        F.struct(F.lit("class").alias("dimension"), label("asset_class").alias("label")),
        F.struct(F.lit("state").alias("dimension"), label("state").alias("label")),
    )).alias("d"))
    return df.groupBy("list_id", "d.dimension", "d.label").agg(F.count("*").alias("members"))
