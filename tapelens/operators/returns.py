"""Portfolio returns in closed form: no step-by-step simulation.

Between rebalances the weights only drift with prices, so the value of a unit
invested at rebalance s is ``V(t) = 1 + sum w_i (P_i(t)/P_i(s) - 1)``. Every period's
return, drifted weight and turnover follows from V, and all dates compute at once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

PERIODS = 252


def carried_panel(points: DataFrame, key: str, value: str, from_common_start: bool = True) -> DataFrame:
    """Value of every key on every date of the union calendar, carried forward.

    A point covers the days until the key's next point; those days are matched with
    the calendar. Nothing is paired that does not hold: no date x key product.
    """
    known = points.where(F.col(value).isNotNull()).select(key, "date", value)
    w = Window.partitionBy(key).orderBy("date")
    end = known.agg(F.max("date")).scalar()
    until = F.coalesce(F.date_sub(F.lead("date").over(w), 1), end)
    spread = known.withColumn("_until", until).select(
        key, value, F.explode(F.sequence("date", "_until")).alias("date")
    )
    calendar = known.select("date").distinct()
    panel = spread.join(calendar, "date", "left_semi").select(key, "date", value)
    if not from_common_start:
        return panel
    start = known.groupBy(key).agg(F.min("date").alias("_f")).agg(F.max("_f")).scalar()
    return panel.where(F.col("date") >= start)


def price_panel(bars: DataFrame) -> DataFrame:
    """Close panel from the first date on which every instrument has a price (B1, P25)."""
    return carried_panel(bars, "ticker", "price")


def clean_targets(targets: DataFrame) -> DataFrame:
    """Null weights are 0 and absolute weights of a date add up to 1 at most (B2)."""
    w = Window.partitionBy("strategy", "as_of")
    t = targets.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    gross = F.sum(F.abs("weight")).over(w)
    return t.withColumn("_gross", gross).select(
        "strategy", "as_of", "ticker", F.when(F.col("_gross") > 1.0, F.col("weight") / F.col("_gross")).otherwise(F.col("weight")).alias("weight")
    )


def static_targets(calendar: DataFrame, strategy: str, weights: dict[str, float]) -> DataFrame:
    """The same weights at every rebalance."""
    if any(v < 0 for v in weights.values()):
        raise ValueError("weights must be non-negative")
    pairs = F.array(*[F.struct(F.lit(k).alias("ticker"), F.lit(float(v)).alias("weight")) for k, v in sorted(weights.items())])
    return calendar.select(F.lit(strategy).alias("strategy"), "as_of", F.explode(pairs).alias("p")).select(
        "strategy", "as_of", "p.ticker", "p.weight"
    )


def sixty_forty(calendar: DataFrame, equity: str, bond: str) -> DataFrame:
    if equity == bond:
        raise ValueError("equity and bond must differ")
    return static_targets(calendar, "sixty_forty", {equity: 0.60, bond: 0.40})


def equal_weight(calendar: DataFrame, panel: DataFrame, strategy: str = "equal_weight") -> DataFrame:
    """Every instrument of the panel at each rebalance, equally weighted."""
    held = panel.join(calendar.select(F.col("as_of").alias("date")), "date", "left_semi")
    n = F.count("*").over(Window.partitionBy("date"))
    return held.select(F.lit(strategy).alias("strategy"), F.col("date").alias("as_of"), "ticker", (1.0 / n).alias("weight"))


def marks(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each price with the rebalance it is measured from: (ticker, date, prev_date, s0, growth)."""
    reb = calendar.select(F.col("as_of").alias("date"), F.lit(True).alias("_reb"))
    df = panel.join(reb, "date", "left")
    w = Window.partitionBy("ticker").orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("_reb"), F.struct("date", "price"))
    df = df.select(
        "ticker", "date", "price", F.lag("date").over(w).alias("prev_date"), F.last(here, ignorenulls=True).over(past).alias("_s")
    )
    return df.select(
        "ticker", "date", "prev_date", F.col("_s.date").alias("s0"), (F.col("price") / F.col("_s.price")).alias("growth")
    )


def period_returns(panel: DataFrame, calendar: DataFrame, targets: DataFrame, strategies: list[str]) -> DataFrame:
    """Gross return and turnover of every strategy on every period.

    ``targets``: strategy, as_of, ticker, weight. A signal on date d earns the return
    from d to the next date (P23). Only held positions are joined; a date on which
    nothing is held is cash.
    """
    t = clean_targets(targets)
    m = materialise(marks(panel, calendar))
    held = m.where("s0 is not null").join(t.withColumnRenamed("as_of", "s0"), ["s0", "ticker"])
    held = materialise(held.select("strategy", "date", "s0", "ticker", "weight", "growth"))
    value = held.groupBy("strategy", "date").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("value"))
    at_rebalance = held.join(calendar.select(F.col("as_of").alias("date")), "date", "left_semi")
    drifted = at_rebalance.join(value, ["strategy", "date"]).select(
        "strategy", F.col("date").alias("s0"), "ticker", (-F.col("weight") * F.col("growth") / F.col("value")).alias("leg")
    )
    wanted = t.select("strategy", F.col("as_of").alias("s0"), "ticker", F.col("weight").alias("leg"))
    turnover = (
        wanted.unionByName(drifted)
        .groupBy("strategy", "s0", "ticker")
        .agg(F.sum("leg").alias("leg"))
        .groupBy("strategy", "s0")
        .agg(F.sum(F.abs("leg")).alias("turnover"))
    )
    # One row per trading day: bounded by the calendar, fanned out to the named strategies.
    days = m.groupBy("date").agg(F.max("prev_date").alias("prev_date"), F.max("s0").alias("s0"))
    days = days.select("*", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    df = days.join(value, ["strategy", "date"], "left").join(turnover, ["strategy", "s0"], "left")
    df = df.withColumn("value", F.coalesce("value", F.lit(1.0)))
    w = Window.partitionBy("strategy").orderBy("date")
    opens = F.col("prev_date") == F.col("s0")
    base = F.when(opens | F.col("s0").isNull(), 1.0).otherwise(F.lag("value").over(w))
    df = df.withColumn("gross_return", F.col("value") / base - 1)
    return df.where("prev_date is not null").select(
        "strategy",
        "date",
        "gross_return",
        F.when(opens, F.coalesce("turnover", F.lit(0.0))).otherwise(0.0).alias("turnover"),
    )


def drifted_weights(panel: DataFrame, calendar: DataFrame, targets: DataFrame) -> DataFrame:
    """Weight of every held position at the start of each period."""
    t = clean_targets(targets)
    held = marks(panel, calendar).join(t.withColumnRenamed("as_of", "s0"), ["s0", "ticker"])
    w = Window.partitionBy("strategy", "ticker", "s0").orderBy("date")
    day = Window.partitionBy("strategy", "date")
    start = held.withColumn("_g", F.coalesce(F.lag("growth").over(w), F.lit(1.0)))
    value = 1 + F.sum(F.col("weight") * (F.col("_g") - 1)).over(day)
    return start.withColumn("period_weight", F.col("weight") * F.col("_g") / value).select("strategy", "date", "ticker", "period_weight")


def net_returns(periods: DataFrame, cost_bps: float | Column) -> DataFrame:
    """Costs multiply: net = (1 - cost)(1 + gross) - 1."""
    rate = (F.lit(float(cost_bps)) if not isinstance(cost_bps, Column) else cost_bps) / 10000.0
    cost = F.col("turnover") * rate
    return periods.withColumn("cost", cost).withColumn("net_return", (1 - F.col("cost")) * (1 + F.col("gross_return")) - 1)


def cost_scenarios(periods: DataFrame, cost_bps=(3, 5, 10)) -> DataFrame:
    """Every cost level on one pass of the periods."""
    fan = periods.select("*", F.explode(F.array(*[F.lit(float(c)) for c in cost_bps])).alias("cost_bps"))
    return net_returns(fan, F.col("cost_bps"))


def equity(net: DataFrame, keys: list[str], capital: float = 1.0) -> DataFrame:
    """Equity, drawdown and running peak, the base capital included."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = net.withColumn("equity", capital * F.product(1 + F.col("net_return")).over(w))
    peak = F.greatest(F.lit(float(capital)), F.max("equity").over(w))
    return df.withColumn("drawdown", F.col("equity") / peak - 1)


def metrics(net: DataFrame, keys: list[str], periods_per_year: int = PERIODS) -> DataFrame:
    """Performance of each key group; equity restarts inside the group."""
    n = float(periods_per_year)
    root = F.sqrt(F.lit(n))
    r = F.col("net_return")
    agg = equity(net, keys).groupBy(*keys).agg(
        F.count("*").alias("periods"),
        (F.max_by("equity", "date") - 1).alias("total_return"),
        F.when(F.max(r) > F.min(r), F.stddev_pop(r)).otherwise(0.0).alias("_std"),
        F.avg(r).alias("_mean"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("_down"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.avg("turnover").alias("average_turnover"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.count_if(F.abs("turnover") > 1e-12).alias("trade_count"),
    )
    cagr = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(n) / F.col("periods")) - 1).otherwise(-1.0)
    agg = agg.withColumn("cagr", cagr)
    return agg.select(
        *keys,
        "periods",
        "total_return",
        "cagr",
        (F.col("_std") * root).alias("volatility"),
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * root).otherwise(0.0).alias("sharpe"),
        F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down") * root).otherwise(0.0).alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
        "average_turnover",
        (F.col("average_turnover") * n).alias("annualized_turnover"),
        "hit_rate",
        "trade_count",
    )


def with_windows(net: DataFrame, oos_start) -> DataFrame:
    """Each period counted in the full window and in its side of the split."""
    side = F.when(F.col("date") < F.lit(oos_start), "in_sample").otherwise("out_of_sample")
    return net.select("*", F.explode(F.array(F.lit("full"), side)).alias("window"))


#: Differences below this share of the values are rounding of compounded returns, not a change.
NOISE = 1e-12
VARIANT_METRICS = ("total_return", "cagr", "sharpe", "max_drawdown", "annualized_turnover", "hit_rate", "trade_count")


def variant_deltas(measured: DataFrame, baseline: str, metric_names=VARIANT_METRICS) -> DataFrame:
    """Metrics of every strategy against the baseline's in the same window.

    ``measured`` has one row per strategy and window. Equal paths compound to values that differ in their
    last bits, as what came before differs; such a delta is zero, so that no label hangs on its sign.
    """

    def delta(c: str) -> Column:
        new, old = F.col(c).cast("double"), F.col(f"baseline_{c}")
        return F.when(F.abs(new - old) <= NOISE * F.greatest(F.abs(new), F.abs(old)), 0.0).otherwise(new - old)

    base = measured.where(F.col("strategy") == baseline).select(
        "window", *[F.col(c).cast("double").alias(f"baseline_{c}") for c in metric_names]
    )
    out = measured.where(F.col("strategy") != baseline).join(base, "window")
    return out.select(
        "strategy",
        "window",
        *[F.col(c).cast("double").alias(f"variant_{c}") for c in metric_names],
        *[f"baseline_{c}" for c in metric_names],
        *[delta(c).alias(f"{c}_delta") for c in metric_names],
    )


def promotion(deltas: DataFrame, active: DataFrame, min_active: int = 20, min_sharpe: float = 0.10) -> DataFrame:
    """Promotion label per variant, ranked (B12). ``active``: strategy, active_rebalances, active_oos."""

    def at(window: str, c: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(f"{c}_delta")))

    wide = deltas.groupBy("strategy").agg(
        at("full", "sharpe").alias("sharpe_delta"),
        at("out_of_sample", "sharpe").alias("oos_sharpe_delta"),
        at("out_of_sample", "cagr").alias("oos_cagr_delta"),
        at("out_of_sample", "max_drawdown").alias("oos_max_drawdown_delta"),
    )
    df = wide.join(active, "strategy").where("active_rebalances > 0").fillna(0.0)
    s, c, d = F.col("oos_sharpe_delta"), F.col("oos_cagr_delta"), F.col("oos_max_drawdown_delta")
    label = (
        F.when(F.col("active_oos") < min_active, "needs more testing")
        .when((s >= min_sharpe) & (c >= 0) & (d >= 0) & (F.col("sharpe_delta") >= 0), "candidate")
        .when((s <= 0) & (c <= 0) & (d <= 0), "do not promote")
        .otherwise("needs more testing")
    )
    rank = F.when(F.col("promotion_label") == "candidate", 0).when(F.col("promotion_label") == "needs more testing", 1).otherwise(2)
    # One row per configured variant: the ordering window is a handful of rows.
    order = Window.partitionBy(F.lit(1)).orderBy(
        rank, F.desc("oos_sharpe_delta"), F.desc("oos_cagr_delta"), F.desc("sharpe_delta"), "strategy"
    )
    return df.withColumn("promotion_label", label).withColumn("position", F.row_number().over(order))


def acceptance_gates(measured: DataFrame, rate: DataFrame, strategy: str, benchmark: str) -> DataFrame:
    """Four gates in long form and whether all pass (B15). The limits."""
    oos = measured.where("window = 'out_of_sample'")

    def value(name: str, c: str) -> Column:
        return F.max(F.when(F.col("strategy") == name, F.col(c)))

    one = oos.agg(
        value(strategy, "sharpe").alias("sharpe"),
        F.abs(value(strategy, "max_drawdown")).alias("dd"),
        F.abs(value(benchmark, "max_drawdown")).alias("bench_dd"),
        value(strategy, "annualized_turnover").alias("turnover"),
        F.lit(1).alias("_k"),
    ).join(rate.select(F.col("rate_per_ticker_year").alias("moves"), F.lit(1).alias("_k")), "_k")
    limits = {
        "oos_sharpe": (F.col("sharpe"), F.lit(0.70), F.col("sharpe") >= 0.70),
        "max_drawdown": (F.col("dd"), F.col("bench_dd") * 0.75, F.col("dd") <= F.col("bench_dd") * 0.75),
        "annualized_turnover": (F.col("turnover"), F.lit(3.0), F.col("turnover") <= 3.0),
        "state_transitions": (F.col("moves"), F.lit(4.0), F.col("moves") <= 4.0),
    }
    gates = F.array(
        *[
            F.struct(F.lit(name).alias("gate"), v.alias("value"), limit.alias("threshold"), ok.alias("passed"))
            for name, (v, limit, ok) in limits.items()
        ]
    )
    rows = one.select(F.explode(gates).alias("g")).select("g.*")
    return rows.withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy(F.lit(1))))


def simulation_summary(scored: DataFrame, targets: DataFrame, rate: DataFrame) -> DataFrame:
    """Dates, counts and transition rate of a replay, one row."""
    a = scored.agg(
        F.min("as_of").alias("start_date"),
        F.max("as_of").alias("end_date"),
        F.count_distinct("as_of").alias("rebalance_count"),
        F.count_distinct("ticker").alias("state_ticker_count"),
        F.lit(1).alias("_k"),
    )
    b = targets.where(F.abs("weight") > 0).agg(F.count_distinct("ticker").alias("selected_ticker_count"), F.lit(1).alias("_k"))
    c = rate.select("transition_count", "rate_per_ticker_year", F.lit(1).alias("_k"))
    return a.join(b, "_k").join(c, "_k").drop("_k")


def split_date(calendar: DataFrame, preferred, min_side: int = 20, fraction: float = 0.70) -> DataFrame:
    """Out-of-sample start: the preferred date, else 70 % into the dates, else thin.

    The dates form one array of rebalance days, bounded by the calendar.
    """
    pref = F.lit(preferred)
    a = calendar.agg(
        F.array_sort(F.collect_set("as_of")).alias("d"),
        F.count_if(F.col("as_of") < pref).alias("in_sample_count"),
        F.count_if(F.col("as_of") >= pref).alias("oos_count"),
    )
    n = F.size("d")
    pos = F.least(F.greatest(F.floor(n * fraction).cast("int"), F.lit(min_side)), n - min_side)
    enough = (F.col("in_sample_count") >= min_side) & (F.col("oos_count") >= min_side)
    return a.select(
        F.when(enough, pref).when(n >= 2 * min_side, F.element_at("d", pos + 1)).otherwise(pref).alias("oos_start"),
        F.when(enough, "configured").when(n >= 2 * min_side, "fallback").otherwise("thin").alias("rule"),
        "in_sample_count",
        "oos_count",
    )


def validate_inputs(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of broken rules in prices and targets, one row."""
    p = panel.agg(
        F.count_if(F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0)).alias("bad_prices"), F.lit(1).alias("_k")
    )
    dup = panel.groupBy("ticker", "date").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_prices"), F.lit(1).alias("_k"))
    day = panel.select(F.col("date").alias("as_of")).distinct()
    sym = panel.select("ticker").distinct()
    miss = targets.join(day, "as_of", "left_anti").agg(F.count("*").alias("unknown_dates"), F.lit(1).alias("_k"))
    unk = targets.join(sym, "ticker", "left_anti").agg(F.count("*").alias("unknown_tickers"), F.lit(1).alias("_k"))
    return p.join(dup, "_k").join(miss, "_k").join(unk, "_k").drop("_k")


def require_valid(report: DataFrame) -> None:
    """Raise on the first broken rule of a one-row report."""
    row = report.first().asDict()
    broken = [k for k, v in row.items() if v]
    if broken:
        raise ValueError("invalid inputs: " + ", ".join(broken))
