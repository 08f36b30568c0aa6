"""Registered queries: panel, returns, metrics, variants, gates."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.columns import rounded, shown
from ..operators import lanes, macro as mc, returns as rt, states
from ..session import materialise
from ..sources.tables import PRINT_ORDER, crowd, macro, ordered_prints
from .macros import RULES
from .methodology import brand_calendar, day_table, priced_bars, scored_table, targets

OOS = date(1999, 1, 1)
NAMES = ["method", "sixty_forty", "equal_weight"]
THRESHOLDS = (1.0, 1.25, 1.5)


class Inputs:
    """Bars, calendar, panel and replay of one root, each written once."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.bars = priced_bars(spark, root)
        self.calendar = brand_calendar(spark, root)
        self.panel = rt.price_panel(self.bars)

    def scored(self):
        return scored_table(self.spark, self.root)

    def method(self, scored=None):
        t = targets(self.scored() if scored is None else scored)
        return t.select(F.lit("method").alias("strategy"), "as_of", "ticker", "weight")

    def three(self, scored=None):
        return (
            self.method(scored)
            .unionByName(rt.sixty_forty(self.calendar, "Brand#3", "Brand#4"))
            .unionByName(rt.equal_weight(self.calendar, self.panel))
        )

    def periods(self, scored=None):
        return rt.period_returns(self.panel, self.calendar, self.three(scored), NAMES)


def _static(spark, root):
    x = Inputs(spark, root)
    t = rt.sixty_forty(x.calendar, "Brand#3", "Brand#4").unionByName(rt.equal_weight(x.calendar, x.panel))
    return rounded(t)


def _clean(spark, root):
    """Raw weights that overshoot on some dates and miss on others."""
    x = Inputs(spark, root)
    raw = rt.equal_weight(x.calendar, x.panel, "raw")
    k = F.month("as_of")
    return rounded(rt.clean_targets(raw.withColumn("weight", F.when(k % 3 == 0, F.col("weight") * 2).when(k % 5 != 0, F.col("weight")))))


def _metrics(spark, root):
    net = rt.net_returns(Inputs(spark, root).periods(), 5.0)
    return shown(rt.metrics(rt.with_windows(net, OOS), ["strategy", "window"]))


def _variants(x):
    """Baseline and one strategy per macro rule, with its active rebalances."""
    base = materialise(x.method())
    mask = materialise(mc.condition_mask(macro(x.spark, x.root), x.calendar.select("as_of"), RULES))
    rule = F.array(*[F.struct(F.lit(r["rule"]).alias("rule"), F.lit(float(r["multiplier"])).alias("m")) for r in RULES])
    fan = base.select("as_of", "ticker", "weight", F.explode(rule).alias("r")).select("as_of", "ticker", "weight", "r.rule", "r.m")
    adjusted = fan.join(mask, ["as_of", "rule"]).select(
        F.col("rule").alias("strategy"), "as_of", "ticker", F.when(F.col("active"), F.col("weight") * F.col("m")).otherwise(F.col("weight")).alias("weight")
    )
    active = mask.groupBy(F.col("rule").alias("strategy")).agg(
        F.count_if("active").alias("active_rebalances"), F.count_if(F.col("active") & (F.col("as_of") >= F.lit(OOS))).alias("active_oos")
    )
    names = ["method"] + [r["rule"] for r in RULES]
    periods = rt.period_returns(x.panel, x.calendar, base.unionByName(adjusted), names)
    measured = rt.metrics(rt.with_windows(rt.net_returns(periods, 5.0), OOS), ["strategy", "window"])
    return rt.variant_deltas(measured, "method"), active


def _variant_deltas(spark, root):
    return shown(_variants(Inputs(spark, root))[0])


def _promotion(spark, root):
    deltas, active = _variants(Inputs(spark, root))
    return shown(rt.promotion(deltas, active))


def _sweep_decisions(x):
    """Held positions with the latest monthly block ratio known at the rebalance."""
    ratio = lanes.block_ratio(
        ordered_prints(x.spark, x.root).withColumn("month", F.last_day("date")), ["ticker", "month"], order=["date", *PRINT_ORDER, "size", "price"],
        min_size=45.0, min_notional=90000.0, crowd=crowd(day_table(x.spark, x.root)).withColumn("month", F.last_day("_b")),
    )
    snaps = ratio.select("ticker", F.col("month").alias("as_of"), F.col("month").alias("snapshot_as_of"), F.col("block_up_ratio").alias("ratio"))
    return asof_backward(x.method(), snaps, ["ticker"], "as_of", ["snapshot_as_of", "ratio"])


def _block_sweep(spark, root):
    x = Inputs(spark, root)
    d = materialise(_sweep_decisions(x))
    fan = d.select("*", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold"))
    counts = fan.groupBy("threshold").agg(
        F.count("*").alias("required"),
        F.count_if(F.col("snapshot_as_of").isNotNull()).alias("available"),
        F.count_if(F.col("snapshot_as_of").isNotNull() & F.col("ratio").isNull()).alias("unusable"),
        F.count_if(F.col("ratio") >= F.col("threshold")).alias("passing"),
        F.count_if(F.col("ratio") < F.col("threshold")).alias("below"),
        F.count_distinct(F.when(F.col("snapshot_as_of").isNotNull(), F.col("as_of"))).alias("active_rebalances"),
        F.count_distinct(F.when(F.col("snapshot_as_of").isNotNull() & (F.col("as_of") >= F.lit(OOS)), F.col("as_of"))).alias("active_oos"),
    )
    name = F.concat(F.lit("block_"), F.col("threshold").cast("string"))
    adjusted = fan.select(
        name.alias("strategy"), "as_of", "ticker", F.when(F.col("ratio") < F.col("threshold"), 0.0).otherwise(F.col("weight")).alias("weight")
    )
    base = d.select("strategy", "as_of", "ticker", "weight")
    names = ["method"] + [f"block_{t}" for t in THRESHOLDS]
    periods = rt.period_returns(x.panel, x.calendar, base.unionByName(adjusted), names)
    measured = rt.metrics(rt.with_windows(rt.net_returns(periods, 5.0), OOS), ["strategy", "window"])
    deltas = rt.variant_deltas(measured, "method", ("cagr", "sharpe", "max_drawdown"))
    active = counts.select(name.alias("strategy"), "active_rebalances", "active_oos")
    label = rt.promotion(deltas, active).select("strategy", "promotion_label")
    out = deltas.where("window = 'out_of_sample'").join(counts.withColumn("strategy", name), "strategy").join(label, "strategy")
    return shown(out.drop("window"))


def _provider_deltas(spark, root):
    """The same targets on adjusted and on raw closes."""
    x = Inputs(spark, root)
    t = materialise(x.method())
    raw = rt.price_panel(x.bars.withColumn("price", F.col("close")))
    parts = []
    for name, panel in (("adjusted", x.panel), ("raw", raw)):
        p = rt.period_returns(panel, x.calendar, t.withColumn("strategy", F.lit(name)), [name])
        parts.append(rt.metrics(rt.with_windows(rt.net_returns(p, 5.0), OOS), ["strategy", "window"]))
    return shown(rt.variant_deltas(parts[0].unionByName(parts[1]), "adjusted", ("cagr", "sharpe", "max_drawdown")))


def _gates(spark, root):
    x = Inputs(spark, root)
    scored = x.scored()
    measured = rt.metrics(rt.with_windows(rt.net_returns(x.periods(scored), 5.0), OOS), ["strategy", "window"])
    return shown(rt.acceptance_gates(measured, states.transition_rate(scored), "method", "equal_weight"))


def _summary(spark, root):
    x = Inputs(spark, root)
    scored = x.scored()
    return rounded(rt.simulation_summary(scored, targets(scored), states.transition_rate(scored)))


def _equity_combined(spark, root):
    """Named curves on the union calendar; the benchmark curve starts later."""
    x = Inputs(spark, root)
    eq = rt.equity(rt.net_returns(x.periods(), 5.0), ["strategy"]).select("strategy", "date", "equity")
    eq = materialise(eq)
    return shown(rt.carried_panel(eq, "strategy", "equity", from_common_start=False))


def _validation(spark, root):
    x = Inputs(spark, root)
    t = rt.sixty_forty(x.calendar, "Brand#3", "Brand#99").withColumn("as_of", F.when(F.day("as_of") == 7, F.date_add("as_of", 4000)).otherwise(F.col("as_of")))
    return rt.validate_inputs(x.bars, t)


QUERIES = {
    "price_panel": lambda s, d: rounded(rt.price_panel(priced_bars(s, d)), 10),
    "static_targets": _static,
    "weights_clean": _clean,
    "backtest_periods": lambda s, d: rounded(rt.net_returns(Inputs(s, d).periods(), 5.0)),
    "equity_curve": lambda s, d: shown(
        rt.equity(rt.net_returns(Inputs(s, d).periods(), 5.0), ["strategy"]).select("strategy", "date", "equity", "drawdown")
    ),
    "backtest_metrics": _metrics,
    "cost_scenarios": lambda s, d: shown(rt.metrics(rt.cost_scenarios(Inputs(s, d).periods()), ["strategy", "cost_bps"])),
    "macro_variants": _variant_deltas,
    "macro_promotion": _promotion,
    "block_sweep": _block_sweep,
    "provider_deltas": _provider_deltas,
    "acceptance_gates": _gates,
    "simulation_summary": _summary,
    "equity_combined": _equity_combined,
    "split_date": lambda s, d: rt.split_date(brand_calendar(s, d), date(2001, 10, 1)),
    "input_validation": _validation,
}
