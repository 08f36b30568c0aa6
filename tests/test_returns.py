from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapelens.operators import macro, returns as rt

D = [date(2024, 1, 1) + timedelta(days=i) for i in range(12)]


def frames(spark, prices: dict[str, list[float]], targets: dict[date, dict[str, float]]):
    panel = spark.createDataFrame([(t, D[i], float(p)) for t, ps in prices.items() for i, p in enumerate(ps)], "ticker string, date date, price double")
    cal = spark.createDataFrame([(d,) for d in targets], "as_of date")
    rows = [("s", d, t, float(w)) for d, ws in targets.items() for t, w in ws.items()]
    return panel, cal, spark.createDataFrame(rows, "strategy string, as_of date, ticker string, weight double")


def run(spark, prices, targets):
    panel, cal, t = frames(spark, prices, targets)
    return rt.period_returns(panel, cal, t, ["s"])


def test_switch_with_costs(spark):
    p = run(spark, {"AAA": [100, 110, 121, 121], "BBB": [100, 100, 100, 110]}, {D[0]: {"AAA": 1}, D[2]: {"BBB": 1}})
    out = rt.equity(rt.net_returns(p, 10.0), ["strategy"], 100.0).orderBy("date").collect()
    assert [r.gross_return for r in out] == pytest.approx([0.1, 0.1, 0.1])
    assert [r.turnover for r in out] == pytest.approx([1, 0, 2])
    assert [r.net_return for r in out] == pytest.approx([0.0989, 0.1, 0.0978])
    assert out[-1].equity == pytest.approx(132.7009662)


def test_weights_drift(spark):
    panel, cal, t = frames(spark, {"AAA": [100, 200, 200], "BBB": [100, 100, 200]}, {D[0]: {"AAA": 0.5, "BBB": 0.5}})
    out = rt.period_returns(panel, cal, t, ["s"]).orderBy("date").collect()
    assert [r.gross_return for r in out] == pytest.approx([0.5, 1 / 3])
    w = {(r.date, r.ticker): r.period_weight for r in rt.drifted_weights(panel, cal, t).collect()}
    assert w[(D[2], "AAA")] == pytest.approx(2 / 3)


def loop(prices, targets):
    """Independent day-by-day account."""
    names, n = list(prices), len(next(iter(prices.values())))
    w, out = dict.fromkeys(names, 0.0), []
    for i in range(1, n):
        turn = 0.0
        if D[i - 1] in targets:
            new = {t: targets[D[i - 1]].get(t, 0.0) for t in names}
            turn = sum(abs(new[t] - w[t]) for t in names)
            w = new
        r = {t: prices[t][i] / prices[t][i - 1] - 1 for t in names}
        g = sum(w[t] * r[t] for t in names)
        out.append((g, turn))
        w = {t: w[t] * (1 + r[t]) / (1 + g) for t in names}
    return out


def test_closed_form_equals_the_loop(spark):
    rnd = random.Random(3)
    prices = {t: [rnd.uniform(50, 150) for _ in D] for t in "ABCD"}
    targets = {D[1]: {"A": 0.4, "B": 0.5}, D[4]: {}, D[6]: {"C": 1.0}, D[9]: {"A": 0.2, "D": 0.3}}
    targets[D[4]] = {"A": 0.0}
    want = loop(prices, targets)
    got = run(spark, prices, targets).orderBy("date").collect()
    assert [r.gross_return for r in got] == pytest.approx([g for g, _ in want])
    assert [r.turnover for r in got] == pytest.approx([t for _, t in want])


def test_overweight_targets_are_scaled(spark):
    t = spark.createDataFrame([("s", D[0], "A", 1.5), ("s", D[0], "B", 0.5), ("s", D[1], "A", None)], "strategy string, as_of date, ticker string, weight double")
    out = {(r.as_of, r.ticker): r.weight for r in rt.clean_targets(t).collect()}
    assert out == {(D[0], "A"): 0.75, (D[0], "B"): 0.25, (D[1], "A"): 0.0}


def test_panel_starts_when_all_have_prices(spark):
    rows = [("A", D[0], 1.0), ("A", D[2], 2.0), ("B", D[1], 5.0)]
    out = rt.price_panel(spark.createDataFrame(rows, "ticker string, date date, price double")).orderBy("date", "ticker").collect()
    assert [(r.ticker, r.date, r.price) for r in out] == [("A", D[1], 1.0), ("B", D[1], 5.0), ("A", D[2], 2.0), ("B", D[2], 5.0)]


def test_metrics_of_flat_returns(spark):
    net = spark.createDataFrame([("s", D[i], 0.0, 0.0) for i in range(4)], "strategy string, date date, net_return double, turnover double")
    m = rt.metrics(net, ["strategy"]).first()
    assert (m.total_return, m.cagr, m.sharpe, m.sortino, m.max_drawdown, m.calmar) == (0, 0, 0, 0, 0, 0)


def test_invalid_inputs_raise(spark):
    panel, _, t = frames(spark, {"AAA": [1, -1]}, {D[0]: {"ZZZ": 1}})
    with pytest.raises(ValueError, match="bad_prices"):
        rt.require_valid(rt.validate_inputs(panel, t))


RULE = {"rule": "r", "series_id": "m", "condition": "falling", "threshold": 0.0, "lookback": 1, "lag_days": 0, "multiplier": 0.5}


@pytest.mark.parametrize("lag, obs, ask, want", [(0, {0: 1.0, 4: 0.5}, (1, 3, 5), [False, False, True]), (5, {0: 1.0, 2: 0.5}, (3, 7), [False, True])])
def test_macro_mask(spark, lag, obs, ask, want):
    m = spark.createDataFrame([("m", D[i], v) for i, v in obs.items()], "series_id string, date date, value double")
    cal = spark.createDataFrame([(D[i],) for i in ask], "as_of date")
    out = macro.condition_mask(m, cal, [{**RULE, "lag_days": lag}]).orderBy("as_of").collect()
    assert [r.active for r in out] == want


def test_early_phase(spark):
    months = [date(2025 + (i // 12), i % 12 + 1, 28) for i in range(15)]
    prod = [100.0] * 12 + [104.0, 105.0, 106.0]
    rows = [("INDPRO", d, v) for d, v in zip(months, prod)] + [(s, months[-1], v) for s, v in (("T10Y2Y", 0.75), ("RECPROUSM156N", 1.0), ("NFCI", -0.2))]
    r = macro.wide_readings(spark.createDataFrame(rows, "series_id string, date date, value double")).withColumn("risk_on", F.lit(True))
    out = macro.assess_regime(r).orderBy(F.desc("date")).first()
    assert (out.phase_hint, out.yield_curve_positive) == ("EARLY", True)


def test_rounding_of_equal_drawdowns_decides_no_label(spark):
    """The same fall after other earlier returns differs in its last bit; that is neither gain nor loss."""
    one, other = -0.9918156724584571, -0.991815672458457
    rows = [("base", w, 4.0, 1e7, other if w == "full" else one) for w in ("full", "out_of_sample")]
    rows += [("worse", "full", 3.9, 9e6, one), ("worse", "out_of_sample", 3.9, 9e6, other)]
    rows += [("better", "full", 4.5, 2e7, one), ("better", "out_of_sample", 4.5, 2e7, one)]
    rows += [("shallower", "full", 3.9, 9e6, one), ("shallower", "out_of_sample", 3.9, 9e6, one + 1e-9)]
    measured = spark.createDataFrame(rows, "strategy string, window string, sharpe double, cagr double, max_drawdown double")
    deltas = rt.variant_deltas(measured, "base", ("cagr", "sharpe", "max_drawdown"))
    active = spark.createDataFrame([(s, 30, 25) for s in ("worse", "better", "shallower")], "strategy string, active_rebalances int, active_oos int")
    got = {r.strategy: (r.promotion_label, r.oos_max_drawdown_delta) for r in rt.promotion(deltas, active).collect()}
    assert got["worse"] == ("do not promote", 0.0) and got["better"] == ("candidate", 0.0)
    assert got["shallower"][0] == "needs more testing" and abs(got["shallower"][1] - 1e-9) < 1e-12
