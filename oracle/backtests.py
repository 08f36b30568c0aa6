"""Statements for panel, returns, metrics, variants and gates."""
from .parts import cte, r, statement as st, t

OOS = "DATE '1999-01-01'"
for name, price in (("panel", "price"), ("rawpanel", "close")):
    cte(name, f"""
    SELECT g.ticker, g.date, b.p AS price
    FROM (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM pbars) t CROSS JOIN (SELECT DISTINCT date FROM pbars) d) g
    ASOF JOIN (SELECT ticker, date, {price} AS p FROM pbars) b ON g.ticker = b.ticker AND g.date >= b.date
    WHERE g.date >= (SELECT max(f) FROM (SELECT min(date) AS f FROM pbars GROUP BY ticker))""")
cte("pdays", """
    SELECT p.date, lag(p.date) OVER (ORDER BY p.date) AS prev_date, c.as_of AS s0
    FROM (SELECT DISTINCT date FROM panel) p ASOF LEFT JOIN calendar c ON p.date > c.as_of""")
cte("static", """
    SELECT 'sixty_forty' AS strategy, as_of, t AS ticker, w AS weight FROM calendar CROSS JOIN (VALUES ('Brand#3', 0.6::DOUBLE), ('Brand#4', 0.4::DOUBLE)) v(t, w)
    UNION ALL SELECT 'equal_weight', as_of, ticker, 1.0 / count(*) OVER (PARTITION BY as_of) FROM calendar JOIN panel ON date = as_of""")
cte("all_targets", "SELECT 'method' AS strategy, as_of, ticker, weight FROM targets UNION ALL SELECT strategy, as_of, ticker, weight FROM static")


def engine(tag: str, targets: str, names: list[str], panel: str = "panel") -> None:
    """CTEs <tag>_net: strategy, date, gross_return, turnover of the named strategies.

    A strategy that never selects anything is all cash and still reports.
    """
    listed = ", ".join(f"('{n}')" for n in names)
    cte(f"{tag}_held", f"""
      SELECT t.strategy, d.date, d.s0, t.ticker, t.weight, p.price / q.price AS g
      FROM pdays d JOIN {targets} t ON t.as_of = d.s0 JOIN {panel} p ON p.ticker = t.ticker AND p.date = d.date
      JOIN {panel} q ON q.ticker = t.ticker AND q.date = d.s0""")
    cte(f"{tag}_value", f"SELECT strategy, date, 1 + sum(weight * (g - 1)) AS v FROM {tag}_held GROUP BY 1, 2")
    cte(f"{tag}_turn", f"""
      SELECT strategy, as_of, sum(abs(leg)) AS turnover FROM (
        SELECT strategy, as_of, ticker, sum(leg) AS leg FROM (
          SELECT strategy, as_of, ticker, weight AS leg FROM {targets}
          UNION ALL SELECT h.strategy, h.date, h.ticker, -h.weight * h.g / v.v FROM {tag}_held h JOIN {tag}_value v ON h.strategy = v.strategy AND h.date = v.date
            JOIN calendar c ON c.as_of = h.date) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
    cte(f"{tag}_net", f"""
      SELECT strategy, date, gross_return, turnover FROM (
        SELECT s.strategy, d.date, d.prev_date, coalesce(v.v, 1) / CASE WHEN d.s0 IS NULL OR d.prev_date = d.s0 THEN 1.0 ELSE lag(coalesce(v.v, 1)) OVER (PARTITION BY s.strategy ORDER BY d.date) END - 1 AS gross_return,
               CASE WHEN d.prev_date = d.s0 THEN coalesce(t.turnover, 0) ELSE 0.0 END AS turnover
        FROM pdays d CROSS JOIN (VALUES {listed}) s(strategy)
        LEFT JOIN {tag}_value v ON v.strategy = s.strategy AND v.date = d.date
        LEFT JOIN {tag}_turn t ON t.strategy = s.strategy AND t.as_of = d.s0) WHERE prev_date IS NOT NULL""")
    cte(f"{tag}_cost", f"SELECT *, turnover * 0.0005 AS cost, (1 - turnover * 0.0005) * (1 + gross_return) - 1 AS net_return FROM {tag}_net")
    cte(f"{tag}_win", f"""
      SELECT *, 'full' AS win FROM {tag}_cost UNION ALL SELECT *, CASE WHEN date < {OOS} THEN 'in_sample' ELSE 'out_of_sample' END FROM {tag}_cost""")
    cte(f"{tag}_metrics", metrics(f"{tag}_win", "strategy, win"))


def metrics(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, n AS periods, tr AS total_return, cagr, sd * sqrt(252) AS volatility, CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0.0 END AS sharpe,
             CASE WHEN dn > 0 THEN m / dn * sqrt(252) ELSE 0.0 END AS sortino, mdd AS max_drawdown, CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 0.0 END AS calmar,
             avt AS average_turnover, avt * 252 AS annualized_turnover, hr AS hit_rate, tc AS trade_count
      FROM (SELECT *, pow(1 + tr, 252.0 / n) - 1 AS cagr FROM (
        SELECT {keys}, count(*) AS n, arg_max(eq, date) - 1 AS tr, CASE WHEN max(net_return) > min(net_return) THEN stddev_pop(net_return) ELSE 0.0 END AS sd,
               avg(net_return) AS m, sqrt(avg(pow(least(net_return, 0.0), 2))) AS dn, least(min(eq / pk - 1), 0.0) AS mdd, avg(turnover) AS avt,
               avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS hr, count(*) FILTER (abs(turnover) > 1e-12) AS tc
        FROM (SELECT *, greatest(1.0, max(eq) OVER (PARTITION BY {keys} ORDER BY date)) AS pk FROM (
                SELECT *, product(1 + net_return) OVER (PARTITION BY {keys} ORDER BY date) AS eq FROM {source}))
        GROUP BY {keys}))"""


engine("bt", "all_targets", ["method", "sixty_forty", "equal_weight"])
COLS = ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "average_turnover", "annualized_turnover", "hit_rate")
cte("costed", """SELECT n.*, c AS cost_bps, (1 - turnover * c / 10000) * (1 + gross_return) - 1 AS net_return FROM bt_net n CROSS JOIN (VALUES (3.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) v(c)""")
cte("cost_metrics", metrics("costed", "strategy, cost_bps"))
cte("bt_equity", """
    SELECT strategy, date, eq AS equity, eq / greatest(1.0, max(eq) OVER (PARTITION BY strategy ORDER BY date)) - 1 AS drawdown
    FROM (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy ORDER BY date) AS eq FROM bt_cost)""")
# --- macro variants
cte("rule_mult", "SELECT rule, multiplier AS m FROM rules")
cte("variant_targets", """
    SELECT 'method' AS strategy, as_of, ticker, weight FROM targets
    UNION ALL SELECT k.rule, t.as_of, t.ticker, CASE WHEN k.active THEN t.weight * m ELSE t.weight END FROM targets t JOIN mask k ON t.as_of = k.as_of JOIN rule_mult m ON m.rule = k.rule""")
engine("mv", "variant_targets", ["method", "urgent_rising", "high_falling", "medium_above", "low_flat"])


def deltas(tag: str, base: str, names) -> str:
    v = t(*[f"variant_{c}=v.{c}" for c in names], *[f"baseline_{c}=b.{c}" for c in names], *[f"{c}_delta=v.{c} - b.{c}" for c in names])
    return f"SELECT v.strategy, v.win AS \"window\", {v} FROM {tag}_metrics v JOIN {tag}_metrics b ON b.strategy = '{base}' AND v.win = b.win AND v.strategy <> '{base}'"


def promo(tag: str, base: str, active: str) -> str:
    d = lambda w, c: f"max(v.{c} - b.{c}) FILTER (v.win = '{w}')"
    return f"""SELECT *, CASE WHEN active_oos < 20 THEN 'needs more testing' WHEN oos_sharpe_delta >= 0.1 AND oos_cagr_delta >= 0 AND oos_max_drawdown_delta >= 0 AND sharpe_delta >= 0 THEN 'candidate'
          WHEN oos_sharpe_delta <= 0 AND oos_cagr_delta <= 0 AND oos_max_drawdown_delta <= 0 THEN 'do not promote' ELSE 'needs more testing' END AS promotion_label
        FROM (SELECT v.strategy, {d('full', 'sharpe')} AS sharpe_delta, {d('out_of_sample', 'sharpe')} AS oos_sharpe_delta,
                {d('out_of_sample', 'cagr')} AS oos_cagr_delta, {d('out_of_sample', 'max_drawdown')} AS oos_max_drawdown_delta
              FROM {tag}_metrics v JOIN {tag}_metrics b ON b.strategy = '{base}' AND v.win = b.win AND v.strategy <> '{base}' GROUP BY 1) x
        JOIN {active} a USING (strategy) WHERE active_rebalances > 0"""


cte("mv_active", f"SELECT rule AS strategy, count(*) FILTER (active) AS active_rebalances, count(*) FILTER (active AND as_of >= {OOS}) AS active_oos FROM mask GROUP BY 1")
cte("mv_promo", promo("mv", "method", "mv_active"))
# --- block sweep
cte("tape_dir", """
    SELECT *, lag(price) OVER (PARTITION BY ticker, month ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, discount) AS pp
    FROM (SELECT *, last_day(date) AS month FROM ticks WHERE price > 0 AND size > 0)""")
cte("month_ratio", """
    SELECT ticker, month, CASE WHEN u = 0 AND d = 0 THEN NULL WHEN d = 0 THEN 2.0 ELSE u / d END AS ratio FROM (
      SELECT ticker, month, coalesce(sum(price * size) FILTER ((size >= 45 OR price * size >= 90000) AND price > pp), 0) AS u,
             coalesce(sum(price * size) FILTER ((size >= 45 OR price * size >= 90000) AND price < pp), 0) AS d FROM tape_dir GROUP BY 1, 2)""")
cte("sweep_decisions", """
    SELECT t.as_of, t.ticker, t.weight, m.month AS snap_as_of, m.ratio FROM targets t ASOF LEFT JOIN month_ratio m ON t.ticker = m.ticker AND t.as_of >= m.month""")
cte("sweep_fan", "SELECT d.*, 'block_' || x AS strategy, CAST(x AS DOUBLE) AS threshold FROM sweep_decisions d CROSS JOIN (VALUES ('1.0'), ('1.25'), ('1.5')) v(x)")
cte("sweep_targets", """
    SELECT 'method' AS strategy, as_of, ticker, weight FROM targets
    UNION ALL SELECT strategy, as_of, ticker, CASE WHEN ratio < threshold THEN 0.0 ELSE weight END FROM sweep_fan""")
engine("sw", "sweep_targets", ["method", "block_1.0", "block_1.25", "block_1.5"])
cte("sweep_counts", f"""
    SELECT strategy, threshold, count(*) AS required, count(snap_as_of) AS available, count(*) FILTER (snap_as_of IS NOT NULL AND ratio IS NULL) AS unusable,
           count(*) FILTER (ratio >= threshold) AS passing, count(*) FILTER (ratio < threshold) AS below,
           count(DISTINCT CASE WHEN snap_as_of IS NOT NULL THEN as_of END) AS active_rebalances,
           count(DISTINCT CASE WHEN snap_as_of IS NOT NULL AND as_of >= {OOS} THEN as_of END) AS active_oos FROM sweep_fan GROUP BY 1, 2""")
cte("sw_promo", promo("sw", "method", "sweep_counts"))
# --- provider comparison
cte("adj_targets", "SELECT 'adjusted' AS strategy, as_of, ticker, weight FROM targets")
cte("raw_targets", "SELECT 'raw' AS strategy, as_of, ticker, weight FROM targets")
engine("pa", "adj_targets", ["adjusted"])
engine("pr", "raw_targets", ["raw"], "rawpanel")
cte("pv_metrics", "SELECT * FROM pa_metrics UNION ALL SELECT * FROM pr_metrics")
cte("rate", """
    SELECT transition_count, CASE WHEN transition_count = 0 THEN 0.0 ELSE transition_count / (n / 52.0) END AS rate_per_ticker_year
    FROM (SELECT count(*) FILTER (prior <> state) AS transition_count, count(*) AS n
          FROM (SELECT state, lag(state) OVER (PARTITION BY ticker ORDER BY as_of) AS prior FROM scored) WHERE prior IS NOT NULL)""")
cte("oos", """
    SELECT max(sharpe) FILTER (strategy = 'method') AS sharpe, abs(max(max_drawdown) FILTER (strategy = 'method')) AS dd,
           abs(max(max_drawdown) FILTER (strategy = 'equal_weight')) AS bdd, max(annualized_turnover) FILTER (strategy = 'method') AS turn,
           (SELECT rate_per_ticker_year FROM rate) AS moves FROM bt_metrics WHERE win = 'out_of_sample'""")
cte("gates", """
    SELECT 'oos_sharpe' AS gate, sharpe AS value, 0.7 AS threshold, sharpe >= 0.7 AS passed FROM oos
    UNION ALL SELECT 'max_drawdown', dd, bdd * 0.75, dd <= bdd * 0.75 FROM oos
    UNION ALL SELECT 'annualized_turnover', turn, 3.0, turn <= 3 FROM oos
    UNION ALL SELECT 'state_transitions', moves, 4.0, moves <= 4 FROM oos""")
cte("curves", "SELECT strategy, date, equity FROM bt_equity")
V = ("total_return", "cagr", "sharpe", "max_drawdown", "annualized_turnover", "hit_rate", "trade_count")
D3 = ("cagr", "sharpe", "max_drawdown")

SQL = {
    "price_panel": st(f"SELECT ticker, date, {r('price', digits=10)} FROM panel"),
    "static_targets": st(f"SELECT strategy, as_of, ticker, {r('weight')} FROM static"),
    "weights_clean": st(f"""SELECT 'raw' AS strategy, as_of, ticker, {r('weight=CASE WHEN g > 1 THEN w / g ELSE w END')} FROM (
        SELECT *, sum(abs(w)) OVER (PARTITION BY as_of) AS g FROM (
          SELECT as_of, ticker, coalesce(CASE WHEN month(as_of) % 3 = 0 THEN weight * 2 WHEN month(as_of) % 5 <> 0 THEN weight END, 0.0) AS w FROM static WHERE strategy = 'equal_weight'))"""),
    "backtest_periods": st(f"SELECT strategy, date, {r('gross_return','turnover','cost','net_return')} FROM bt_cost"),
    "equity_curve": st(f"SELECT strategy, date, {t('equity','drawdown')} FROM bt_equity"),
    "backtest_metrics": st(f"SELECT strategy, win AS \"window\", periods, trade_count, {t(*COLS)} FROM bt_metrics"),
    "cost_scenarios": st(f"SELECT strategy, printf('%.6f', cost_bps) AS cost_bps, periods, trade_count, {t(*COLS)} FROM cost_metrics"),
    "macro_variants": st(deltas("mv", "method", V)),
    "macro_promotion": st(f"""SELECT strategy, active_rebalances, active_oos, promotion_label, {t('sharpe_delta','oos_sharpe_delta','oos_cagr_delta','oos_max_drawdown_delta')},
        CAST(row_number() OVER (ORDER BY CASE promotion_label WHEN 'candidate' THEN 0 WHEN 'needs more testing' THEN 1 ELSE 2 END, mv_promo.oos_sharpe_delta DESC, mv_promo.oos_cagr_delta DESC, mv_promo.sharpe_delta DESC, strategy) AS INTEGER) AS position FROM mv_promo"""),
    "block_sweep": st(f"""SELECT d.* EXCLUDE ("window"), c.* EXCLUDE (strategy, threshold), printf('%.6f', c.threshold) AS threshold, promotion_label FROM ({deltas('sw', 'method', D3)}) d
        JOIN sweep_counts c ON c.strategy = d.strategy JOIN sw_promo p ON p.strategy = d.strategy WHERE d."window" = 'out_of_sample'"""),
    "provider_deltas": st(deltas("pv", "adjusted", D3)),
    "acceptance_gates": st(f"SELECT gate, {t('value','threshold=CAST(threshold AS DOUBLE)')}, passed, bool_and(passed) OVER () AS all_passed FROM gates"),
    "simulation_summary": st(f"""SELECT min(as_of) AS start_date, max(as_of) AS end_date, count(DISTINCT as_of) AS rebalance_count, count(DISTINCT ticker) AS state_ticker_count,
        (SELECT count(DISTINCT ticker) FROM targets WHERE weight <> 0) AS selected_ticker_count, (SELECT transition_count FROM rate) AS transition_count,
        {r('rate_per_ticker_year=(SELECT rate_per_ticker_year FROM rate)')} FROM scored"""),
    "equity_combined": st(f"""SELECT g.strategy, g.date, {t('equity=c.equity')} FROM (SELECT strategy, date FROM (SELECT DISTINCT strategy FROM curves) s CROSS JOIN (SELECT DISTINCT date FROM curves) d) g
        ASOF JOIN curves c ON g.strategy = c.strategy AND g.date >= c.date"""),
    "split_date": st("""SELECT CASE WHEN a >= 20 AND b >= 20 THEN DATE '2001-10-01' WHEN a + b >= 40 THEN ds[least(greatest(CAST(floor((a + b) * 0.7) AS INTEGER), 20), CAST(a + b AS INTEGER) - 20) + 1] ELSE DATE '2001-10-01' END AS oos_start,
        CASE WHEN a >= 20 AND b >= 20 THEN 'configured' WHEN a + b >= 40 THEN 'fallback' ELSE 'thin' END AS rule, a AS in_sample_count, b AS oos_count
        FROM (SELECT list(as_of ORDER BY as_of) AS ds, count(*) FILTER (as_of < DATE '2001-10-01') AS a, count(*) FILTER (as_of >= DATE '2001-10-01') AS b FROM calendar)"""),
    "input_validation": st("""SELECT (SELECT count(*) FROM pbars WHERE price IS NULL OR isnan(price) OR price <= 0) AS bad_prices,
        (SELECT count(*) FROM (SELECT ticker, date FROM pbars GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_prices,
        2 * (SELECT count(*) FROM calendar WHERE day(as_of) = 7 AND as_of + 4000 NOT IN (SELECT date FROM pbars)) AS unknown_dates, (SELECT count(*) FROM calendar) AS unknown_tickers"""),
}
