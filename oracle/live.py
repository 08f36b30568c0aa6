"""Statements for scores with live lanes."""
from . import backtests, boards  # noqa: F401  (their CTEs are reused)
from .parts import cte, r, state_case, statement as st, z

N = "CAST(substr(ticker, 7) AS INTEGER)"
cte("lv_short", f"""
    SELECT ticker, settlement AS d, CASE WHEN {N} % 5 = 0 THEN 12.5 ELSE (pos - p) / nullif(p, 0) * 100 END AS v FROM (
      SELECT *, coalesce(CASE WHEN {N} % 5 = 1 THEN pos * 0.8 END, lag(pos) OVER (PARTITION BY ticker ORDER BY settlement)) AS p FROM short_m)""")
cte("lv0", """
    SELECT s.*, e.v AS etf, b.ratio AS block, h.v AS short FROM snap s
    ASOF LEFT JOIN (SELECT * FROM etf WHERE v IS NOT NULL) e ON e.ticker = s.ticker AND s.as_of >= e.as_of
    ASOF LEFT JOIN (SELECT * FROM month_ratio WHERE ratio IS NOT NULL) b ON b.ticker = s.ticker AND s.as_of >= b.month
    ASOF LEFT JOIN (SELECT * FROM lv_short WHERE v IS NOT NULL) h ON h.ticker = s.ticker AND s.as_of >= h.d""")
P = "as_of"
cte("lv1", f"""
    SELECT *, coalesce(0.3 * zc + 0.2 * zo + 0.2 * ze + 0.1 * zb + 0.1 * zr - 0.1 * zs, 0.0) AS f_score FROM (
      SELECT *, {z('cmf21', P)} AS zc, {z('obv_slope', P)} AS zo, {z('etf', P)} AS ze, {z('block', P)} AS zb, {z('rvol', P)} AS zr, {z('short', P)} AS zs FROM lv0)""")
C = "as_of, class"
cte("lv2", f"""
    SELECT *, {z('mom_12_1', C)} AS z1, {z('mansfield_rs', C)} AS z2, {z('rs_ratio', C)} AS z3, {z('rs_momentum', C)} AS z4, {z('f_score', C)} AS fz,
           (coalesce(faber, 0) + CASE WHEN stage = 2 THEN 1 ELSE 0 END + coalesce(antonacci, 0)) / 3.0 AS filters
    FROM lv1 WHERE class <> 'Benchmark'""")
cte("lv3", "SELECT *, 0.22 * z1 + 0.12 * z2 + 0.15 * z3 + 0.08 * z4 + 0.12 * filters + 0.23 * fz AS s, coalesce(round(fz, 9) < -0.5, false) AS veto FROM lv2")
cte("lv4", "SELECT *, CASE WHEN veto THEN -9.99 ELSE s END AS sv FROM lv3")
cte("lv", f"""
    SELECT *, CASE WHEN sv IS NOT NULL THEN rank() OVER (PARTITION BY as_of, class ORDER BY sv DESC NULLS LAST) END AS rk,
           {state_case('(etf IS NOT NULL)', 'etf', '(block IS NOT NULL)', 'block')} AS state FROM lv4""")
cte("lv_last", "SELECT * FROM lv WHERE as_of = (SELECT max(as_of) FROM lv)")
SQL = {
    "live_composite": st(f"""SELECT as_of, ticker, class, {r('S_score=s', 'F_score=f_score', 'flow_z=fz', 'S_score_after_veto=sv')}, veto, rk AS rank_in_class, coalesce(rk <= 2, false) AS selected FROM lv"""),
    "live_states": st("SELECT as_of, ticker, state FROM lv"),
    "live_vetoes": st("SELECT class, count(*) FILTER (veto) AS vetoed, count(*) AS rows FROM lv GROUP BY 1"),
    "live_flow_extremes": st(f"""SELECT side, ticker, {r('reading')} FROM (
        (SELECT 'outflow' AS side, ticker, coalesce(f_score, 0) AS reading FROM lv_last ORDER BY coalesce(f_score, 0), ticker LIMIT 5) UNION ALL
        (SELECT 'inflow', ticker, coalesce(f_score, 0) FROM lv_last ORDER BY coalesce(f_score, 0) DESC, ticker LIMIT 5))"""),
}
