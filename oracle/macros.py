"""Statements for the macro queries."""
from .parts import cte, r, statement as st

cte("macro_stats", """
    SELECT series_id, date, value, value - lag(value) OVER w AS delta, value / lag(value, 12) OVER w - 1 AS yoy,
           (value / lag(value, 12) OVER w - 1) * 100 AS yoy_pct,
           CASE WHEN row_number() OVER w >= 13 THEN avg(value) OVER (w ROWS 2 PRECEDING) - avg(value) OVER (w ROWS BETWEEN 11 PRECEDING AND 3 PRECEDING) END AS momentum,
           CASE WHEN row_number() OVER w >= 5 THEN value > lag(value, 3) OVER w END AS rising
    FROM macro WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
cte("macro_last", "SELECT * FROM macro_stats QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1")
cte("role_macro", """
    SELECT CASE series_id WHEN '1-URGENT' THEN 'INDPRO' WHEN '2-HIGH' THEN 'T10Y2Y' WHEN '3-MEDIUM' THEN 'T10Y3M' WHEN '4-NOT SPECIFIED' THEN 'NFCI' ELSE 'REC' END AS sid,
           date, CASE series_id WHEN '1-URGENT' THEN value WHEN '2-HIGH' THEN (value / 250000 - 1) * 100 + 3 WHEN '3-MEDIUM' THEN (value / 250000 - 1) * 100 + 3
                 WHEN '4-NOT SPECIFIED' THEN (value / 250000 - 1) * 20 ELSE abs(value / 250000 - 1) * 300 END AS value FROM macro""")
cte("role_stats", """
    SELECT *, value / lag(value, 12) OVER w - 1 AS yoy,
           CASE WHEN row_number() OVER w >= 13 THEN avg(value) OVER (w ROWS 2 PRECEDING) - avg(value) OVER (w ROWS BETWEEN 11 PRECEDING AND 3 PRECEDING) END AS mom
    FROM role_macro WINDOW w AS (PARTITION BY sid ORDER BY date)""")
cte("readings0", """
    SELECT date, max(yoy) FILTER (sid = 'INDPRO') AS indpro_yoy, max(mom) FILTER (sid = 'INDPRO') AS indpro_accel,
           max(value) FILTER (sid = 'T10Y2Y') AS curve_2s10s, max(value) FILTER (sid = 'T10Y3M') AS curve_3m10y,
           max(value) FILTER (sid = 'REC') AS recession_prob, max(value) FILTER (sid = 'NFCI') AS nfci FROM role_stats GROUP BY 1""")
cte("readings", "SELECT date, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (ORDER BY date) AS {c}" for c in ("indpro_yoy", "indpro_accel", "curve_2s10s", "curve_3m10y", "recession_prob", "nfci")) + " FROM readings0")
cte("phased", """
    SELECT r.*, coalesce(f.faber = 1, false) AS risk_on, curve_2s10s > 0 AS yield_curve_positive,
           CASE WHEN recession_prob > 25 OR indpro_yoy < -0.02 OR nfci > 0.5 THEN 'RECESSION'
                WHEN curve_2s10s < 0 OR curve_3m10y < 0 OR (indpro_accel < 0 AND coalesce(indpro_yoy, 0) > 0) THEN 'LATE'
                WHEN indpro_yoy > 0.03 AND indpro_accel > 0 AND (recession_prob IS NULL OR recession_prob < 5) THEN 'EARLY'
                WHEN indpro_yoy > 0 THEN 'MID' ELSE 'UNKNOWN' END AS phase
    FROM readings r ASOF LEFT JOIN (SELECT * FROM faber WHERE ticker = 'Brand#1' AND faber IS NOT NULL) f ON r.date >= f.date""")
DIM = """(VALUES ('1-URGENT', 'Growth', 'Urgent', 'index', true, true), ('2-HIGH', 'Rates', 'High', 'percent', false, false),
    ('3-MEDIUM', 'Liquidity', 'Medium', 'millions_usd', true, false), ('4-NOT SPECIFIED', 'Credit', 'Open', 'number', false, false),
    ('5-LOW', 'Liquidity', 'Low', 'billions_usd', true, true), ('6-NONE', 'FX', 'None', 'index', false, false)) d(series_id, "group", label, unit, higher_up, by_year)"""
cte("ctx", f"""
    SELECT d.*, l.value, l.date, by_year AND yoy_pct IS NOT NULL AS by_y, CASE WHEN by_year AND yoy_pct IS NOT NULL THEN yoy_pct ELSE l.delta END AS dd
    FROM {DIM} LEFT JOIN macro_last l ON d.series_id = l.series_id""")
cte("ctx2", """
    SELECT *, CASE WHEN value IS NULL THEN 'warn' WHEN dd IS NULL OR abs(dd) <= 0.0001 THEN 'flat' WHEN dd > 0 THEN CASE WHEN higher_up THEN 'up' ELSE 'warn' END
              ELSE CASE WHEN higher_up THEN 'down' ELSE 'up' END END AS tone FROM ctx""")
cte("rules", """
    SELECT * FROM (VALUES ('urgent_rising', '1-URGENT', 'rising', 0.0, 3, 30, 0.5), ('high_falling', '2-HIGH', 'falling', 2000.0, 1, 0, 0.0),
      ('medium_above', '3-MEDIUM', 'above', 252000.0, 1, 5, 0.25), ('low_flat', '5-LOW', 'flat', 4000.0, 2, 10, 0.75)) v(rule, series_id, condition, threshold, lookback, lag_days, multiplier)""")
cte("rule_values", """
    SELECT rule, CAST(date + lag_days AS DATE) AS date,
           coalesce(CASE condition WHEN 'rising' THEN value - prev > threshold WHEN 'falling' THEN value - prev < -threshold WHEN 'flat' THEN abs(value - prev) <= threshold ELSE value > threshold END, false) AS met
    FROM (SELECT r.*, m.date, m.value, CASE lookback WHEN 1 THEN lag(value, 1) OVER w WHEN 2 THEN lag(value, 2) OVER w ELSE lag(value, 3) OVER w END AS prev
          FROM macro m JOIN rules r ON m.series_id = r.series_id WINDOW w AS (PARTITION BY rule ORDER BY m.date))""")
cte("mask", """
    SELECT c.as_of, c.rule, coalesce(v.met, false) AS active
    FROM (SELECT as_of, rule FROM calendar CROSS JOIN rules) c ASOF LEFT JOIN rule_values v ON c.rule = v.rule AND c.as_of >= v.date""")
cte("last_bar", """
    SELECT * FROM (SELECT *, lag(price) OVER w AS prev, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM pbars
                   WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE back = 1""")
cte("proxy", "SELECT ticker, (price / prev - 1) * 100 AS p FROM last_bar")

SQL = {
    "macro_stats": st(f"SELECT series_id, date, rising, {r('value','delta','yoy','yoy_pct','momentum', digits=5)} FROM macro_stats"),
    "macro_latest": st(f"SELECT series_id, date, {r('value','delta','yoy','yoy_pct','momentum', digits=5)} FROM macro_last"),
    "macro_clean": st(f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, {r('value=last(o_totalprice ORDER BY o_orderkey, o_custkey, o_totalprice)')}
        FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1, 2"""),
    "macro_phase": st(f"""SELECT date, risk_on, yield_curve_positive, phase, CASE WHEN indpro_yoy IS NOT NULL OR indpro_accel IS NOT NULL THEN
            CASE WHEN phase <> 'UNKNOWN' THEN phase WHEN risk_on THEN 'MID' ELSE 'RECESSION' END
            ELSE CASE WHEN NOT risk_on THEN 'RECESSION' WHEN NOT yield_curve_positive THEN 'LATE' ELSE 'MID' END END AS phase_hint,
        {r('indpro_yoy','indpro_accel','curve_2s10s','curve_3m10y','recession_prob','nfci')} FROM phased"""),
    "macro_context": st("""SELECT series_id, "group", label, tone,
        CASE WHEN value IS NULL THEN 'DATA PENDING' WHEN unit = 'percent' THEN printf('%.2f%%', value) WHEN unit = 'millions_usd' THEN printf('%.2fT', value / 1e6)
             WHEN unit = 'billions_usd' THEN printf('%.2fT', value / 1e3) WHEN abs(value) >= 100000 THEN printf('%.0fK', value / 1000) ELSE printf('%.2f', value) END AS value_text,
        CASE WHEN dd IS NULL THEN '-' WHEN by_y THEN printf('%+.1f', dd) || '% YoY' ELSE printf('%+.2f', dd) || CASE WHEN unit = 'percent' THEN ' pp' ELSE '' END END AS change,
        CASE WHEN tone = 'up' THEN 'positive' WHEN tone IN ('warn', 'down') THEN 'negative' ELSE 'neutral' END AS sentiment_label,
        CASE WHEN dd IS NULL THEN 'data pending' WHEN abs(dd) <= 0.0001 THEN 'flat' WHEN (dd > 0) = higher_up THEN 'improving' ELSE 'worsening' END AS trend_label,
        CASE WHEN tone = 'up' THEN '+' WHEN tone IN ('warn', 'down') THEN '!' ELSE '=' END AS trend_symbol,
        CAST(CASE WHEN dd IS NULL OR abs(dd) <= 0.0001 THEN 50 ELSE round_even(least(100.0, 50 + abs(dd) * CASE WHEN by_y THEN 10.0 WHEN unit = 'percent' THEN 50.0 ELSE 1.0 END), 0) END AS INTEGER) AS gauge_pct
        FROM ctx2"""),
    "macro_snapshot": st("""SELECT string_agg(series_id || ':' || label || ':' || strftime(date, '%Y-%m-%d') || ':' || printf('%.2f', value), ';' ORDER BY series_id) AS snapshot,
        CAST(count(*) AS INTEGER) AS series FROM ctx WHERE value IS NOT NULL"""),
    "macro_pseudo_bars": st(f"SELECT series_id AS ticker, date, {r('open=value * 0.01','high=value * 0.01','low=value * 0.01','close=value * 0.01','adj_close=value * 0.01')}, CAST(0 AS DOUBLE) AS volume FROM macro"),
    "market_proxies": st(f"""SELECT ticker, {r('change_pct=p')}, CASE WHEN abs(p) <= 0.0001 THEN 'flat' WHEN p > 0 THEN 'up' ELSE 'down' END AS tone,
        CASE WHEN abs(p) <= 0.0001 THEN 'neutral' WHEN p > 0 THEN 'positive' ELSE 'negative' END AS sentiment_label,
        CASE WHEN abs(p) <= 0.0001 THEN 'flat' WHEN p > 0 THEN 'improving' ELSE 'worsening' END AS trend_label,
        CASE WHEN abs(p) <= 0.0001 THEN '=' WHEN p > 0 THEN '+' ELSE '!' END AS trend_symbol,
        CAST(CASE WHEN abs(p) <= 0.0001 THEN 50 ELSE round_even(least(100.0, 50 + abs(p) * 4), 0) END AS INTEGER) AS gauge_pct FROM proxy"""),
    "session_range": st(f"""SELECT ticker, {r('position')}, CASE WHEN position >= 0.75 THEN 'up' WHEN position <= 0.25 THEN 'down' ELSE 'flat' END AS tone,
        CASE WHEN flat THEN 'flat range' WHEN position >= 0.75 THEN 'close near high' WHEN position <= 0.25 THEN 'close near low' ELSE 'close mid range' END AS subtitle,
        CASE WHEN position >= 0.75 THEN 'buying pressure' WHEN position <= 0.25 THEN 'selling pressure' ELSE 'balanced' END AS trend_label,
        CAST(round_even(position * 100, 0) AS INTEGER) AS gauge_pct
        FROM (SELECT ticker, high - low <= 1e-9 * greatest(abs(high), abs(low)) AS flat,
                     CASE WHEN high - low <= 1e-9 * greatest(abs(high), abs(low)) THEN 0.5 ELSE (price - low) / (high - low) END AS position FROM last_bar)"""),
    "yield_curve_sign": st("SELECT arg_max(price, date) FILTER (ticker = 'Brand#3') > arg_max(price, date) FILTER (ticker = 'Brand#4') AS curve_positive FROM pbars"),
    "macro_mask": st("SELECT as_of, rule, active FROM mask"),
}
