"""Statements for bars, price indicators and flow indicators."""
from .parts import r, statement as st

SQL = {
    "bars_daily": st(f"SELECT ticker, date, {r('open','high','low','close','adj_close','volume')} FROM bars"),
    "bars_weekly": st(f"SELECT ticker, week_end, traded, {r('open','high','low','close','price','volume')} FROM weekly_spine"),
    "bars_monthly": st(f"""SELECT ticker, last_day(date) AS month_end, {r('open=arg_min(open, date)','high=max(high)','low=min(low)',
        'close=arg_max(close, date)','price=arg_max(price, date)','volume=sum(volume)')} FROM pbars GROUP BY 1, 2"""),
    "rebalance_calendar": st("SELECT week_end, max(date) AS as_of FROM pbars GROUP BY 1"),
    "momentum": st(f"SELECT ticker, date, {r('mom_12_1','return_1d','return_2d','return_5d')} FROM daily"),
    "breadth": st(f"SELECT ticker, date, {r('breadth_50d')} FROM daily"),
    "faber_signal": st("SELECT ticker, date, faber FROM faber"),
    "antonacci_signal": st("SELECT ticker, date, antonacci FROM antonacci"),
    "stage": st(f"""SELECT w.ticker, w.week_end, stage, above_30wma, ma_slope_pos, {r('sma30w','mansfield_rs')}
        FROM weekly w LEFT JOIN stage s ON w.ticker = s.ticker AND w.week_end = s.week_end"""),
    "rrg": st(f"""SELECT w.ticker, w.week_end, rrg_quadrant, {r('rs_ratio','rs_momentum')}
        FROM weekly w LEFT JOIN rrg s ON w.ticker = s.ticker AND w.week_end = s.week_end"""),
    "relative_strength_lines": st(f"""
        SELECT ticker, date, {r('line','latest')} FROM (
          SELECT ticker, date, line, arg_max(line, date) OVER (PARTITION BY ticker) AS latest, count(*) OVER (PARTITION BY ticker) AS n FROM (
            SELECT ticker, date, ratio / first_value(ratio) OVER (PARTITION BY ticker ORDER BY date) * 100 AS line FROM (
              SELECT a.ticker, a.date, a.price / nullif(b.price, 0) AS ratio,
                     row_number() OVER (PARTITION BY a.ticker ORDER BY a.date DESC) AS back
              FROM pbars a JOIN pbars b ON a.date = b.date AND b.ticker = 'Brand#1' AND a.ticker <> 'Brand#1') WHERE back <= 252))
        WHERE n >= 2"""),
    "weekly_chart": st(f"""
        SELECT ticker, week_end, {r('close=price','ma30w')}, price >= ma30w AS above_ma FROM (
          SELECT *, avg(price) OVER (PARTITION BY ticker ORDER BY week_end ROWS 29 PRECEDING) AS ma30w,
                 row_number() OVER (PARTITION BY ticker ORDER BY week_end DESC) AS back FROM weekly) WHERE back <= 104"""),
    "chart_relative_strength": st(f"""
        SELECT ticker, week_end, {r('rs_ratio','momentum_12w','momentum_52w',
            'slope_12=last_value(rs_ratio) OVER w12 - first_value(rs_ratio) OVER w12')} FROM (
          SELECT a.ticker, a.week_end,
                 a.price / b.price / first_value(a.price / b.price) OVER w * 100 AS rs_ratio,
                 a.price / lag(a.price, 12) OVER w - 1 AS momentum_12w, a.price / lag(a.price, 52) OVER w - 1 AS momentum_52w
          FROM weekly a JOIN weekly b ON a.week_end = b.week_end AND b.ticker = 'Brand#1' AND a.ticker <> 'Brand#1'
          WHERE a.price > 0 AND b.price > 0
          WINDOW w AS (PARTITION BY a.ticker ORDER BY a.week_end))
        WINDOW w12 AS (PARTITION BY ticker ORDER BY week_end ROWS 11 PRECEDING)"""),
    "cmf_obv_mfi": st(f"SELECT ticker, date, {r('cmf21','obv','obv_slope','mfi14','rvol')} FROM flow"),
    "dollar_flow": st(f"SELECT ticker, date, {r('net_flow_21d', digits=4)}, {r('ln_adv_20d=ln(adv_20d)')} FROM flow"),
    "distribution_days": st("SELECT ticker, date, dist_days_25, obv_divergence FROM flow"),
    "chart_flow": st(f"""
        SELECT ticker, date, {r('cmf21=sum(mfv) OVER w21 / nullif(sum(volume) OVER w21, 0)', 'obv',
          'obv_slope=CASE WHEN count(*) OVER w20 >= 2 THEN (obv - first_value(obv) OVER w20) / CASE WHEN avg(abs(obv)) OVER w20 = 0 THEN 1.0 ELSE avg(abs(obv)) OVER w20 END END')}
        FROM flow1 WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w21 AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)"""),
    "lookback_filter": st(f"""
        SELECT ticker, date, {r('price')} FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM pbars)
        WHERE date >= last - INTERVAL 6 MONTH"""),
    "visible_clip": st(f"SELECT ticker, date, {r('cmf21')} FROM flow WHERE date >= DATE '1999-06-01'"),
}
