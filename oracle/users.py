"""Statements for debrief, holdings, trades and watch lists."""
from .parts import cte, r, statement as st

cte("numbered", "SELECT upper(ticker) AS ticker, date, price, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM pbars")
cte("dstart", """
    SELECT d.run_id, upper(d.ticker) AS ticker, d.action, CAST(d.started_at AS DATE) AS rd, b.date AS start_date, b.price AS start_price, b.n
    FROM decisions d ASOF LEFT JOIN numbered b ON upper(d.ticker) = b.ticker AND CAST(d.started_at AS DATE) <= b.date""")
cte("hz", "SELECT * FROM (VALUES ('1w', 5), ('4w', 20), ('13w', 65), ('26w', 130)) v(horizon, days)")
cte("starts", "SELECT DISTINCT ticker, n FROM dstart WHERE n IS NOT NULL")
cte("dd", """
    SELECT ticker, n, horizon, min(price / pk - 1) AS mdd FROM (
      SELECT s.ticker, s.n, h.horizon, b.price, max(b.price) OVER (PARTITION BY s.ticker, s.n, h.horizon ORDER BY b.n) AS pk
      FROM starts s CROSS JOIN hz h JOIN numbered b ON b.ticker = s.ticker AND b.n BETWEEN s.n AND s.n + h.days) GROUP BY 1, 2, 3""")
cte("outc", """
    SELECT d.run_id, d.ticker, d.action, h.horizon, h.days, d.start_date, e.date AS end_date, d.start_price, e.price AS end_price, e.price / d.start_price - 1 AS forward_return,
           CASE WHEN e.date IS NOT NULL THEN dd.mdd END AS max_drawdown,
           CASE WHEN d.ticker NOT IN (SELECT ticker FROM numbered) THEN 'missing_ticker' WHEN d.start_date IS NULL THEN 'no_baseline' WHEN e.date IS NULL THEN 'insufficient_history' ELSE 'available' END AS status,
           CASE WHEN d.action IN ('BUY', 'HOLD') THEN e.price / d.start_price - 1 > 0 ELSE e.price / d.start_price - 1 <= 0 END AS hit
    FROM dstart d CROSS JOIN hz h LEFT JOIN numbered e ON e.ticker = d.ticker AND e.n = d.n + h.days
    LEFT JOIN dd ON dd.ticker = d.ticker AND dd.n = d.n AND dd.horizon = h.horizon""")
cte("cond", """
    SELECT d.run_id, d.series_id, CASE WHEN delta IS NOT NULL THEN CASE WHEN abs(delta) <= 0.0001 THEN 'flat' WHEN delta > 0 THEN 'rising' ELSE 'falling' END
             WHEN yoy_pct IS NOT NULL THEN 'yoy' ELSE 'level_available' END AS condition
    FROM decisions d JOIN macro_stats m ON m.series_id = d.series_id AND m.date = CAST(date_trunc('month', d.started_at) AS DATE)""")
cte("hold_w", """
    SELECT h.*, CASE WHEN count(*) FILTER (weight >= 0) OVER w = count(*) OVER w AND sum(weight) OVER w > 0 THEN weight / sum(weight) OVER w
                     WHEN count(*) FILTER (market_value > 0) OVER w = count(*) OVER w AND sum(market_value) OVER w > 0 THEN market_value / sum(market_value) OVER w
                     ELSE 1.0 / count(*) OVER w END AS aw FROM holdings h WINDOW w AS (PARTITION BY account)""")
cte("hold_a", """
    SELECT h.account, upper(h.ticker) AS ticker, h.aw, s.state, s.class AS asset_class, s.s_score, s.rank_in_class, s.selected, s.ticker IS NULL AS missing,
           CASE WHEN s.state IN ('EXIT', 'BEARISH_STAGE_4') THEN 'exit' WHEN s.state = 'WARNING' THEN 'warning' WHEN s.state = 'STAGE_2_BULLISH' THEN 'bullish' END AS action
    FROM hold_w h LEFT JOIN last_scored s ON upper(h.ticker) = upper(s.ticker)""")
cte("last_close", "SELECT upper(ticker) AS ticker, arg_max(close, date) AS price FROM pbars WHERE ticker NOT IN ('Brand#5', 'Brand#8') GROUP BY 1")
cte("pnl0", """
    SELECT account, upper(h.ticker) AS ticker, CASE WHEN account % 11 <> 0 THEN shares END AS shares, cost_basis, market_value, price
    FROM holdings h LEFT JOIN last_close c ON upper(h.ticker) = c.ticker""")
cte("pnl", """
    SELECT *, CASE WHEN status = 'OK' THEN shares * cost_basis END AS cost, CASE WHEN status = 'OK' THEN coalesce(shares * price, market_value) END AS current_value FROM (
      SELECT *, CASE WHEN shares IS NULL THEN 'shares missing' WHEN price IS NULL AND market_value IS NULL THEN 'current price missing' ELSE 'OK' END AS status FROM pnl0)""")
cte("aligned", """
    SELECT t.*, s.as_of AS state_date, s.state, CASE WHEN s.state IS NULL THEN 'NO_METHOD_STATE'
      WHEN (side = 'BUY' AND s.state IN ('STAGE_2_BULLISH', 'HOLD')) OR (side = 'SELL' AND s.state IN ('WARNING', 'EXIT', 'BEARISH_STAGE_4')) THEN 'ALIGNED' ELSE 'AGAINST_METHOD' END AS alignment
    FROM trades t ASOF LEFT JOIN scored s ON t.ticker = s.ticker AND t.trade_date >= s.as_of""")
cte("lists", """
    SELECT s_nationkey AS list_id, p_brand AS ticker, min(l_orderkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2 UNION ALL SELECT DISTINCT s_nationkey, 'BRAND-X', -1 FROM supplier""")
cte("custom", """
    SELECT l.list_id, l.ticker, l.pos, s.ticker IS NULL AS missing, CASE WHEN s.ticker IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY l.list_id ORDER BY s.ticker IS NULL, s.s_score IS NULL, s.s_score DESC, l.pos) AS INTEGER) END AS custom_rank,
           s.state, s.class AS asset_class, s.s_score, CASE WHEN s.state IN ('EXIT', 'BEARISH_STAGE_4') THEN 'exit' WHEN s.state = 'WARNING' THEN 'warning' WHEN s.state = 'STAGE_2_BULLISH' OR s.selected THEN 'bullish' END AS action
    FROM lists l LEFT JOIN last_scored s ON l.ticker = s.ticker""")
OK = "forward_return IS NOT NULL"
SQL = {
    "debrief_outcomes": st(f"""SELECT run_id, ticker, action, horizon, days, status, start_date, end_date, hit, {r('start_price','end_price', digits=10)}, {r('forward_return','max_drawdown')} FROM outc"""),
    "debrief_summary": st(f"""SELECT action, horizon, count(*) AS decision_count, count(*) FILTER ({OK}) AS available_count,
        {r(f'hit_rate=CASE WHEN count(*) FILTER ({OK}) > 0 THEN count(*) FILTER ({OK} AND hit) / count(*) FILTER ({OK}) END', 'average_forward_return=avg(forward_return)')} FROM outc GROUP BY 1, 2"""),
    "debrief_macro": st(f"""SELECT series_id, condition, action, count(*) AS decision_count, count(*) FILTER ({OK}) AS available_count,
        {r(f'hit_rate=count(*) FILTER ({OK} AND hit) / count(*) FILTER ({OK})', 'average_forward_return=avg(forward_return)', 'average_max_drawdown=avg(max_drawdown)')}
        FROM (SELECT o.*, c.series_id, c.condition FROM outc o JOIN cond c ON o.run_id = c.run_id WHERE horizon = '4w') GROUP BY 1, 2, 3 HAVING count(*) FILTER ({OK}) > 0"""),
    "debrief_review": st(f"SELECT run_id, ticker, action, horizon, {r('forward_return')} FROM outc WHERE horizon = '4w' AND NOT hit AND abs(forward_return) >= 0.5"),
    "debrief_scores": st(f"""SELECT strftime(d.started_at, '%Y-%m-%d') AS run_id, d.run_id AS decision_id, upper(d.ticker) AS ticker, d.action, s.state, {r('s_score')}
        FROM decisions d LEFT JOIN scored s ON s.as_of = CAST(d.started_at AS DATE) AND s.ticker = d.ticker"""),
    "holdings_analysis": st(f"SELECT account, ticker, state, asset_class, rank_in_class, selected, missing, action, {r('analysis_weight=aw','s_score')} FROM hold_a"),
    "holdings_exposure": st(f"""SELECT account, dimension, label, count(*) AS positions, {r('weight=sum(aw)')} FROM (
        SELECT account, 'state' AS dimension, CASE WHEN missing THEN 'MISSING' ELSE coalesce(state, 'UNKNOWN') END AS label, aw FROM hold_a
        UNION ALL SELECT account, 'class', CASE WHEN missing THEN 'MISSING' ELSE coalesce(asset_class, 'UNKNOWN') END, aw FROM hold_a) GROUP BY 1, 2, 3"""),
    "pnl_positions": st(f"SELECT account, ticker, status, {r('cost','current_value','unrealized_pnl=current_value - cost', digits=3)}, {r('unrealized_pct=(current_value - cost) / cost')} FROM pnl"),
    "pnl_rollup": st(f"""SELECT CASE WHEN grouping(account) = 1 THEN 'all' ELSE CAST(account AS VARCHAR) END AS scope, {r('total_cost=coalesce(sum(cost), 0.0)','total_value=coalesce(sum(current_value), 0.0)','unrealized_pnl=coalesce(sum(current_value), 0.0) - coalesce(sum(cost), 0.0)', digits=3)},
        {r('unrealized_pct=CASE WHEN sum(cost) > 0 THEN (sum(current_value) - sum(cost)) / sum(cost) END')}, count(*) FILTER (status <> 'OK') AS missing_count FROM pnl GROUP BY ROLLUP (account)"""),
    "asof_trades": st("SELECT upper(ticker) AS ticker, trade_date, side, state_date, state, alignment, count(*) AS trades FROM aligned GROUP BY 1, 2, 3, 4, 5, 6"),
    "trade_alignment": st(f"""SELECT CASE WHEN grouping(side) = 1 THEN 'ALL' ELSE side END AS side, count(*) AS trades, count(*) FILTER (alignment = 'ALIGNED') AS aligned, count(*) FILTER (alignment = 'AGAINST_METHOD') AS against,
        count(*) FILTER (alignment = 'NO_METHOD_STATE') AS unavailable, {r("aligned_rate=count(*) FILTER (alignment = 'ALIGNED') / count(*)")} FROM aligned GROUP BY ROLLUP (side)"""),
    "custom_universe": st(f"SELECT list_id, ticker, pos, missing, custom_rank, state, asset_class, action, {r('s_score')} FROM custom"),
    "universe_counts": st("""SELECT list_id, dimension, label, count(*) AS members FROM (
        SELECT list_id, 'class' AS dimension, CASE WHEN missing THEN 'MISSING' ELSE coalesce(asset_class, 'UNKNOWN') END AS label FROM custom
        UNION ALL SELECT list_id, 'state', CASE WHEN missing THEN 'MISSING' ELSE coalesce(state, 'UNKNOWN') END FROM custom) GROUP BY 1, 2, 3"""),
}
