"""Statements for provider lanes and report tables."""
from .scores import PILLARS
from tapelens.operators.scoring import NEUTRAL

from .parts import cte, r, state_case, statement as st, z

N = "CAST(substr(ticker, 7) AS INTEGER)"
cte("tape", """
    SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY ts, seq) AS pp FROM intraday WHERE price > 0 AND size > 0 AND correction = 0""")
cte("tape_sum", """
    SELECT ticker, coalesce(sum(price * size) FILTER ((size >= 50000 OR price * size >= 2000000) AND price > pp), 0) AS u,
           coalesce(sum(price * size) FILTER ((size >= 50000 OR price * size >= 2000000) AND price < pp), 0) AS d FROM tape GROUP BY 1""")
cte("etf", """
    SELECT ticker, as_of, CASE WHEN count(f) OVER w = 5 THEN sum(f) OVER w / aum * 100 END AS v FROM (
      SELECT *, (shares_outstanding - lag(shares_outstanding) OVER (PARTITION BY ticker ORDER BY as_of)) * nav AS f FROM shares_out WHERE aum <> 0)
    WINDOW w AS (PARTITION BY ticker ORDER BY as_of ROWS 4 PRECEDING)""")
cte("dark", """
    SELECT ticker, week, coalesce(sum(size) FILTER (l_linenumber % 3 = 0), 0) / sum(size) AS v FROM (SELECT *, date + CAST(8 - isodow(date) AS INTEGER) AS week FROM ticks)
    GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY week DESC) = 1""")
cte("short_m", """
    SELECT p_brand AS ticker, last_day(l_shipdate) AS settlement, sum(l_quantity) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
cte("short", f"""
    SELECT ticker, CASE WHEN {N} % 5 = 0 THEN 12.5 ELSE (pos - coalesce(CASE WHEN {N} % 5 = 1 THEN pos * 0.8 END, prev)) / coalesce(CASE WHEN {N} % 5 = 1 THEN pos * 0.8 END, prev) * 100 END AS v
    FROM (SELECT *, lag(pos) OVER w AS prev, row_number() OVER (PARTITION BY ticker ORDER BY settlement DESC) AS b FROM short_m WINDOW w AS (PARTITION BY ticker ORDER BY settlement)) WHERE b = 1""")
cte("filing", """
    SELECT ticker, (s - prev) / prev * 100 AS v FROM (
      SELECT *, lag(s) OVER (PARTITION BY ticker ORDER BY q) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY q DESC) AS b FROM (
        SELECT p_brand AS ticker, date_trunc('quarter', l_shipdate) AS q, sum(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE b = 1""")
cte("recent_dir", """
    SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, discount) AS pp FROM ticks""")
cte("recent_block", """
    SELECT ticker, CASE WHEN u = 0 AND d = 0 THEN NULL WHEN d = 0 THEN 2.0 ELSE u / d END AS v FROM (
      SELECT ticker, coalesce(sum(price * size) FILTER ((size >= 45 OR price * size >= 90000) AND price > pp), 0) AS u, coalesce(sum(price * size) FILTER ((size >= 45 OR price * size >= 90000) AND price < pp), 0) AS d FROM recent_dir GROUP BY 1)""")
cte("lastflow", "SELECT * FROM flow QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
cte("lastetf", "SELECT * FROM etf WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) = 1")
cte("lanes", f"""
    SELECT l.ticker, l.cmf21, l.obv_slope, l.rvol, e.v AS etf, b.v AS block, k.v AS dark, s.v AS short, f.v AS filing
    FROM lastflow l LEFT JOIN (SELECT * FROM lastetf WHERE {N} % 6 <> 0) e ON e.ticker = l.ticker LEFT JOIN recent_block b ON b.ticker = l.ticker
    LEFT JOIN dark k ON k.ticker = l.ticker LEFT JOIN (SELECT * FROM short WHERE {N} % 7 <> 0) s ON s.ticker = l.ticker LEFT JOIN filing f ON f.ticker = l.ticker""")
cte("fcomp", f"""
    SELECT ticker, coalesce(0.3 * zc + 0.2 * zo + 0.2 * ze + 0.1 * zb + 0.1 * zr - 0.1 * zs, 0.0) AS f FROM (
      SELECT ticker, {z('cmf21', '1')} AS zc, {z('obv_slope', '1')} AS zo, {z('etf', '1')} AS ze, {z('block', '1')} AS zb, {z('rvol', '1')} AS zr, {z('short', '1')} AS zs FROM lanes)""")
cte("lstate", "SELECT s.*, l.etf, l.block FROM last_scored s JOIN lanes l ON s.ticker = l.ticker")
cte("hev", """
    SELECT lane, ticker, ok, ts, CASE WHEN ok THEN 'live ok' WHEN k % 20 = 0 THEN 'fallback cache' ELSE 'neutral fallback' END AS mode FROM (
      SELECT event_type AS lane, printf('U%03d', user_id) AS ticker, CAST(json_extract(props, '$.k') AS INTEGER) AS k, ts,
             NOT (CAST(json_extract(props, '$.k') AS INTEGER) % 10 = 0 AND event_type <> 'view') AS ok FROM events)""")
cte("health", """
    SELECT *, CASE WHEN total_count > healthy_count THEN 'warning' ELSE 'healthy' END AS status,
           CASE WHEN warning_count > 0 THEN healthy_count || ' live ok / ' || warning_count || ' warning' ELSE healthy_count || ' live ok' END AS mode,
           concat_ws('; ', 'last completed ' || strftime(last_completed, '%Y-%m-%d %H:%M:%S') || ' UTC', healthy_count || ' live ok, ' || warning_count || ' warning across ' || total_count || ' tickers',
             'sample tickers: ' || samples, 'warnings: ' || bad) AS detail FROM (
      SELECT h.*, s.samples, e.events, e.bad, m.mode_counts, concat_ws(', ', CASE WHEN healthy_count > 0 THEN 'healthy=' || healthy_count END, CASE WHEN warning_count > 0 THEN 'warning=' || warning_count END) AS status_counts
      FROM (SELECT lane, count(*) AS total_count, count(*) FILTER (ok) AS healthy_count, count(*) FILTER (NOT ok) AS warning_count, max(ts) AS last_completed FROM hev GROUP BY 1) h
      JOIN (SELECT lane, string_agg(ticker, ', ' ORDER BY t, ticker) AS samples FROM (
              SELECT lane, ticker, min(ts) AS t FROM hev GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lane ORDER BY min(ts), ticker) <= 5) GROUP BY 1) s USING (lane)
      JOIN (SELECT lane, string_agg(ticker || ' ' || mode, '; ' ORDER BY ts, ticker, mode) AS events, string_agg(ticker || ' ' || mode, '; ' ORDER BY ts, ticker, mode) FILTER (mode <> 'live ok') AS bad FROM (
              SELECT * FROM hev QUALIFY row_number() OVER (PARTITION BY lane ORDER BY ts, ticker, mode) <= 5) GROUP BY 1) e USING (lane)
      JOIN (SELECT lane, string_agg(mode || '=' || n, ', ' ORDER BY mode) AS mode_counts FROM (SELECT lane, mode, count(*) AS n FROM hev GROUP BY 1, 2) GROUP BY 1) m USING (lane))""")
C = lambda c: f"coalesce({c}, 0)"
NOTE = {
    "exit": """[CASE WHEN NOT above_30wma THEN 'below 30wMA' END, CASE WHEN coalesce(cmf21, 0) < -0.05 THEN 'CMF ' || printf('%+.2f', cmf21) END, CASE WHEN rrg_quadrant = 'Lagging' THEN 'RRG Lagging' END]""",
    "warn": """[CASE WHEN rrg_quadrant = 'Weakening' THEN 'RRG Weakening' END, CASE WHEN breadth_50d < 0.5 THEN 'breadth ' || printf('%.0f%%', breadth_50d * 100) END, CASE WHEN coalesce(cmf21, 0) < 0 THEN 'CMF ' || printf('%+.2f', cmf21) END]""",
    "buy": """['S ' || printf('%+.2f', s_score), CASE WHEN coalesce(mom_12_1, 0) > 0 THEN 'mom +' || printf('%.0f%%', mom_12_1 * 100) END]""",
}
cte("acts", f"""
    SELECT kind, ticker, s_score, list_filter(CASE kind WHEN 'exit' THEN {NOTE['exit']} WHEN 'warn' THEN {NOTE['warn']} ELSE {NOTE['buy']} END, lambda x: x IS NOT NULL) AS l
    FROM (SELECT *, CASE WHEN state IN ('EXIT', 'BEARISH_STAGE_4') THEN 'exit' WHEN state = 'WARNING' THEN 'warn' WHEN state = 'STAGE_2_BULLISH' THEN 'buy' END AS kind FROM last_scored) WHERE kind IS NOT NULL""")
PC = """CAST(coalesce(mom_12_1, 0) > 0 AS INTEGER) + CAST(coalesce(faber, 0) = 1 AS INTEGER) + CAST(coalesce(stage, 0) = 2 AS INTEGER) + CAST(coalesce(antonacci, 0) = 1 AS INTEGER)
    + CAST(coalesce(rrg_quadrant IN ('Leading', 'Improving'), false) AS INTEGER) + CAST(coalesce(breadth_50d, 0) >= 0.5 AS INTEGER)"""
GATES = [
    ("checklist", [("Price is above the 30-week moving average", "coalesce(above_30wma, false)"), ("30-week moving average is rising", "coalesce(ma_slope_pos, false)"),
      ("Mansfield relative strength is positive", "coalesce(mansfield_rs > 0, false)"), ("RRG quadrant is Leading", "coalesce(rrg_quadrant = 'Leading', false)"), ("Breadth is at least 60%", "coalesce(breadth_50d >= 0.6, false)"),
      ("CMF21 is above +0.05", "coalesce(cmf21 > 0.05, false)"), ("ETF flow is non-negative", "true"), ("Hard flow veto is not active", "true")]),
    ("gates", [("RRG quadrant", "NOT coalesce(rrg_quadrant IN ('Lagging', 'Weakening'), false)"), ("Breadth >= 50%", "breadth_50d >= 0.5"), ("CMF stayed > 0", "cmf21 > 0"), ("No OBV divergence", "NOT obv_divergence"),
      ("ETF flow non-negative", "true"), ("Price > 30wMA", "above_30wma"), ("MA slope positive", "ma_slope_pos"), ("Mansfield RS > 0", "mansfield_rs > 0"), ("Antonacci > T-bill", "antonacci = 1")]),
    ("short", [("RRG not weakening", "NOT coalesce(rrg_quadrant IN ('Lagging', 'Weakening'), false)"), ("Breadth >= 50%", "coalesce(breadth_50d, 0) >= 0.5"), ("CMF stayed > 0", "coalesce(cmf21, 0) > 0"), ("Flow veto avoided", "true"),
      ("Close above 30wMA", "coalesce(above_30wma, false)"), ("Mansfield RS >= 0", "coalesce(mansfield_rs, 0) >= 0")]),
]
cte("sig", "SELECT ticker, coalesce(cmf21, 0.0) AS s FROM last_scored")
cte("outs", "SELECT ticker, greatest(0.05, abs(s)) AS m FROM sig WHERE s < 0 ORDER BY s, ticker LIMIT 10")
cte("ins", "SELECT ticker, greatest(0.05, abs(s)) AS m FROM sig WHERE s > 0 ORDER BY s DESC, ticker LIMIT 10")
cte("lane_tot", "SELECT (SELECT sum(m) FROM outs) AS o, (SELECT sum(m) FROM ins) AS i")
NEUTRAL_ORDER = list(NEUTRAL)
cte("lastrun", """
    SELECT 'Brand#' || (o_custkey % 25 + 1) AS ticker, o_orderkey % 5 AS k, arg_max(o_orderstatus = 'F', (o_orderdate, o_orderstatus = 'F')) AS f FROM orders GROUP BY 1, 2""")
LIVE = [("etf_flow_5d_pct", "etf", 0.0), ("block_up_ratio", "block", 1.0), ("dark_pool_pct", "dark", 0.4), ("si_delta_15d", "short", 0.0), ("thirteen_f_q", "filing", 0.0)]
SH = "o.m / greatest(t.o, 0.1) * n.m / greatest(t.i, 0.1)"

STATE_RANK = "CASE state WHEN 'BEARISH_STAGE_4' THEN 0 WHEN 'EXIT' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'STAGE_1_BASING' THEN 3 WHEN 'HOLD' THEN 4 WHEN 'STAGE_2_BULLISH' THEN 5 ELSE -1 END"
SORTS = {
    "S_score": "coalesce(s_score, 0)", "F_score": "coalesce(CAST(f_score AS DOUBLE), 0)", "mom_12_1": "coalesce(mom_12_1, 0)",
    "trend": "coalesce(mom_12_1, 0) * 100 * 0.84 + coalesce(mansfield_rs, 0) * 0.15",
    "pillar_sum": "round(" + " + ".join(f"coalesce({e}, 0.0)" for _, e in PILLARS) + ", 9)",
    "state": STATE_RANK, "ticker": "upper(ticker)", "identity": "upper(reverse(ticker) || ' ' || class)",
}
SQL = {
    "board_sorts": st(" UNION ALL ".join(
        f"SELECT '{k}' AS key, {str(d).lower()} AS descending, class, ticker, CAST(row_number() OVER (PARTITION BY class ORDER BY {e} {'DESC' if d else 'ASC'}, coalesce(s_score, 0) {'DESC' if d else 'ASC'}, upper(ticker) {'DESC' if d else 'ASC'}) AS INTEGER) AS peer_rank FROM last_scored"
        for k, e in SORTS.items() for d in (True, False))),
    "block_tape": st(f"SELECT ticker, {r('up_notional=u','down_notional=d','block_up_ratio=CASE WHEN u = 0 AND d = 0 THEN NULL WHEN d = 0 THEN 2.0 ELSE u / d END')} FROM tape_sum"),
    "tick_direction": st("SELECT ticker, seq, CAST(sign(price - pp) AS DOUBLE) AS direction FROM tape"),
    "etf_flow": st(f"SELECT ticker, as_of, {r('etf_flow_5d_pct=v')} FROM etf"),
    "dark_pool": st(f"SELECT ticker, week, {r('dark_pool_pct=v')} FROM dark"),
    "short_interest": st(f"SELECT ticker, {r('si_delta_15d=CAST(v AS DOUBLE)')} FROM short"),
    "thirteen_f": st(f"SELECT ticker, {r('thirteen_f_q=v')} FROM filing"),
    "flow_signals": st(f"SELECT ticker, {r('cmf21','obv_slope','rvol', *[f'{n}=coalesce({c}, {v}::DOUBLE)' for n, c, v in LIVE])}, {', '.join(f'{c} IS NOT NULL AS {n}_live' for n, c, v in LIVE)} FROM lanes"),
    "flow_signals_run": st(f"""SELECT ticker, {r(*[f'{n}=coalesce({c}, {v}::DOUBLE)' for n, c, v in LIVE])}, {', '.join(f"{c} IS NOT NULL AND coalesce((SELECT f FROM lastrun x WHERE x.ticker = lanes.ticker AND x.k = {NEUTRAL_ORDER.index(n)}), false) AS {n}_live" for n, c, v in LIVE)} FROM lanes"""),
    "flow_composite": st(f"SELECT ticker, {r('F_score=f')} FROM fcomp"),
    "lane_states": st(f"""SELECT ticker, {state_case('(etf IS NOT NULL)', 'etf', '(block IS NOT NULL)', 'block')} AS state,
        greatest(1, CAST(cmf21 >= 0.05 AS INTEGER), CAST(coalesce(etf, 0) >= 0 AS INTEGER), CAST(CASE WHEN coalesce(block, 1) BETWEEN 0 AND 1 THEN coalesce(block, 1) END >= 0.7 AS INTEGER)) = 1 AS confirmed FROM lstate"""),
    "provider_health": st("SELECT * EXCLUDE (bad) FROM health"),
    "provider_readiness": st("""SELECT c.lane, label, CASE WHEN stubbed THEN 'info' WHEN missing <> '' THEN 'warning' ELSE coalesce(h.status, 'healthy') END AS status,
        CASE WHEN stubbed THEN 'stubbed neutral' WHEN missing <> '' THEN 'missing ' || missing ELSE coalesce(h.mode, 'enabled') END AS mode,
        CASE WHEN NOT stubbed AND missing = '' THEN h.detail END AS detail
        FROM (VALUES ('click', 'Clicks', false, ''), ('view', 'Views', false, ''), ('error', 'Errors', true, ''), ('purchase', 'Purchases', false, 'API_KEY'), ('other', 'Other', false, '')) c(lane, label, stubbed, missing)
        LEFT JOIN health h ON h.lane = c.lane"""),
    "action_lists": st("""SELECT kind, ticker, CAST(row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'exit' THEN s_score ELSE -s_score END NULLS LAST, ticker) AS INTEGER) AS position,
        array_to_string(CASE WHEN len(l) > 0 THEN l[1:3] ELSE ['S ' || printf('%+.2f', s_score)] END, ' | ') AS note FROM acts"""),
    "full_table": st(f"SELECT ticker, state, {PC} AS pillar_count, {r('S_score=s_score')} FROM last_scored"),
    "class_board": st(f"""SELECT class, ticker, CAST(row_number() OVER (PARTITION BY class ORDER BY coalesce(s_score, 0) DESC, ticker DESC) AS INTEGER) AS peer_rank, count(*) OVER (PARTITION BY class) AS peers,
        {r('trend=coalesce(mom_12_1, 0) * 100 * 0.84 + coalesce(mansfield_rs, 0) * 0.15')},
        CASE WHEN s_score IS NULL THEN '?' WHEN s_score >= 1 THEN 'A' WHEN s_score >= 0 THEN 'B' WHEN s_score >= -1 THEN 'C' WHEN s_score >= -1.5 THEN 'D' ELSE 'F' END AS grade FROM last_scored"""),
    "comparison_basket": st("""SELECT ticker, tier, class, state FROM (SELECT *, CASE WHEN ticker = 'Brand#9' THEN 0 WHEN selected THEN 1 ELSE 2 END AS tier FROM last_scored)
        ORDER BY tier, CASE WHEN tier = 1 THEN rank_in_class END NULLS LAST, s_score DESC NULLS LAST, ticker LIMIT 6"""),
    "board_stats": st(f"""SELECT *, CASE WHEN average_s < 0 OR breadth < 0.45 OR risks > instruments * 0.4 THEN 'RISK-OFF' WHEN average_f < 0 OR breadth < 0.55 OR risks > 0 THEN 'NARROWING' ELSE 'RISK-ON' END AS phase FROM (
        SELECT count(*) AS instruments, count(*) FILTER (state IN ('EXIT', 'BEARISH_STAGE_4')) AS exits, count(*) FILTER (state = 'WARNING') AS warnings, count(*) FILTER (state IN ('WARNING', 'EXIT', 'BEARISH_STAGE_4')) AS risks,
        count(*) FILTER (state = 'STAGE_2_BULLISH') AS bullish, {r('average_s=avg(coalesce(s_score, 0))','average_f=CAST(0 AS DOUBLE)','breadth=avg(coalesce(breadth_50d, 0))','average_momentum=avg(coalesce(mom_12_1, 0) * 100)')}, count(*) FILTER (coalesce(cmf21, 0) < 0) AS negative_cmf FROM last_scored)"""),
    "flow_cards": st("SELECT class, CAST(0 AS DOUBLE) AS average_f, count(*) FILTER (state IN ('WARNING', 'EXIT', 'BEARISH_STAGE_4')) AS risks, count(*) AS members FROM last_scored GROUP BY 1"),
    "flow_extremes": st(f"""(SELECT 'outflow' AS side, ticker, {r('reading=coalesce(cmf21, 0)')} FROM last_scored ORDER BY coalesce(cmf21, 0), ticker LIMIT 5)
        UNION ALL (SELECT 'inflow', ticker, {r('reading=coalesce(cmf21, 0)')} FROM last_scored ORDER BY coalesce(cmf21, 0) DESC, ticker LIMIT 5)"""),
    "quadrant_cube": st("""SELECT CASE WHEN grouping(class) = 1 THEN 'All' ELSE class END AS class, CASE WHEN grouping(q) = 1 THEN 'All' ELSE q END AS quadrant, count(*) AS members
        FROM (SELECT class, coalesce(rrg_quadrant, 'Unknown') AS q FROM last_scored) GROUP BY CUBE (class, q)"""),
    "escalation": st(f"""SELECT ticker, {' + '.join(f'CAST(coalesce({c}, 0) >= 0 AS INTEGER)' for c in ('z1', 'z2', 'z3', 'z4', 'filters'))} + 2 AS supportive,
        concat_ws(', ', CASE WHEN NOT coalesce(above_30wma, false) THEN 'close < 30wMA' END, CASE WHEN mansfield_rs < 0 THEN 'Mansfield RS < 0' END, CASE WHEN cmf21 < -0.10 THEN 'CMF < -0.10' END, CASE WHEN rrg_quadrant = 'Lagging' THEN 'RRG Lagging' END) AS tripped FROM last_scored"""),
    "momentum_bars": st(f"""SELECT ticker, {r('momentum_pct=m','width=least(50.0, abs(m) / greatest(5.0, max(abs(m)) OVER ()) * 50)')} FROM (SELECT ticker, coalesce(mom_12_1, 0) * 100 AS m FROM last_scored ORDER BY 2 DESC, 1 LIMIT 16)"""),
    "leaders_risks": st(f"""(SELECT 'leader' AS side, ticker, {r('S_score=s_score')} FROM last_scored ORDER BY coalesce(last_scored.s_score, 0) DESC, ticker LIMIT 8)
        UNION ALL (SELECT 'risk', ticker, {r('S_score=s_score')} FROM last_scored ORDER BY coalesce(last_scored.s_score, 0), ticker LIMIT 8)"""),
    "snapshot_counts": st("""SELECT 'state' AS dimension, state AS label, count(*) AS members FROM last_scored GROUP BY 2 UNION ALL SELECT 'quadrant', coalesce(rrg_quadrant, 'Unknown'), count(*) FROM last_scored GROUP BY 2
        UNION ALL SELECT 'action', CASE WHEN state IN ('EXIT', 'BEARISH_STAGE_4') THEN 'EXIT' WHEN state = 'WARNING' THEN 'WATCH' WHEN state = 'STAGE_2_BULLISH' THEN 'BUY' END AS a, count(*) FROM last_scored
        WHERE state IN ('EXIT', 'BEARISH_STAGE_4', 'WARNING', 'STAGE_2_BULLISH') GROUP BY 2"""),
    "gate_rows": st(" UNION ALL ".join(f"SELECT ticker, '{n}' AS list, {i} AS position, '{label}' AS label, {e} AS ok FROM last_scored" for n, rows in GATES for i, (label, e) in enumerate(rows, 1))),
    "flow_lanes": st(f"SELECT o.ticker AS source, n.ticker AS target, {r(f'share={SH}', f'pressure={SH} * least(t.o, t.i)')} FROM outs o CROSS JOIN ins n CROSS JOIN lane_tot t"),
    "row_pressure": st(f"SELECT ticker, {r('pressure=coalesce(cmf21, 0) + coalesce(s_score, 0) * 0.35')} FROM last_scored"),
}
