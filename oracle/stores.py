"""Statements for bar store, feeds, snapshots, user files, journal and health."""
from . import boards  # noqa: F401  (its CTEs are reused)
from .parts import cte, r, statement as st

N = "CAST(substr(ticker, 7) AS INTEGER)"
cte("store", """
    SELECT *, CASE WHEN date < DATE '1999-01-01' THEN 'alpha' ELSE 'beta' END AS provider, CAST(date + 1 AS TIMESTAMP) AS updated_at FROM bars""")
cte("resent", f"SELECT ticker, date, close * 2 AS close FROM store WHERE {N} % 2 = 0 AND year(date) = 1999 AND day(date) <> 9")
cte("span", "SELECT ticker, min(date) AS lo, max(date) AS hi FROM resent GROUP BY 1")
cte("usable", """
    SELECT ticker, count(*) FILTER (date >= DATE '2000-01-01') AS row_count, min(date) AS first_date, max(date) FILTER (date >= DATE '2000-01-01') AS last_date,
           count(DISTINCT CASE WHEN date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30' AND isodow(date) < 6 THEN date END) AS covered FROM bars GROUP BY 1""")
cte("bdays", "SELECT count(*) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2001-06-30', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6")
cte("src", f"""
    SELECT ticker, provider, date, rank, source FROM (
      SELECT *, max(rank) OVER (PARTITION BY ticker) AS best FROM (
        SELECT ticker, provider, date, 0 AS rank, 'stale_cache' AS source FROM store WHERE {N} <= 20 AND date < DATE '1998-01-01'
        UNION ALL SELECT ticker, provider, date, 1, 'fresh_cache' FROM store WHERE {N} % 3 = 0 AND date < DATE '2000-01-01'
        UNION ALL SELECT ticker, provider, date, 2, 'live' FROM store WHERE {N} % 5 = 0)) WHERE rank = best""")
cte("snapst", """
    SELECT ticker, last_day(date) AS as_of, CAST(last_day(date) + 2 AS TIMESTAMP) AS captured_at, count(*) || ':' || printf('%.0f', sum(size)) AS payload FROM ticks GROUP BY 1, 2""")
cte("cover", f"""
    SELECT e.ticker, max(s.as_of) AS latest_as_of, max(s.captured_at) AS latest_captured_at, CASE WHEN count(s.as_of) > 0 THEN count(s.as_of) END AS snapshots, count(s.as_of) > 0 AS covered
    FROM (SELECT DISTINCT ticker FROM bars) e LEFT JOIN (SELECT * FROM snapst WHERE {N} % 4 <> 0) s ON s.ticker = e.ticker GROUP BY 1""")
cte("cache", """
    SELECT 'lane' || (o_orderkey % 3) AS lane, 'U' || (o_custkey % 200) AS ticker, o_orderdate AS created_at, o_orderkey || '|' || o_orderpriority AS payload, o_orderkey % 19 <> 0 AS intact FROM orders""")
cte("pairs", """
    SELECT w.lane, w.ticker, c.lane IS NOT NULL AS covered
    FROM (SELECT DISTINCT l.lane, 'U' || (c_custkey % 260) AS ticker FROM customer CROSS JOIN (VALUES ('lane0'), ('lane1'), ('lane2'), ('lane3')) l(lane)) w
    LEFT JOIN (SELECT DISTINCT lane, ticker FROM cache) c ON c.lane = w.lane AND c.ticker = w.ticker""")
ROW = "l_orderkey || '-' || l_partkey || '-' || l_suppkey"
cte("hfile", f"""
    SELECT {ROW} AS row_number, l_orderkey AS k, CASE WHEN l_orderkey % 23 = 0 OR l_orderkey % 29 = 0 THEN NULL ELSE 'BR' || (l_partkey % 25) END AS ticker,
           CASE WHEN l_orderkey % 31 <> 0 THEN l_quantity * 100 END AS shares, l_extendedprice AS market_value,
           CASE WHEN l_orderkey % 3 = 0 THEN l_quantity / 100 WHEN l_orderkey % 3 = 1 THEN CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END END AS weight, l_returnflag AS account
    FROM lineitem""")
cte("tfile", f"""
    SELECT {ROW} AS row_number, CASE WHEN l_orderkey % 3 <> 2 THEN CAST(l_shipdate AS DATE) END AS trade_date, 'BR' || (l_partkey % 25) AS ticker,
           CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' END AS side, l_quantity AS shares, l_extendedprice AS price, CASE WHEN l_orderkey % 4 = 0 THEN 1.25::DOUBLE ELSE 0.0::DOUBLE END AS fees
    FROM lineitem""")
cte("tokens", """
    SELECT l_orderkey AS list_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_partkey % 11) - 1 AS pos,
           CASE WHEN l_partkey % 11 = 0 THEN 'bad#' || (l_partkey % 7) ELSE 'q' || (l_partkey % 9) END AS token FROM lineitem""")
cte("jruns", "SELECT strftime(as_of, '%Y-%m-%d') AS run_id, * FROM scored")
cte("jrows", "SELECT o_orderkey AS run_id, max(o_orderdate) AS d FROM orders GROUP BY 1 ORDER BY d DESC, run_id DESC LIMIT 50")
cte("jdig", """
    SELECT run_id, count(*) AS n, list(upper(ticker) || '|' || class || '|' || state || '|' || concat_ws('|', s_score, f_score, mom_12_1, mansfield_rs, rs_ratio, rs_momentum, breadth_50d, cmf21, stage, selected) ORDER BY ticker) AS c FROM jruns GROUP BY 1""")
KIND = "CASE WHEN state IN ('EXIT', 'BEARISH_STAGE_4') THEN 'exit' WHEN state = 'WARNING' THEN 'warn' WHEN state = 'STAGE_2_BULLISH' THEN 'buy' END"
cte("jdec", f"""
    SELECT run_id, count({KIND}) AS n, coalesce(list(upper(ticker) || '|' || state ORDER BY ticker) FILTER ({KIND} IS NOT NULL), []) AS c FROM jruns GROUP BY 1""")
cte("jall", """
    SELECT g.run_id, '' AS p, g.n, d.n AS dn, g.c, d.c::VARCHAR AS dc, 'old' AS note FROM jdig g JOIN jdec d ON d.run_id = g.run_id WHERE g.run_id < '2000-01-01'
    UNION ALL SELECT g.run_id, 'again-', g.n, d.n, g.c, d.c::VARCHAR || CASE WHEN month(CAST(g.run_id AS DATE)) % 3 = 1 AND d.n > 0 THEN '!' ELSE '' END, CASE WHEN month(CAST(g.run_id AS DATE)) % 3 = 2 THEN 'new' ELSE 'old' END
    FROM jdig g JOIN jdec d ON d.run_id = g.run_id""")
AGE = lambda c: f"greatest(0, CAST(DATE '2001-11-05' - {c} AS BIGINT))"
LBL = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {AGE(c)} = 0 THEN 'today' ELSE {AGE(c)} || 'd old' END"
cte("hbar", "SELECT max(l) AS latest, min(l) AS oldest, count(l) AS loaded, count(*) AS expected FROM (SELECT ticker, max(date) AS l FROM bars GROUP BY 1)")
cte("hser", """
    SELECT v.series_id, fresh, max(m.date) AS l FROM (VALUES ('1-URGENT', 100), ('2-HIGH', 100), ('3-MEDIUM', 7), ('9-GONE', 7)) v(series_id, fresh) LEFT JOIN macro m ON m.series_id = v.series_id GROUP BY 1, 2""")
cte("hrows", f"""
    SELECT 'market_ohlcv' AS lane, CASE WHEN {AGE('oldest')} > 10 THEN 'stale' WHEN {AGE('oldest')} > 5 THEN 'warning' ELSE 'healthy' END AS status, latest, {LBL('latest')} AS freshness, loaded, expected, 'source mix beta ' || loaded AS detail FROM hbar
    UNION ALL SELECT 'macro', CASE WHEN count(l) = 0 THEN 'stale' WHEN count(*) FILTER ({AGE('l')} > fresh AND l IS NOT NULL) > 0 OR count(l) < count(*) THEN 'warning' ELSE 'healthy' END, max(l), {LBL('max(l)')}, count(l), count(*), count(*) FILTER ({AGE('l')} > fresh AND l IS NOT NULL) || ' of ' || count(l) || ' series past their age limit' FROM hser
    UNION ALL SELECT 'provider_flow', 'warning', NULL, 'derived from market lane', count(*) FILTER (s = 'healthy'), count(*), NULL FROM (
        SELECT CASE WHEN c.lane = 'error' THEN 'info' WHEN c.lane = 'purchase' THEN 'warning' ELSE coalesce(h.status, 'healthy') END AS s FROM (VALUES ('click'), ('view'), ('error'), ('purchase'), ('other')) c(lane) LEFT JOIN health h ON h.lane = c.lane)
    UNION ALL SELECT 'dashboard_compute', CASE WHEN m <= 60 THEN 'healthy' ELSE 'warning' END, CAST(t AS DATE), m || 'm old', 1, 1, strftime(t, '%Y-%m-%d %H:%M') FROM (
        SELECT max(o_orderdate) AS t, greatest(0, CAST(floor(epoch(TIMESTAMP '2001-08-02 00:45:00' - max(o_orderdate)) / 60) AS BIGINT)) AS m FROM orders)""")

SQL = {
    "bars_read": st(f"SELECT ticker, date, {r('close','volume', digits=10)} FROM bars WHERE ticker IN ('Brand#3', 'Brand#4', 'Brand#12') AND date >= DATE '2001-11-05' - 1095"),
    "bars_provenance": st("SELECT ticker, arg_max(provider, date) AS provider, max(updated_at) AS updated_at, count(*) AS rows FROM store GROUP BY 1"),
    "bars_upsert": st(f"""SELECT ticker, date, {r('close', digits=10)} FROM (SELECT s.ticker, s.date, s.close FROM store s LEFT JOIN span p ON s.ticker = p.ticker WHERE p.lo IS NULL OR s.date < p.lo OR s.date > p.hi
        UNION ALL SELECT ticker, date, close FROM resent)"""),
    "bars_unique": st(f"SELECT ticker, date, provider, {r('close=CASE WHEN month(date) = 3 THEN close + 1 ELSE close END', digits=10)} FROM store"),
    "bars_normalise": """SELECT l_suppkey AS ticker, count(*) AS rows, count(*) FILTER (l_linenumber <> 3) AS volumes, 0::BIGINT AS opens, count(*) AS same FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1""",
    "bars_usable": st("""SELECT ticker, row_count, first_date, last_date, covered, coalesce(row_count > 30 AND first_date <= DATE '2000-01-11' AND last_date >= DATE '2001-06-25' AND covered / (SELECT n FROM bdays) >= 0.75, false) AS usable FROM usable"""),
    "provider_records": st(f"SELECT event_type AS ticker, date_trunc('millisecond', ts) AS ts, {r('open=value','close=value')}, 100.0::DOUBLE AS volume FROM events WHERE event_id % 13 <> 0"),
    "wide_to_long": st(f"SELECT date, series_id AS ticker, {r('close=value', digits=5)} FROM macro"),
    "source_report": st("""SELECT e.ticker, coalesce(arg_max(s.source, s.date), 'missing') AS source, coalesce(arg_max(s.provider, s.date), 'none') AS provider FROM (SELECT DISTINCT ticker FROM bars) e LEFT JOIN src s ON s.ticker = e.ticker GROUP BY 1"""),
    "provider_mix": st("SELECT provider, count(DISTINCT ticker) AS tickers, count(*) AS rows FROM src GROUP BY 1"),
    "fund_records": st("""SELECT ticker, as_of, shares_outstanding, round(CAST(printf('%.9f', nav) AS DOUBLE), 6) + 0.0 AS nav,
        round(CASE WHEN month(as_of) % 2 = 1 THEN CAST(printf('%.12f', aum / 1e6) AS DOUBLE) * 1e6 ELSE CAST(printf('%.6f', aum) AS DOUBLE) END, 3) + 0.0 AS aum FROM shares_out"""),
    "fund_csv": st("""SELECT as_of, shares_outstanding, round(CAST(printf('%.9f', nav) AS DOUBLE), 6) + 0.0 AS nav, round(CAST(printf('%.6f', aum) AS DOUBLE), 3) + 0.0 AS aum FROM shares_out"""),
    "filing_table": "SELECT 'C' || l_partkey AS cusip, CAST(l_shipdate AS DATE) AS period, round(l_quantity, 6) + 0.0 AS shares FROM lineitem",
    "csv_artefact": st('SELECT as_of, ticker, "class", state, selected FROM scored'),
    "snapshot_upsert": st("""SELECT ticker, as_of, captured_at, payload, sha256(payload) AS payload_sha256 FROM (
        SELECT ticker, as_of, CASE WHEN month(as_of) <= 2 THEN CAST(as_of + 9 AS TIMESTAMP) ELSE captured_at END AS captured_at, CASE WHEN month(as_of) <= 2 THEN payload || ':r' ELSE payload END AS payload FROM snapst)"""),
    "snapshot_history": st("SELECT ticker, as_of, captured_at, payload FROM snapst WHERE ticker = 'Brand#7'"),
    "snapshot_coverage": st("SELECT * FROM cover"),
    "snapshot_state": st("""SELECT count(*) AS expected_ticker_count, count(*) FILTER (covered) AS covered_ticker_count, max(latest_as_of) AS latest_as_of, count(*) FILTER (NOT covered) AS missing_ticker_count,
        CASE WHEN count(*) FILTER (covered) = 0 THEN 'empty' WHEN count(*) FILTER (NOT covered) > 0 THEN 'incomplete' ELSE 'ready' END AS state FROM cover"""),
    "cache_fresh": st("SELECT lane, ticker, payload, CAST(greatest(0, epoch(TIMESTAMP '2001-08-02') - epoch(created_at)) AS BIGINT) AS age_seconds FROM cache WHERE intact AND epoch(TIMESTAMP '2001-08-02') - epoch(created_at) <= 2592000"),
    "cache_coverage": st("""SELECT CASE WHEN grouping(lane) = 1 THEN 'all' ELSE lane END AS lane, count(*) AS expected, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered) / count(*), 6) AS coverage_ratio FROM pairs GROUP BY ROLLUP (lane)"""),
    "cache_status": st("SELECT count(*) AS rows, max(created_at) AS latest_created_at, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS state FROM cache"),
    "holdings_ingest": st(f"SELECT row_number, ticker, account, {r('shares','market_value','weight')} FROM hfile WHERE ticker IS NOT NULL"),
    "holdings_errors": st("""SELECT row_number, CASE WHEN k % 23 = 0 THEN 'no ticker' ELSE 'ticker with characters outside the allowed set' END AS message FROM hfile WHERE ticker IS NULL
        UNION ALL SELECT row_number, 'shares is not a number' FROM hfile WHERE ticker IS NOT NULL AND shares IS NULL"""),
    "trades_ingest": st(f"SELECT row_number, trade_date, ticker, side, {r('shares','price','fees')} FROM tfile WHERE trade_date IS NOT NULL AND side IS NOT NULL"),
    "trades_errors": st("""SELECT message, count(*) AS rows, min(row_number) AS first_row FROM (SELECT row_number, 'not a date' AS message FROM tfile WHERE trade_date IS NULL
        UNION ALL SELECT row_number, 'neither a buy nor a sell' FROM tfile WHERE side IS NULL) GROUP BY 1"""),
    "ticker_lists": st("SELECT list_id, upper(token) AS symbol, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS times FROM tokens WHERE token NOT LIKE 'bad%' GROUP BY 1, 2"),
    "ticker_list_errors": st("SELECT list_id, CAST(pos AS INTEGER) AS pos, token, 'ticker with characters outside the allowed set' AS message FROM tokens WHERE token LIKE 'bad%'"),
    "journal_records": st("""SELECT run_id, upper(ticker) AS ticker, class AS asset_class, state, CAST((mom_12_1 IS NOT NULL)::INT + (mansfield_rs IS NOT NULL)::INT + (rs_ratio IS NOT NULL)::INT + (rs_momentum IS NOT NULL)::INT + (breadth_50d IS NOT NULL)::INT + (cmf21 IS NOT NULL)::INT AS INTEGER) AS pillars,
        CASE WHEN stage IS NOT NULL THEN 'selected,stage' ELSE 'selected' END AS payload_keys, CAST(stage AS VARCHAR) AS stage FROM jruns"""),
    "journal_new_runs": st("SELECT 'again-' || run_id AS run_id, n AS rows FROM jdig WHERE c NOT IN (SELECT c FROM jdig WHERE run_id < '2000-01-01')"),
    "journal_decisions": """SELECT l_orderkey AS run_id, 'bluf' AS decision_type, 'BR' || (l_partkey % 25) AS ticker, CASE l_returnflag WHEN 'R' THEN 'EXIT' WHEN 'A' THEN 'WATCH' ELSE 'REVIEW' END AS action,
        CASE WHEN l_partkey % 7 <> 2 THEN 'q' || CAST(l_quantity AS INTEGER) END AS rationale, CASE l_returnflag WHEN 'R' THEN 'exit' WHEN 'A' THEN 'warn' ELSE '' END AS kind,
        CASE l_returnflag WHEN 'R' THEN 'Out' WHEN 'N' THEN 'Rest' END AS label, CAST(NULL AS VARCHAR) AS eta, CASE l_returnflag WHEN 'A' THEN 'WARNING' END AS state
        FROM lineitem WHERE l_partkey % 7 > 1 AND l_orderkey % 17 <> 0""",
    "journal_runs": st("""SELECT p || run_id AS run_id, 'dashboard-' || replace(run_id, '-', '') || 'T000000Z' AS journal_stem, 'alpha' AS provider, n AS universe_count, n AS scores, dn AS decisions, note
        FROM (SELECT *, row_number() OVER (PARTITION BY c, dc, note ORDER BY p, run_id) AS k FROM jall) WHERE k = 1"""),
    "journal_read": st(f"""SELECT s.run_id, s.ticker, {r('s_score=s.q')}, d.action FROM (SELECT l_orderkey AS run_id, upper(p_brand) AS ticker, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) s
        JOIN jrows j ON j.run_id = s.run_id LEFT JOIN (SELECT DISTINCT l_orderkey AS run_id, upper(p_brand) AS ticker, 'EXIT' AS action FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') d ON d.run_id = s.run_id AND d.ticker = s.ticker"""),
    "data_health": st("SELECT *, CASE WHEN 'stale' IN (SELECT status FROM hrows) THEN 'Data stale' WHEN 'warning' IN (SELECT status FROM hrows) THEN 'Data warning' ELSE 'Data healthy' END AS summary FROM hrows"),
}
