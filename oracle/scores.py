"""Statements for composite, states and transitions."""
from tapelens.operators.scoring import baseline_configuration, canonical_json
from tapelens.sources.tables import BENCH, CASH, TOP_PER_CLASS

from .parts import cte, r, state_case, statement as st, z

#: The configuration's JSON text; its hash with the universe is DuckDB's own.
CONFIG = canonical_json(baseline_configuration({f"C{i}": TOP_PER_CLASS for i in range(4)}, BENCH, CASH)).replace("'", "''")
HEX = "sum(CAST('0x' || substr(h, {i}, 12) AS BIGINT))"

cte("stored", """
    SELECT ticker, CASE s WHEN 'F' THEN 'EXIT' WHEN 'O' THEN 'HOLD' ELSE '' END AS state, updated FROM (
      SELECT 'Brand#' || (o_custkey % 25 + 1) AS ticker, last(o_orderstatus ORDER BY o_orderdate, o_orderkey, o_custkey, o_orderstatus) AS s,
             max(o_orderdate) AS updated FROM orders WHERE o_orderdate <= TIMESTAMP '2001-01-02' GROUP BY 1)""")
USE = """coalesce(epoch(TIMESTAMP '2001-01-02') - epoch(t.updated) BETWEEN 0 AND 302400 AND t.state <> '' AND t.state <> s.state, false)"""
PB = """CASE WHEN state = 'STAGE_2_BULLISH' THEN concat_ws('; ',
    CASE WHEN return_1d <= -0.010 THEN printf('1-session return %+.2f%% is at/below -1.00%%', return_1d * 100) END,
    CASE WHEN return_2d <= -0.015 THEN printf('2-session return %+.2f%% is at/below -1.50%%', return_2d * 100) END,
    CASE WHEN return_5d <= -0.035 THEN printf('5-session return %+.2f%% is at/below -3.50%%', return_5d * 100) END) ELSE '' END"""
NUM = {c: f"coalesce({c}, 0)" for c in ("cmf21", "mansfield_rs", "dist_days_25")}
PILLARS = [("MOM", "0.22 * z1"), ("MANS", "0.12 * z2"), ("RS-R", "0.15 * z3"), ("RS-M", "0.08 * z4"), ("FILT", "0.12 * filters"),
           ("CYC", "0.0"), ("FLOW", "0.0")]
DISPLAY = {
    "mom_12_1": "mom_12_1", "mansfield_rs": "mansfield_rs / 100", "rs_ratio": "(rs_ratio - 100) / 30",
    "rs_momentum": "(rs_momentum - 100) / 30", "breadth_50d": "(breadth_50d - 0.5) * 2", "cmf21": "cmf21 / 0.25",
}
CL = {k: f"CASE WHEN {k} IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, {v})) END" for k, v in DISPLAY.items()}
RAW = " + ".join(CL.values())
cte("adhoc", f"""
    SELECT *, 0.22 * z1 + 0.12 * z2 + 0.15 * z3 + 0.08 * z4 + 0.12 * filters AS s FROM (
      SELECT *, {z('mom_12_1', 'as_of')} AS z1, {z('mansfield_rs', 'as_of')} AS z2, {z('rs_ratio', 'as_of')} AS z3, {z('rs_momentum', 'as_of')} AS z4,
             (coalesce(faber, 0) + CASE WHEN stage = 2 THEN 1 ELSE 0 END + coalesce(antonacci, 0)) / 3.0 AS filters
      FROM snap WHERE as_of = (SELECT max(as_of) FROM snap) AND ticker NOT IN ('Brand#1', 'Brand#2'))""")

SQL = {
    "snapshot_indicators": st(f"""SELECT as_of, ticker, class, faber, stage, above_30wma, ma_slope_pos, antonacci, rrg_quadrant, dist_days_25, obv_divergence,
        {r('mom_12_1','return_5d','mansfield_rs','rs_ratio','rs_momentum','breadth_50d','cmf21','obv_slope','mfi14','rvol')} FROM snap"""),
    "composite_rank": st(f"""SELECT as_of, ticker, class, {r('S_score=s_score','F_score=CAST(f_score AS DOUBLE)','S_score_after_veto=s_score')}, false AS veto,
        rank_in_class, selected FROM scored"""),
    "states": st("SELECT as_of, ticker, state FROM scored"),
    "pullback_display": st(f"""SELECT as_of, ticker, reason <> '' AS pullback_risk, reason AS pullback_risk_reason,
        CASE WHEN reason <> '' THEN 'Stage 2, Pullback Risk' ELSE replace(state, '_', ' ') END AS state_display_label
        FROM (SELECT *, {PB} AS reason FROM scored)"""),
    "state_reasons": st(f"""SELECT ticker, state, array_to_string(CASE WHEN len(l) > 0 THEN l[1:4] ELSE ['No gate has triggered.'] END, ' | ') AS reasons
      FROM (SELECT *, list_filter([
        CASE WHEN state = 'STAGE_2_BULLISH' AND reason <> '' THEN 'Uptrend holds; pullback risk from ' || reason || '.'
             WHEN state = 'STAGE_2_BULLISH' THEN 'Uptrend confirmed, no gate against it.' END,
        CASE WHEN state = 'WARNING' THEN 'A warning gate has triggered.' END,
        CASE WHEN state = 'EXIT' THEN 'Trend or relative strength has broken.' END,
        CASE WHEN state = 'BEARISH_STAGE_4' THEN 'Downtrend: price and average both fall.' END,
        CASE WHEN state = 'STAGE_1_BASING' THEN 'Still basing, no uptrend yet.' END,
        CASE WHEN rrg_quadrant = 'Weakening' THEN 'Rotation: weakening leader.' END,
        CASE WHEN rrg_quadrant = 'Lagging' THEN 'Rotation: laggard in strength and momentum.' END,
        CASE WHEN coalesce(cmf21, 0) < 0 THEN printf('Money leaves (CMF %+.2f).', cmf21) END,
        CASE WHEN obv_divergence THEN 'Volume does not follow price (OBV).' END,
        CASE WHEN dist_days_25 >= 4 THEN printf('Distribution days: %.0f.', CAST(dist_days_25 AS DOUBLE)) END,
        CASE WHEN NOT above_30wma THEN 'Price under its 30-week average.' END,
        CASE WHEN coalesce(mansfield_rs, 0) < 0 THEN printf('Mansfield strength %+.2f is negative.', mansfield_rs) END], lambda x: x IS NOT NULL) AS l
        FROM (SELECT *, {PB} AS reason FROM last_scored))"""),
    "contributions": st(" UNION ALL ".join(
        f"SELECT as_of, ticker, '{n}' AS pillar, {r(f'contribution=coalesce({e}, 0.0)')} FROM scored" for n, e in PILLARS)),
    "display_contributions": st(" UNION ALL ".join(
        f"SELECT as_of, ticker, '{k}' AS pillar, " + r(f"contribution=CASE WHEN abs({RAW}) < 1e-6 THEN coalesce(s_score, 0) / 6 ELSE {e} * coalesce(s_score, 0) / ({RAW}) END")
        + " FROM last_scored" for k, e in CL.items())),
    "target_weights": st(f"SELECT as_of, ticker, {r('weight')} FROM targets"),
    "transitions": st("SELECT ticker, from_state, to_state, date FROM transitions"),
    "transition_append": st("SELECT ticker, from_state, to_state, date FROM transitions WHERE date >= DATE '2000-01-01'".replace("ticker,", "upper(ticker) AS ticker,", 1)),
    "recent_transitions": st("SELECT ticker, from_state, to_state, date FROM transitions ORDER BY date DESC, ticker DESC, from_state, to_state LIMIT 25"),
    "transition_feed": st("""SELECT ticker, date, ticker || ' transitioned ' || from_state || ' -> ' || to_state AS title,
        'transition-' || strftime(date, '%Y%m%d') || '-' || regexp_replace(lower(ticker), '[^a-z0-9]+', '-', 'g') || '-' ||
        replace(lower(from_state), '_', '-') || '-' || replace(lower(to_state), '_', '-') AS uid FROM transitions"""),
    "transition_digest": st("SELECT ticker, from_state, to_state, date FROM transitions WHERE date = DATE '2001-06-29' AND to_state NOT IN ('EXIT', 'BEARISH_STAGE_4')"),
    "transition_pulse": st("SELECT DISTINCT upper(ticker) AS ticker FROM transitions WHERE date = DATE '2001-06-29'"),
    "transition_rate": st(f"""SELECT transition_count, observed_intervals, {r('rate_per_ticker_year=CASE WHEN transition_count = 0 THEN 0.0 ELSE transition_count / (observed_intervals / 52.0) END')}
        FROM (SELECT count(*) FILTER (prior <> state) AS transition_count, count(*) AS observed_intervals
              FROM (SELECT state, lag(state) OVER (PARTITION BY ticker ORDER BY as_of) AS prior FROM scored) WHERE prior IS NOT NULL)"""),
    "live_transitions": st("""SELECT s.ticker, t.state AS from_state, s.state AS to_state, DATE '2001-11-05' AS date
        FROM last_scored s JOIN stored t ON s.ticker = t.ticker WHERE t.state <> '' AND t.state <> s.state"""),
    "state_reconcile": st(f"""SELECT s.ticker, CASE WHEN {USE} THEN t.state ELSE s.state END AS state, {USE} AS state_storage_reconciled,
        CASE WHEN {USE} THEN s.state ELSE '' END AS rendered_state FROM last_scored s LEFT JOIN stored t ON s.ticker = t.ticker"""),
    "state_health": st("""SELECT (SELECT count(*) FROM stored) AS by_ticker_count, (SELECT count(*) FROM transitions) AS journal_count,
        (SELECT max(date) FROM transitions) AS latest_transition_date,
        CAST(epoch(TIMESTAMP '2001-01-02') - epoch(max(updated)) AS BIGINT) AS age_seconds,
        CASE WHEN max(updated) IS NULL THEN 'missing' WHEN epoch(TIMESTAMP '2001-01-02') - epoch(max(updated)) > 302400 THEN 'stale' ELSE 'fresh' END AS freshness FROM stored"""),
    "ad_hoc_scores": st(f"""SELECT ticker, 'Ad Hoc' AS class, {r('S_score=s')}, rnk AS rank_in_class, false AS selected, {state_case()} AS state, 'ad_hoc_peer_relative' AS analysis_scope
        FROM (SELECT *, CASE WHEN s IS NOT NULL THEN rank() OVER (ORDER BY s DESC NULLS LAST) END AS rnk FROM adhoc)
        WHERE upper(ticker) IN ('BRAND#7', 'BRAND#12', 'BRAND#99')"""),
    "cycle_tilt": st("""SELECT DISTINCT p_brand AS ticker,
        CAST(CASE WHEN p_brand IN ('Brand#1', 'Brand#10', 'Brand#11') THEN 1 WHEN p_brand LIKE 'Brand#1%' THEN -1 ELSE 0 END AS DOUBLE) AS early,
        CAST(CASE WHEN p_brand = 'Brand#5' THEN 1 WHEN p_brand LIKE 'Brand#1%' THEN -1 ELSE 0 END AS DOUBLE) AS late, 0.0::DOUBLE AS unknown
        FROM part JOIN lineitem ON l_partkey = p_partkey"""),
    "class_lookup": """SELECT coalesce(o.c, d.c, 'Other') AS class, count(*) AS members FROM (SELECT p_name AS t FROM part UNION ALL SELECT c_name FROM customer) n
        LEFT JOIN (SELECT p_name AS t, min(p_type) AS c FROM part WHERE p_size > 3 GROUP BY 1) d ON d.t = n.t
        LEFT JOIN (SELECT p_name AS t, min(p_brand) AS c FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_name LIKE 'red%' GROUP BY 1) o ON o.t = n.t GROUP BY 1""",
    "config_universe": st(f"""SELECT *, sha256('{CONFIG}|' || universe_sha256) AS config_sha256 FROM (
        SELECT count(*) AS universe_count, sha256(concat_ws('|', count(*), {', '.join(HEX.format(i=i) for i in (1, 13, 25))})) AS universe_sha256 FROM (
        SELECT sha256(ticker || '|' || CASE WHEN ticker IN ('{BENCH}', '{CASH}') THEN 'Benchmark' ELSE 'C' || (CAST(substr(ticker, 7) AS INTEGER) % 4) END) AS h FROM (SELECT DISTINCT ticker FROM bars)))"""),
}
