"""Statements for labels, splits, search, bootstrap and gates."""
from .parts import cte, r, statement as st

HZ = "(VALUES (4), (13), (26), (52)) h(h)"


def paths(tag: str, prices: str, horizons: str) -> None:
    cte(f"{tag}_ends", f"""
      SELECT c.as_of, h, d.date AS end_date FROM (SELECT as_of, h, CAST(as_of + h * 7 AS DATE) AS tgt FROM calendar CROSS JOIN {horizons}) c
      ASOF LEFT JOIN (SELECT DISTINCT date FROM {prices}) d ON c.tgt <= d.date""")
    cte(f"{tag}_idx", f"SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM {prices})")
    cte(f"{tag}_paths", f"""
      SELECT s.ticker, e.as_of, e.h AS horizon_weeks, e.end_date, max(p.price) FILTER (p.date = e.end_date) IS NOT NULL AS priced,
             max(p.price) FILTER (p.date = e.end_date) IS NOT NULL AND count(p.date) = max(ie.idx) - max(i.idx) + 1 AS complete,
             max(p.price) FILTER (p.date = e.end_date) / max(s.price) - 1 AS path_return,
             CASE WHEN max(p.price) FILTER (p.date = e.end_date) IS NOT NULL OR count(*) > 0 THEN min(p.price) END / max(s.price) - 1 AS path_low
      FROM {tag}_ends e JOIN {prices} s ON s.date = e.as_of JOIN {tag}_idx i ON i.date = e.as_of
      LEFT JOIN {tag}_idx ie ON ie.date = e.end_date
      LEFT JOIN {prices} p ON p.ticker = s.ticker AND p.date BETWEEN e.as_of AND coalesce(e.end_date, CAST(e.as_of + e.h * 7 AS DATE)) GROUP BY 1, 2, 3, 4""")


paths("lb", "panel", HZ)
paths("rp", "pbars", "(VALUES (2), (4)) h(h)")
cte("feats", """
    SELECT s.as_of, s.ticker, s.class, s.state, s.s_score, s.z3 AS rs_ratio_z, CASE class WHEN 'C0' THEN 'Brand#4' WHEN 'C2' THEN 'Brand#6' ELSE 'Brand#1' END AS benchmark,
           selected OR state = 'STAGE_2_BULLISH' AS positive_signal, state IN ('WARNING', 'EXIT', 'BEARISH_STAGE_4') AS negative_signal FROM scored s""")
cte("labels0", """
    SELECT f.*, h.h AS horizon_weeks, p.end_date, coalesce(p.priced AND p.complete AND b.path_return IS NOT NULL, false) AS label_available,
           p.path_return AS fr, b.path_return AS br, p.path_low AS dd
    FROM feats f CROSS JOIN """ + HZ + """ LEFT JOIN lb_paths p ON f.ticker = p.ticker AND f.as_of = p.as_of AND p.horizon_weeks = h.h
    LEFT JOIN lb_paths b ON b.ticker = f.benchmark AND b.as_of = f.as_of AND b.horizon_weeks = h.h AND b.priced""")
cte("labels1", """
    SELECT * EXCLUDE (fr, br, dd), CASE WHEN label_available THEN fr END AS forward_return, CASE WHEN label_available THEN br END AS benchmark_return,
           CASE WHEN label_available THEN fr - br END AS excess_return, CASE WHEN label_available THEN dd END AS drawdown,
           label_available AND fr > 0 AND fr - br > 0 AS ap, label_available AND (fr <= 0 OR fr - br < 0 OR dd <= -0.05) AS an FROM labels0""")
cte("labels", """
    SELECT *, ap AS actual_positive, an AS actual_negative, positive_signal AND ap AS positive_success, negative_signal AND label_available AND excess_return < 0 AS avoided_underperformance_,
           coalesce(negative_signal AND label_available AND excess_return < 0, false) AS avoided_underperformance,
           coalesce(negative_signal AND label_available AND forward_return <= 0, false) AS failed_followthrough,
           coalesce(negative_signal AND label_available AND drawdown <= -0.05, false) AS avoided_drawdown, negative_signal AND an AS negative_success FROM labels1""")
cte("sides", """
    SELECT *, 'positive' AS direction, positive_signal AS sig, actual_positive AS act FROM labels
    UNION ALL SELECT *, 'negative', negative_signal, actual_negative FROM labels""")
cte("conf", """
    SELECT horizon_weeks, direction, CASE WHEN grouping(class) = 1 THEN 'all' ELSE class END AS class, count(*) AS total_count, count(*) FILTER (label_available) AS available_count,
           count(*) FILTER (sig) AS signal_count, count(*) FILTER (sig AND label_available) AS signal_available_count, count(*) FILTER (act) AS actual_outcome_count,
           count(*) FILTER (sig AND label_available AND act) AS true_positive, count(*) FILTER (sig AND label_available AND NOT act) AS false_positive,
           count(*) FILTER (NOT sig AND label_available AND act) AS false_negative, count(*) FILTER (NOT sig AND label_available AND NOT act) AS true_negative,
           coalesce(avg(forward_return) FILTER (sig AND label_available), 0) AS average_forward_return, coalesce(avg(excess_return) FILTER (sig AND label_available), 0) AS average_forward_excess_return,
           coalesce(avg(drawdown) FILTER (sig AND label_available), 0) AS average_post_entry_drawdown,
           coalesce(avg(-least(drawdown, 0)) FILTER (sig AND label_available AND direction = 'negative'), 0) AS average_drawdown_avoided
    FROM sides GROUP BY GROUPING SETS ((horizon_weeks, direction), (horizon_weeks, direction, class))""")
# --- folds, unrolled
cte("days", "SELECT list(as_of ORDER BY as_of) AS ds, max(as_of) AS we FROM calendar")
cte("base_win", """
    SELECT list_filter(ds, lambda d: d >= CAST(we - INTERVAL 72 MONTH + INTERVAL 1 DAY AS DATE)) AS wd, we, ds[1] <= CAST(we - INTERVAL 72 MONTH + INTERVAL 1 DAY AS DATE) AS ok FROM days""")
cte("fold0", "SELECT wd, we, list_filter(wd, lambda d: d >= CAST(we - INTERVAL 12 MONTH AS DATE))[1] AS hs, wd[1] AS cs FROM base_win WHERE ok")
for k in range(4):
    cte(f"fold{k}v", f"""
      SELECT *, list_filter(wd, lambda d: d >= CAST(cs + INTERVAL 24 MONTH AS DATE))[1] AS vs FROM fold{k}""")
    cte(f"fold{k}x", f"""
      SELECT *, list_filter(wd, lambda d: d < vs)[-1] AS ce, list_filter(wd, lambda d: d < least(CAST(vs + INTERVAL 12 MONTH AS DATE), hs))[-1] AS ve FROM fold{k}v WHERE vs < hs""")
    cte(f"fold{k + 1}", f"SELECT wd, we, hs, list_filter(wd, lambda d: d >= CAST(cs + INTERVAL 12 MONTH AS DATE))[1] AS cs FROM fold{k}x")
cte("splits", " UNION ALL ".join(
    f"SELECT 'fold_0{k + 1}' AS name, cs AS calibration_start, ce AS calibration_end, vs AS validation_start, ve AS validation_end, hs AS final_holdout_start, we AS final_holdout_end, 2 AS calibration_years FROM fold{k}x"
    for k in range(4)))
cte("windowed", """
    SELECT l.*, name AS fold, CASE WHEN as_of BETWEEN calibration_start AND calibration_end AND end_date <= calibration_end THEN 'calibration'
           WHEN as_of BETWEEN validation_start AND validation_end AND end_date < final_holdout_start THEN 'validation'
           WHEN as_of BETWEEN final_holdout_start AND final_holdout_end AND end_date <= final_holdout_end AND name = 'fold_01' THEN 'final_holdout' END AS win
    FROM labels l CROSS JOIN splits""")
cte("crules", """SELECT * FROM (VALUES (0, 'baseline', NULL::DOUBLE, NULL::DOUBLE), (1, 'pos_30', 0.3, NULL), (2, 'pos_60', 0.6, NULL), (3, 'neg_20', NULL, -0.2), (4, 'neg_50', NULL, -0.5), (5, 'both', 0.3, -0.2)) v(rule_order, candidate_id, pmin, nmax)""")
cte("cells", """
    SELECT candidate_id, pmin, nmax, horizon_weeks, fold, win, count(*) AS n,
           count(*) FILTER (positive_signal AND label_available AND (pmin IS NULL OR s_score >= pmin)) AS pn, count(*) FILTER (positive_success AND (pmin IS NULL OR s_score >= pmin)) AS ph,
           count(*) FILTER (negative_signal AND label_available AND (nmax IS NULL OR s_score <= nmax)) AS nn, count(*) FILTER (negative_success AND (nmax IS NULL OR s_score <= nmax)) AS nh
    FROM windowed CROSS JOIN crules WHERE win IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6""")
_R = lambda h, n, w: f"CASE WHEN sum({n}) FILTER (win = '{w}') > 0 THEN sum({h}) FILTER (win = '{w}') / sum({n}) FILTER (win = '{w}') ELSE 0.0 END"
cte("tot", "SELECT r.candidate_id, r.pmin, r.nmax, h.h AS horizon_weeks, (SELECT count(*) FROM splits) AS fold_count, " + ", ".join(
    f"coalesce(sum({a}n) FILTER (win = '{w}'), 0) AS {w}_{a}n, {_R(a + 'h', a + 'n', w)} AS {w}_{a}r" for w in ("calibration", "validation", "final_holdout") for a in ("p", "n"))
    + ", coalesce(sum(n) FILTER (win = 'final_holdout'), 0) AS frows FROM crules r CROSS JOIN " + HZ + " LEFT JOIN cells c ON c.candidate_id = r.candidate_id AND c.horizon_weeks = h.h GROUP BY 1, 2, 3, 4")
cte("worst", """
    SELECT candidate_id, horizon_weeks, CASE WHEN count(*) < (SELECT count(*) FROM splits) THEN least(min(least(p - bp, n - bn)), 0.0) ELSE min(least(p - bp, n - bn)) END AS mfd FROM (
      SELECT c.candidate_id, c.horizon_weeks, CASE WHEN c.pn > 0 THEN c.ph / c.pn ELSE 0.0 END AS p, CASE WHEN c.nn > 0 THEN c.nh / c.nn ELSE 0.0 END AS n,
             CASE WHEN b.pn > 0 THEN b.ph / b.pn ELSE 0.0 END AS bp, CASE WHEN b.nn > 0 THEN b.nh / b.nn ELSE 0.0 END AS bn
      FROM cells c JOIN cells b ON b.candidate_id = 'baseline' AND b.horizon_weeks = c.horizon_weeks AND b.fold = c.fold AND b.win = c.win WHERE c.win = 'validation') GROUP BY 1, 2""")
cte("srch0", """
    SELECT t.*, coalesce(w.mfd, 0.0) AS mfd, t.pmin IS NOT NULL OR t.nmax IS NULL AS up, t.nmax IS NOT NULL OR t.pmin IS NULL AS un,
           t.calibration_pr - b.calibration_pr AS cpd, t.calibration_nr - b.calibration_nr AS cnd, t.validation_pr - b.validation_pr AS vpd, t.validation_nr - b.validation_nr AS vnd,
           t.final_holdout_pr - b.final_holdout_pr AS fpd, t.final_holdout_nr - b.final_holdout_nr AS fnd
    FROM tot t JOIN tot b ON b.candidate_id = 'baseline' AND b.horizon_weeks = t.horizon_weeks LEFT JOIN worst w ON w.candidate_id = t.candidate_id AND w.horizon_weeks = t.horizon_weeks""")
cte("srch1", """
    SELECT *, CASE WHEN candidate_id = 'baseline' THEN 'baseline_reference'
      WHEN (up AND (calibration_pn < 20 OR validation_pn < 20)) OR (un AND (calibration_nn < 20 OR validation_nn < 20)) THEN 'rejected_thin_sample'
      WHEN vnd < 0 THEN 'rejected_negative_signal_degraded' WHEN vpd < 0 THEN 'rejected_positive_signal_degraded' WHEN mfd < 0 THEN 'rejected_unstable_folds'
      ELSE 'blocked_final_holdout_not_evaluated' END AS g FROM srch0""")
cte("srch2", """
    SELECT *, row_number() OVER (ORDER BY candidate_id = 'baseline', g <> 'blocked_final_holdout_not_evaluated', cpd + cnd DESC, horizon_weeks, candidate_id) = 1 AND candidate_id <> 'baseline' AS sel FROM srch1""")
cte("srch3", """
    SELECT *, CASE WHEN sel AND g = 'blocked_final_holdout_not_evaluated' THEN
      CASE WHEN frows = 0 THEN 'rejected_final_holdout_no_data' WHEN (up AND final_holdout_pn < 20) OR (un AND final_holdout_nn < 20) THEN 'rejected_final_holdout_thin_sample'
           WHEN fnd < 0 OR fpd < 0 THEN 'rejected_final_holdout_degraded' WHEN NOT ((up AND fpd > 0) OR (un AND fnd > 0)) THEN 'rejected_final_holdout_no_improvement'
           ELSE 'passed_final_holdout_research_candidate' END ELSE g END AS gate FROM srch2""")
# --- grid
cte("thsplit", """
    SELECT ds[1] AS ts, hs, list_filter(ds, lambda d: d < hs)[-1] AS te, list_filter(ds, lambda d: d < CAST(hs + INTERVAL 36 MONTH AS DATE))[-1] AS he
    FROM (SELECT ds, list_filter(ds, lambda d: d >= CAST(ds[1] + INTERVAL 48 MONTH AS DATE))[1] AS hs FROM days)""")
cte("grules", """SELECT * FROM (VALUES ('positive_score_ge_0_8', 'positive', 0.8, false), ('positive_score_ge_0_8_rel_strength_ge_0_0', 'positive', 0.8, true),
    ('positive_score_ge_1_0', 'positive', 1.0, false), ('positive_score_ge_1_0_rel_strength_ge_0_0', 'positive', 1.0, true),
    ('positive_score_ge_1_2', 'positive', 1.2, false), ('positive_score_ge_1_2_rel_strength_ge_0_0', 'positive', 1.2, true),
    ('negative_score_le_0_0', 'negative', 0.0, false), ('negative_score_le_minus_0_5', 'negative', -0.5, false), ('negative_score_le_minus_1_0', 'negative', -1.0, false)) v(suffix, direction, lim, strength)""")
cte("glab", """
    SELECT l.*, CASE WHEN as_of BETWEEN ts AND te AND end_date <= te THEN 'train' WHEN as_of BETWEEN hs AND he AND end_date <= he THEN 'holdout' END AS win
    FROM labels l CROSS JOIN thsplit""")
cte("gscope", """
    SELECT *, 'global' AS scope, NULL::VARCHAR AS sector FROM glab WHERE win IS NOT NULL UNION ALL SELECT *, class, NULL FROM glab WHERE win IS NOT NULL UNION ALL SELECT *, class, ticker FROM glab WHERE win IS NOT NULL""")
cte("gflag", """
    SELECT *, CASE WHEN direction = 'positive' THEN positive_signal ELSE negative_signal END AND label_available AS base, CASE WHEN direction = 'positive' THEN positive_success ELSE negative_success END AS hit,
           coalesce(CASE WHEN direction = 'positive' THEN s_score >= lim AND (NOT strength OR coalesce(rs_ratio_z >= 0, false)) ELSE s_score <= lim END, false) AS meets
    FROM gscope CROSS JOIN grules""")
cte("gblocks", """
    SELECT lower(coalesce(sector, scope)) || '_' || suffix AS candidate_id, scope, sector, direction, horizon_weeks, win, as_of, count(*) FILTER (base) AS base_n, count(*) FILTER (base AND hit) AS base_hit,
           count(*) FILTER (base AND meets) AS cand_n, count(*) FILTER (base AND meets AND hit) AS cand_hit, sum(forward_return) FILTER (base AND meets) AS sr, sum(excess_return) FILTER (base AND meets) AS se,
           sum(drawdown) FILTER (base AND meets) AS sd, sum(drawdown) FILTER (base) AS bd FROM gflag GROUP BY 1, 2, 3, 4, 5, 6, 7""")
_W = ("train", "holdout")
cte("gsum", "SELECT candidate_id, scope, sector, direction, horizon_weeks, " + ", ".join(
    f"coalesce(sum({c}) FILTER (win = '{w}'), 0)::BIGINT AS {w}_{c}" for w in _W for c in ("base_n", "base_hit", "cand_n", "cand_hit"))
    + ", " + ", ".join(f"coalesce(sum({c}) FILTER (win = 'holdout'), 0.0) AS {c}" for c in ("sr", "se", "sd", "bd")) + " FROM gblocks GROUP BY 1, 2, 3, 4, 5")
_q = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
cte("gmet", "SELECT *, " + ", ".join(
    f"{_q(f'{w}_cand_hit', f'{w}_cand_n')} AS {w}_hit_rate, {_q(f'{w}_base_hit', f'{w}_base_n')} AS baseline_{w}_hit_rate" for w in _W) + " FROM gsum")
DRAW = "((h3 * h3) % 2147483647) % {n}"


def boot(samples: int, where: str) -> str:
    return f"""
    SELECT candidate_id, horizon_weeks, count(*) AS block_count, sum(base_n)::BIGINT AS baseline_count, sum(cand_n)::BIGINT AS candidate_count,
           CASE WHEN sum(cand_n) > 0 THEN sum(cand_hit) / sum(cand_n) - sum(base_hit) / sum(base_n) END AS obs FROM gblocks WHERE base_n > 0 AND {where} GROUP BY 1, 2"""


def boot_ci(name: str, samples: int, where: str) -> None:
    cte(f"{name}_obs", boot(samples, where))
    cte(f"{name}_blk", f"SELECT *, row_number() OVER (PARTITION BY candidate_id, horizon_weeks ORDER BY as_of) - 1 AS i FROM gblocks WHERE base_n > 0 AND {where}")
    cte(f"{name}_draw", f"""
      SELECT candidate_id, horizon_weeks, s, {DRAW.format(n='block_count')} AS i FROM (
        SELECT *, (h2 * 48271 + j) % 2147483647 AS h3 FROM (SELECT *, (h1 * h1 + 12345) % 2147483647 AS h2 FROM (
          SELECT candidate_id, horizon_weeks, block_count, s, j, (s * 1000003 + j * 10007 + 164) % 2147483647 AS h1
          FROM (SELECT *, unnest(range(block_count)) AS j FROM {name}_obs WHERE candidate_count > 0) CROSS JOIN range({samples}) r(s))))""")
    cte(f"{name}_ci", f"""
      SELECT candidate_id, horizon_weeks, count(d) AS v, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM (
        SELECT w.candidate_id, w.horizon_weeks, s, CASE WHEN sum(cand_n) > 0 AND sum(base_n) > 0 THEN sum(cand_hit) / sum(cand_n) - sum(base_hit) / sum(base_n) END AS d
        FROM {name}_draw w JOIN {name}_blk b ON b.candidate_id = w.candidate_id AND b.horizon_weeks = w.horizon_weeks AND b.i = w.i GROUP BY 1, 2, 3) GROUP BY 1, 2""")


boot_ci("b1", 500, "win = 'holdout'")
cte("un", """
    SELECT candidate_id, horizon_weeks, sum(base_n)::BIGINT AS bn, sum(base_hit)::BIGINT AS bh, sum(cand_n)::BIGINT AS cn, sum(cand_hit)::BIGINT AS ch
    FROM gblocks WHERE win = 'holdout' GROUP BY 1, 2 HAVING sum(base_n) > 0 AND sum(cand_n) > 0""")


def side(n: str, hit: str, seed: int) -> str:
    return f"""
      SELECT candidate_id, horizon_weeks, s, sum(CASE WHEN {DRAW.format(n=n)} < {hit} THEN 1 ELSE 0 END) / max({n}) AS rate FROM (
        SELECT *, (h2 * 48271 + j) % 2147483647 AS h3 FROM (SELECT *, (h1 * h1 + 12345) % 2147483647 AS h2 FROM (
          SELECT candidate_id, horizon_weeks, {n}, {hit}, s, j, (s * 1000003 + j * 10007 + {seed}) % 2147483647 AS h1
          FROM (SELECT *, unnest(range({n})) AS j FROM un) CROSS JOIN range(1000) r(s)))) GROUP BY 1, 2, 3"""


cte("un_c", side("cn", "ch", 42))
cte("un_b", side("bn", "bh", 49))
cte("gprom0", "SELECT m.*, train_hit_rate - baseline_train_hit_rate AS td, holdout_hit_rate - baseline_holdout_hit_rate AS hd, coalesce(lo, 0) AS lo, coalesce(v, 0) AS v FROM gmet m LEFT JOIN b1_ci c ON c.candidate_id = m.candidate_id AND c.horizon_weeks = m.horizon_weeks")
cte("gprom", """
    SELECT *, CASE WHEN train_cand_n < 40 OR holdout_cand_n < 20 THEN 'thin_sample' WHEN hd <= 0 THEN 'holdout_no_improvement' WHEN NOT (td >= 0 AND hd >= 0) THEN 'fold_unstable'
      WHEN v <= 0 THEN 'bootstrap_insufficient_candidate_blocks' WHEN round(lo, 6) < 0 THEN 'bootstrap_interval_crosses_zero' ELSE 'separate_live_promotion_ticket_required' END AS reason FROM gprom0""")

SQL = {
    "walk_forward_splits": st("SELECT * FROM splits"),
    "split_summary": st(f"""SELECT count(*) AS fold_count, min(calibration_start) AS window_start, max(final_holdout_end) AS window_end, min(final_holdout_start) AS holdout_start,
        bool_and(calibration_start <= calibration_end AND calibration_end < validation_start AND validation_start <= validation_end AND validation_end < final_holdout_start) AS no_lookahead_verified,
        max(calibration_years) AS effective_calibration_years, 'ready' AS status, round((max(final_holdout_end) - min(calibration_start) + 1) / 365.25, 2) AS coverage_years,
        CASE WHEN min(calibration_start) <= CAST(max(final_holdout_end) - INTERVAL 72 MONTH + INTERVAL 1 DAY AS DATE) THEN 'full_requested_history' ELSE 'accepted_short_history' END AS history_window_status FROM splits"""),
    "train_holdout_split": st("SELECT CASE WHEN (he - hs + 1) / 365.25 >= 2 THEN 'ready' ELSE 'insufficient_holdout' END AS status, ts AS train_start, te AS train_end, hs AS holdout_start, he AS holdout_end, round((he - hs + 1) / 365.25, 2) AS holdout_years FROM thsplit"),
    "forward_labels": st(f"""SELECT as_of, ticker, class, state, benchmark, positive_signal, negative_signal, horizon_weeks, end_date, label_available, avoided_underperformance, failed_followthrough,
        avoided_drawdown, positive_success, negative_success, {r('forward_return','benchmark_return','excess_return','drawdown')} FROM labels"""),
    "raw_path_returns": st(f"SELECT ticker, as_of, horizon_weeks, end_date, priced, complete, {r('path_return','path_low')} FROM rp_paths"),
    "confusion_metrics": st(f"""SELECT horizon_weeks, direction, class, total_count, available_count, signal_count, signal_available_count, actual_outcome_count, true_positive, false_positive, false_negative, true_negative,
        total_count - available_count AS unavailable_count, signal_count - signal_available_count AS signal_unavailable_count,
        {r('average_forward_return','average_forward_excess_return','average_post_entry_drawdown','average_drawdown_avoided', 'missing_label_rate=' + _q('(total_count - available_count)', 'total_count'),
           'signal_missing_rate=' + _q('(signal_count - signal_available_count)', 'signal_count'), 'hit_rate=' + _q('true_positive', 'signal_available_count'), 'precision=' + _q('true_positive', '(true_positive + false_positive)'),
           'recall=' + _q('true_positive', '(true_positive + false_negative)'), 'f1=' + _q('2 * true_positive', '(2 * true_positive + false_positive + false_negative)'))} FROM conf"""),
    "candidate_search": st(f"""SELECT candidate_id, horizon_weeks, gate AS gate_status, CASE gate WHEN 'passed_final_holdout_research_candidate' THEN 'candidate' WHEN 'blocked_final_holdout_not_evaluated' THEN 'needs more testing' ELSE 'do not promote' END AS promotion_label,
        sel AS selected_by_calibration, sel AND g = 'blocked_final_holdout_not_evaluated' AND frows > 0 AS final_holdout_evaluated, concat_ws(',', CASE WHEN up THEN 'positive' END, CASE WHEN un THEN 'negative' END) AS directions_changed, fold_count, CASE WHEN gate LIKE 'rejected%' THEN substr(gate, 10) ELSE '' END AS rejection_reasons,
        CASE WHEN sel AND g = 'blocked_final_holdout_not_evaluated' THEN frows ELSE 0 END::BIGINT AS final_holdout_rows_used,
        calibration_pn::BIGINT AS calibration_pos_n, calibration_nn::BIGINT AS calibration_neg_n, validation_pn::BIGINT AS validation_pos_n, validation_nn::BIGINT AS validation_neg_n,
        {r('calibration_pos_delta=cpd','calibration_neg_delta=cnd','validation_pos_delta=vpd','validation_neg_delta=vnd','calibration_objective_delta=cpd + cnd','min_fold_delta=mfd',"final_holdout_pos_delta=CASE WHEN sel AND g = 'blocked_final_holdout_not_evaluated' THEN fpd END", "final_holdout_neg_delta=CASE WHEN sel AND g = 'blocked_final_holdout_not_evaluated' THEN fnd END")} FROM srch3"""),
    "candidate_search_short": st("""SELECT 'no_ready_walk_forward_splits' AS candidate_id, 4 AS horizon_weeks, 'skipped_insufficient_history' AS gate_status, 'do not promote' AS promotion_label, 'no_ready_walk_forward_splits' AS rejection_reasons,
        false AS selected_by_calibration, false AS final_holdout_evaluated, 0::BIGINT AS final_holdout_rows_used, false AS live_promotion_allowed FROM (SELECT max(date) - INTERVAL 10 YEAR AS wanted, min(date) AS first FROM bars) WHERE first > wanted"""),
    "candidate_grid": st(f"""SELECT candidate_id, scope, sector, direction, horizon_weeks, train_base_n, train_base_hit, train_cand_n, train_cand_hit, holdout_base_n, holdout_base_hit, holdout_cand_n, holdout_cand_hit,
        train_hit_rate - baseline_train_hit_rate >= 0 AND holdout_hit_rate - baseline_holdout_hit_rate >= 0 AS fold_stability_passed,
        {r('train_hit_rate','holdout_hit_rate','baseline_train_hit_rate','baseline_holdout_hit_rate','train_delta=train_hit_rate - baseline_train_hit_rate','holdout_delta=holdout_hit_rate - baseline_holdout_hit_rate',
           'holdout_average_return=' + _q('sr', 'holdout_cand_n'), 'holdout_average_excess=' + _q('se', 'holdout_cand_n'), 'holdout_average_drawdown=' + _q('sd', 'holdout_cand_n'),
           'holdout_drawdown_delta=' + _q('sd', 'holdout_cand_n') + ' - ' + _q('bd', 'holdout_base_n'))} FROM gmet"""),
    "block_bootstrap": st("""SELECT o.candidate_id, o.horizon_weeks, CAST(block_count AS INTEGER) AS block_count, baseline_count, candidate_count, round(coalesce(obs, 0), 6) + 0.0 AS mean_delta,
        round(coalesce(lo, 0), 6) + 0.0 AS ci_low, round(coalesce(hi, 0), 6) + 0.0 AS ci_high, coalesce(v, 0) AS valid_resamples
        FROM b1_obs o LEFT JOIN b1_ci c ON c.candidate_id = o.candidate_id AND c.horizon_weeks = o.horizon_weeks"""),
    "unpaired_bootstrap": st("""SELECT u.candidate_id, u.horizon_weeks, round(max(ch / cn - bh / bn), 6) + 0.0 AS mean_delta, round(quantile_cont(c.rate - b.rate, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(c.rate - b.rate, 0.975), 6) + 0.0 AS ci_high,
        max(cn) AS candidate_sample_count, max(bn) AS baseline_sample_count
        FROM un u JOIN un_c c ON c.candidate_id = u.candidate_id AND c.horizon_weeks = u.horizon_weeks JOIN un_b b ON b.candidate_id = u.candidate_id AND b.horizon_weeks = u.horizon_weeks AND b.s = c.s GROUP BY 1, 2"""),
    "grid_promotion": st("SELECT candidate_id, horizon_weeks, reason AS rejection_reasons, CASE reason WHEN 'thin_sample' THEN 'do not promote' WHEN 'separate_live_promotion_ticket_required' THEN 'research_candidate' ELSE 'needs more testing' END AS promotion_label FROM gprom"),
    "sector_overrides": st("""SELECT candidate_id, horizon_weeks, sector, round(1 + least(greatest(hd, 0), 0.25), 4) AS sector_weight_multiplier, 'sector_candidate' AS promotion_label, 'separate_reviewed_live_promotion_ticket' AS promotion_requires
        FROM gprom WHERE sector IS NOT NULL AND hd >= 0.05 AND sd / holdout_cand_n - bd / holdout_base_n >= 0 AND td >= 0 AND reason = 'separate_live_promotion_ticket_required'"""),
    "override_guardrail": """SELECT CASE WHEN n = 0 THEN 'pass_no_overrides' WHEN reasons <> '' THEN 'fail_closed' ELSE 'pass_display_only' END AS status, n AS override_count, reasons FROM (
        SELECT count(*) AS n, concat_ws(',', CASE WHEN count(*) FILTER (s_suppkey % 27 NOT BETWEEN 1 AND 25) > 0 THEN 'non_us_sector_override' END,
          CASE WHEN count(*) FILTER (s_suppkey % 50 = 3) > 0 THEN 'override_live_promotion_true' END,
          CASE WHEN count(*) FILTER (s_acctbal < 0 OR 1 + s_acctbal / 40000 > 1.25) > 0 THEN 'weight_multiplier_out_of_bounds' END) AS reasons FROM supplier)""",
    "config_guardrail": """SELECT CASE WHEN reasons <> '' THEN 'fail_closed' ELSE 'pass_display_only' END AS status, reasons, count(*) AS configs, min(k) AS first_config FROM (
        SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'config_live_promotion_true' END, CASE WHEN o_orderkey % 13 = 0 THEN 'selected_candidate_live_promotion_true' END,
          CASE WHEN o_orderkey % 7 = 0 THEN 'config_not_research_only' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_separate_ticket_requirement' END,
          CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'candidate_without_final_holdout' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 40 < 20 THEN 'insufficient_final_holdout_rows_for_candidate' END,
          CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 3 <> 0 THEN 'passed_status_without_final_holdout' END) AS reasons FROM orders) GROUP BY 1, 2""",
    "promotion_gate": """SELECT ticket, n AS candidate_count, candidates, rejected, CASE WHEN n > 0 THEN 'ready_for_review' ELSE 'blocked_no_candidates' END AS status,
        CASE WHEN n > 0 THEN '' ELSE 'No candidate rows were present in the validation summary.' END AS blockers FROM (
        SELECT c_mktsegment AS ticket, count(*) FILTER (v > 255000) AS n, coalesce(string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (v > 255000), '') AS candidates,
               coalesce(string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (v <= 255000), '') AS rejected
        FROM (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1)""",
}
