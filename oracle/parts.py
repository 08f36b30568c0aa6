"""Shared CTEs. ``statement`` pulls in the ones a query names, in order."""
from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def statement(final: str) -> str:
    """Prefix a SELECT with every CTE it needs, directly or through another one."""
    need: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)", text)):
            if word in CTES and word not in need:
                visit(CTES[word])
                if word not in need:
                    need.append(word)

    visit(final)
    if not need:
        return final
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in need]
    return "WITH " + ",\n".join(parts) + "\n" + final


def r(*columns: str, digits: int = 6) -> str:
    """Rounded output columns; ``name=expression`` renames."""
    out = []
    for c in columns:
        name, _, expr = c.partition("=")
        name = name.strip()
        out.append(f"round({(expr or name).strip()}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


def t(*columns: str) -> str:
    """Report columns as text, as the library's ``shown`` prints them."""
    out = []
    for c in columns:
        name, _, expr = c.partition("=")
        e = (expr or name).strip()
        out.append(f"CASE WHEN abs({e}) < 1000 THEN printf('%.6f', round({e}, 6) + 0.0) WHEN {e} IS NOT NULL THEN printf('%.7e', {e}) END AS {name.strip()}")
    return ", ".join(out)


WEEK = "({d} + CAST((12 - isodow({d})) % 7 AS INTEGER))"


def week(d: str) -> str:
    return WEEK.format(d=d)


# --- market views ---------------------------------------------------------------
for suffix, column in (("", "p_brand"), ("_type", "p_type")):
    cte(f"ticks{suffix}", f"""
    SELECT {column} AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
           l_quantity AS size, l_discount AS discount, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_orderkey * 8388608 + l_linenumber * 1048576 + (l_partkey * 31 + l_suppkey) % 1048576 AS number
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
    cte(f"bars{suffix}", f"""
    SELECT ticker, date,
           first(price ORDER BY number) AS open,
           max(price) AS high, min(price) AS low,
           last(price ORDER BY number) AS close,
           last(price * (1 - discount) ORDER BY number) AS adj_close,
           sum(size) AS volume
    FROM ticks{suffix} GROUP BY 1, 2""")
    cte(f"pbars{suffix}", f"SELECT *, adj_close AS price, {week('date')} AS week_end FROM bars{suffix}")
cte("macro", """
    SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS value
    FROM orders GROUP BY 1, 2""")
cte("intraday", """
    SELECT event_type AS ticker, ts, event_id AS seq, value AS price,
           CAST(json_extract(props, '$.k') AS DOUBLE) * 1000 AS size,
           CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 17 = 0 THEN 1 ELSE 0 END AS correction
    FROM events""")
cte("holdings", """
    SELECT account, ticker, shares, paid / shares AS cost_basis,
           CASE WHEN account % 7 <> 0 THEN paid * 1.1 END AS market_value,
           CASE WHEN account % 5 = 0 THEN shares / 100.0 END AS weight
    FROM (SELECT l_suppkey AS account, p_brand AS ticker, sum(l_quantity) AS shares, sum(l_extendedprice) AS paid
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""")
cte("trades", """
    SELECT CAST(l_shipdate AS DATE) AS trade_date, p_brand AS ticker,
           CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS shares,
           l_extendedprice / l_quantity AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
cte("decisions", """
    SELECT o_orderkey AS run_id, o_orderdate AS started_at, 'Brand#' || (o_custkey % 25 + 1) AS ticker,
           CASE o_orderstatus WHEN 'F' THEN 'EXIT' WHEN 'O' THEN 'BUY' ELSE 'HOLD' END AS action,
           o_orderpriority AS series_id
    FROM orders""")
cte("shares_out", """
    SELECT ticker, as_of, shares_outstanding, nav, shares_outstanding * nav AS aum
    FROM (SELECT ticker, last_day(date) AS as_of, sum(size) AS shares_outstanding, avg(price) AS nav
          FROM ticks GROUP BY 1, 2)""")

# --- daily windows ----------------------------------------------------------------
cte("daily0", """
    SELECT *, row_number() OVER w AS rn,
           CASE WHEN count(price) OVER (w ROWS 49 PRECEDING) = 50 THEN avg(price) OVER (w ROWS 49 PRECEDING) END AS sma50
    FROM pbars WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
cte("daily", """
    SELECT ticker, date, week_end, price, rn,
           lag(price, 20) OVER w / lag(price, 251) OVER w - 1 AS mom_12_1,
           price / lag(price, 1) OVER w - 1 AS return_1d,
           price / lag(price, 2) OVER w - 1 AS return_2d,
           price / lag(price, 5) OVER w - 1 AS return_5d,
           CASE WHEN rn >= 100 THEN avg(CASE WHEN price > sma50 THEN 1.0 ELSE 0.0 END) OVER (w ROWS 49 PRECEDING) END AS breadth_50d
    FROM daily0 WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
cte("month_close", """
    SELECT ticker, year(date) * 12 + month(date) AS month_no, arg_max(price, date) AS close FROM pbars GROUP BY 1, 2""")
cte("month_stats", """
    SELECT ticker, month_no, sum(close) OVER w AS sum9, count(close) OVER w AS n9,
           month_no - min(month_no) OVER (PARTITION BY ticker) + 1 AS months
    FROM month_close WINDOW w AS (PARTITION BY ticker ORDER BY month_no RANGE BETWEEN 9 PRECEDING AND 1 PRECEDING)""")
cte("faber", """
    SELECT b.ticker, b.date,
           CASE WHEN months >= 11 THEN CASE WHEN n9 = 9 AND price > (sum9 + price) / 10 THEN 1 ELSE 0 END END AS faber
    FROM pbars b JOIN month_stats m ON b.ticker = m.ticker AND year(b.date) * 12 + month(b.date) = m.month_no""")
cte("year_return", """
    SELECT ticker, date, price / lag(price, 251) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM pbars""")
cte("antonacci", """
    SELECT a.ticker, a.date, CAST(a.ret > c.ret AS INTEGER) AS antonacci
    FROM year_return a ASOF LEFT JOIN (SELECT * FROM year_return WHERE ticker = 'Brand#2') c ON a.date >= c.date""")

# --- weekly windows ---------------------------------------------------------------
cte("weekly", """
    SELECT ticker, week_end, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, date) AS close, arg_max(price, date) AS price, sum(volume) AS volume, max(date) AS last_date
    FROM pbars GROUP BY 1, 2""")
cte("weekly_spine", """
    SELECT s.ticker, s.week_end, w.week_end IS NOT NULL AS traded, w.open, w.high, w.low, w.close, w.price,
           coalesce(w.volume, 0) AS volume
    FROM (SELECT ticker, CAST(unnest(generate_series(CAST(min(week_end) AS TIMESTAMP), CAST(max(week_end) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_end
          FROM weekly GROUP BY ticker) s
    LEFT JOIN weekly w ON s.ticker = w.ticker AND s.week_end = w.week_end""")
cte("rel", """
    SELECT *, price / pb AS ratio FROM (
      SELECT s.*, row_number() OVER w AS weeks, last_value(b.price IGNORE NULLS) OVER w AS pb,
             coalesce(max(b.nb) OVER w, 0) AS bench_weeks
      FROM weekly_spine s
      LEFT JOIN (SELECT week_end, price, row_number() OVER (ORDER BY week_end) AS nb FROM weekly_spine WHERE ticker = 'Brand#1') b
        ON s.week_end = b.week_end
      WINDOW w AS (PARTITION BY s.ticker ORDER BY s.week_end ROWS UNBOUNDED PRECEDING))""")
cte("rel_sma", """
    SELECT *, CASE WHEN count(price) OVER (w ROWS 29 PRECEDING) = 30 THEN avg(price) OVER (w ROWS 29 PRECEDING) END AS sma30,
           100 * ratio AS rs100
    FROM rel WINDOW w AS (PARTITION BY ticker ORDER BY week_end)""")
cte("stage0", """
    SELECT *, (sma30 - lag(sma30, 5) OVER w) / 5 AS slope, (ratio / lag(ratio, 52) OVER w - 1) * 100 AS rs,
           traded AND weeks >= 53 AND bench_weeks >= 53 AND sma30 IS NOT NULL AND lag(ratio, 52) OVER w IS NOT NULL AS known
    FROM rel_sma WINDOW w AS (PARTITION BY ticker ORDER BY week_end)""")
cte("stage", """
    SELECT ticker, week_end, sma30 AS sma30w, price > sma30 AS above_30wma, coalesce(slope > 0, false) AS ma_slope_pos, rs AS mansfield_rs,
           CASE WHEN price > sma30 AND slope > 0 AND rs > 0 THEN 2
                WHEN price > sma30 AND (coalesce(slope <= 0, false) OR coalesce(rs <= 0, false)) THEN 3
                WHEN price <= sma30 AND slope < 0 AND rs < 0 THEN 4 ELSE 1 END AS stage
    FROM stage0 WHERE known""")
cte("rrg1", """
    SELECT *, CASE WHEN count(rs100) OVER (w ROWS 62 PRECEDING) = 63 THEN
        100 + (rs100 - avg(rs100) OVER (w ROWS 62 PRECEDING)) / CASE WHEN count(rs100) OVER (w ROWS 251 PRECEDING) >= 60
              AND max(rs100) OVER (w ROWS 251 PRECEDING) > min(rs100) OVER (w ROWS 251 PRECEDING)
              THEN stddev_samp(rs100) OVER (w ROWS 251 PRECEDING) END * 10 END AS rr
    FROM rel_sma WINDOW w AS (PARTITION BY ticker ORDER BY week_end)""")
cte("rrg2", """
    SELECT *, CASE WHEN count(rr) OVER (w ROWS 20 PRECEDING) = 21 AND max(rr) OVER (w ROWS 20 PRECEDING) > min(rr) OVER (w ROWS 20 PRECEDING) THEN
        100 + (rr - avg(rr) OVER (w ROWS 4 PRECEDING)) / stddev_samp(rr) OVER (w ROWS 20 PRECEDING) * 10 END AS rm
    FROM rrg1 WINDOW w AS (PARTITION BY ticker ORDER BY week_end)""")
cte("rrg", """
    SELECT ticker, week_end, rr AS rs_ratio, rm AS rs_momentum,
           CASE WHEN rr >= 100 AND rm >= 100 THEN 'Leading' WHEN rr >= 100 THEN 'Weakening'
                WHEN rm < 100 THEN 'Lagging' ELSE 'Improving' END AS rrg_quadrant
    FROM rrg2 WHERE traded AND weeks >= 60 AND bench_weeks >= 60 AND rm IS NOT NULL""")

# --- flow -------------------------------------------------------------------------
cte("flow0", """
    SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS close1, (high + low + close) / 3 AS typ,
           lag((high + low + close) / 3) OVER w AS typ1,
           coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0) AS mfv,
           coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume * close, 0) AS mfd,
           CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END AS vavg
    FROM pbars WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
cte("flow1", """
    SELECT *, sum(coalesce(sign(close - close1), 0) * volume) OVER (w ROWS UNBOUNDED PRECEDING) AS obv,
           CASE WHEN typ > typ1 THEN typ * volume ELSE 0 END AS pos, CASE WHEN typ < typ1 THEN typ * volume ELSE 0 END AS neg,
           CASE WHEN (close - low) / nullif(high - low, 0) < 0.25 AND volume >= 1.5 * vavg AND close < close1 THEN 1 ELSE 0 END AS dist
    FROM flow0 WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
cte("flow", """
    SELECT ticker, date, week_end, rn, obv,
           CASE WHEN rn >= 22 THEN sum(mfv) OVER w21 / nullif(sum(volume) OVER w21, 0) END AS cmf21,
           CASE WHEN rn >= 21 THEN sum(mfd) OVER w21 END AS net_flow_21d,
           CASE WHEN rn >= 25 AND max(obv) OVER w20 > min(obv) OVER w20 THEN regr_slope(obv, rn) OVER w20 /
                CASE WHEN avg(abs(obv)) OVER w20 = 0 THEN 1.0 ELSE avg(abs(obv)) OVER w20 END END AS obv_slope,
           CASE WHEN rn >= 16 THEN 100 - 100 / (1 + sum(pos) OVER w14 / nullif(sum(neg) OVER w14, 0)) END AS mfi14,
           CASE WHEN rn >= 21 THEN volume / nullif(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) END AS rvol,
           CASE WHEN rn >= 20 THEN avg(close * volume) OVER w20 END AS adv_20d,
           CASE WHEN rn >= 46 THEN CAST(sum(dist) OVER (w ROWS 23 PRECEDING) AS INTEGER) END AS dist_days_25,
           CASE WHEN rn >= 21 THEN close >= max(close) OVER w20 AND NOT (obv >= max(obv) OVER w20) END AS obv_divergence
    FROM flow1 WINDOW w AS (PARTITION BY ticker ORDER BY date), w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING),
         w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w21 AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)""")

# --- replay -----------------------------------------------------------------------
cte("calendar", """
    SELECT week_end, max(date) AS as_of FROM pbars
    WHERE date >= (SELECT max(f) FROM (SELECT min(date) AS f FROM pbars GROUP BY ticker)) GROUP BY 1""")
cte("week_rows", """
    SELECT d.ticker, d.date, d.week_end, d.price, d.mom_12_1, d.return_1d, d.return_2d, d.return_5d, d.breadth_50d, faber.faber,
           y.ret AS year_return, stage.sma30w, stage.above_30wma, stage.ma_slope_pos, stage.mansfield_rs, stage.stage,
           rrg.rs_ratio, rrg.rs_momentum, rrg.rrg_quadrant, flow.cmf21, flow.net_flow_21d, flow.obv_slope, flow.mfi14, flow.rvol,
           flow.adv_20d, flow.dist_days_25, flow.obv_divergence
    FROM weekly wk
    JOIN daily d ON d.ticker = wk.ticker AND d.date = wk.last_date
    JOIN faber ON faber.ticker = d.ticker AND faber.date = d.date
    JOIN year_return y ON y.ticker = d.ticker AND y.date = d.date
    JOIN flow ON flow.ticker = d.ticker AND flow.date = d.date
    LEFT JOIN stage ON stage.ticker = d.ticker AND stage.week_end = d.week_end
    LEFT JOIN rrg ON rrg.ticker = d.ticker AND rrg.week_end = d.week_end
    """)
cte("snap0", """
    SELECT c.as_of, w.*
    FROM (SELECT c.*, t.ticker FROM calendar c CROSS JOIN (SELECT DISTINCT ticker FROM week_rows) t) c
    ASOF JOIN week_rows w ON c.ticker = w.ticker AND c.week_end >= w.week_end""")
cte("snap", """
    SELECT s.*, CAST(s.year_return > c.year_return AS INTEGER) AS antonacci,
           CASE WHEN s.ticker = 'Brand#1' THEN 'Benchmark' ELSE 'C' || (CAST(substr(s.ticker, 7) AS INTEGER) % 4) END AS class
    FROM snap0 s LEFT JOIN snap0 c ON c.ticker = 'Brand#2' AND s.as_of = c.as_of WHERE s.ticker <> 'Brand#2'""")


def z(c: str, part: str) -> str:
    """Population z-score as a window expression with the zero-spread rule."""
    w = f"OVER (PARTITION BY {part})"
    return f"CASE WHEN max({c}) {w} > min({c}) {w} THEN ({c} - avg({c}) {w}) / stddev_pop({c}) {w} ELSE {c} * 0.0 END"


cte("scored0", f"""
    SELECT *, {z('mom_12_1', 'as_of, class')} AS z1, {z('mansfield_rs', 'as_of, class')} AS z2, {z('rs_ratio', 'as_of, class')} AS z3,
           {z('rs_momentum', 'as_of, class')} AS z4,
           (coalesce(faber, 0) + CASE WHEN stage = 2 THEN 1 ELSE 0 END + coalesce(antonacci, 0)) / 3.0 AS filters
    FROM snap WHERE class <> 'Benchmark'""")
cte("scored1", """
    SELECT *, 0.0 AS f_score, 0.22 * z1 + 0.12 * z2 + 0.15 * z3 + 0.08 * z4 + 0.12 * filters AS s_score FROM scored0""")
cte("scored2", """
    SELECT *, CASE WHEN s_score IS NOT NULL THEN rank() OVER (PARTITION BY as_of, class ORDER BY s_score DESC NULLS LAST) END AS rank_in_class
    FROM scored1""")


def state_case(etf: str = "false", etf_v: str = "NULL", block: str = "false", block_v: str = "NULL") -> str:
    return f"""CASE
      WHEN above_30wma = false AND ma_slope_pos = false AND mansfield_rs < 0 AND cmf21 < -0.10 THEN 'BEARISH_STAGE_4'
      WHEN coalesce(above_30wma = false, false) OR coalesce(mansfield_rs < 0, false) OR coalesce(antonacci = 0, false)
        OR coalesce(rrg_quadrant = 'Lagging', false) OR coalesce(cmf21 < -0.10, false)
        OR ({etf} AND coalesce({etf_v} < -1.5, false)) OR ({block} AND coalesce({block_v} < 0.7, false)) THEN 'EXIT'
      WHEN coalesce(rrg_quadrant = 'Weakening', false) OR coalesce(breadth_50d < 0.5, false) OR coalesce(cmf21 < 0, false)
        OR coalesce(return_5d <= -0.04, false) OR coalesce(obv_divergence, false) OR coalesce(dist_days_25 >= 4, false) THEN 'WARNING'
      WHEN stage = 2 AND rrg_quadrant = 'Leading' AND breadth_50d >= 0.6 AND cmf21 > 0.05 AND coalesce(return_5d > -0.04, true)
        AND (NOT {etf} OR coalesce({etf_v} >= 0, false)) THEN 'STAGE_2_BULLISH'
      WHEN stage = 2 THEN 'HOLD' WHEN stage = 1 THEN 'STAGE_1_BASING' ELSE 'HOLD' END"""


cte("scored", f"""
    SELECT *, coalesce(rank_in_class <= 2, false) AS selected, {state_case()} AS state FROM scored2""")
cte("targets", """
    SELECT as_of, ticker, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM scored WHERE selected""")
cte("last_scored", "SELECT * FROM scored WHERE as_of = (SELECT max(as_of) FROM scored)")
cte("transitions", """
    SELECT ticker, prior AS from_state, state AS to_state, as_of AS date
    FROM (SELECT *, lag(state) OVER (PARTITION BY ticker ORDER BY as_of) AS prior FROM scored) WHERE prior <> state""")
