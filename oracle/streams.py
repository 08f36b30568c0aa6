"""Statements for the streaming queries: windows closed by the final watermark."""
from .parts import cte, r, statement as st

cte("mark", "SELECT max(ts) - INTERVAL 10 MINUTE AS m FROM events")
AGG = f"""{r('open=arg_min(price, (ts, seq))','high=max(price)','low=min(price)','close=arg_max(price, (ts, seq))','volume=sum(size)')}, count(*) AS prints"""
cte("gaps", """
    SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
NEW = st("SELECT upper(ticker) AS ticker, from_state, to_state, date FROM transitions WHERE date >= DATE '2000-01-01'")
SQL = {
    "stream_bars": st(f"""SELECT ticker, start, start + INTERVAL 1 HOUR AS "end", {AGG} FROM (SELECT *, date_trunc('hour', ts) AS start FROM intraday) WHERE start + INTERVAL 1 HOUR <= (SELECT m FROM mark) GROUP BY 1, 2"""),
    "stream_sliding_bars": st(f"""SELECT ticker, start, start + INTERVAL 1 HOUR AS "end", {AGG} FROM (SELECT i.*, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM intraday i CROSS JOIN range(4) r(k))
        WHERE start + INTERVAL 1 HOUR <= (SELECT m FROM mark) GROUP BY 1, 2"""),
    "stream_sessions": st("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM gaps GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT m FROM mark)"""),
    "stream_transitions": st("SELECT ticker, from_state, to_state, date FROM transitions"),
    "stream_transition_append": NEW,
    "stream_transition_dedupe": NEW,
    "stream_dedupe": "SELECT DISTINCT event_type AS ticker, user_id, CAST(ts AS DATE) AS day FROM events",
    "stream_journal": "SELECT DISTINCT event_type AS ticker, user_id, CAST(ts AS DATE) AS day FROM events",
}
