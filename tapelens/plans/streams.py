"""Registered queries: streaming jobs drained over the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators.states import transitions as batch_transitions
from ..sources.tables import table
from ..streaming import jobs
from .methodology import scored_table


def _events(spark, root):
    """The event file as a stream of prints."""
    schema = table(spark, root, "events").schema
    e = jobs.read_folder(spark, root, schema, "events.parquet")
    size = F.get_json_object("props", "$.k").cast("double") * 1000
    return e.select(
        F.col("event_type").alias("ticker"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size")
    )


def _plain(df):
    """Window bounds as wall-clock values, whatever the session's zone."""
    return rounded(df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


def _states_folder(spark, root):
    folder = jobs.scratch(spark, "states")
    scored_table(spark, root).select("ticker", "as_of", "state").write.parquet(folder)
    return folder


def _transitions(spark, root):
    states = jobs.read_folder(spark, _states_folder(spark, root), "ticker string, as_of date, state string")
    return jobs.drain(jobs.transitions(states), "transitions")


def _transition_append(spark, root):
    """Detector and dedupe in one job over states that arrive twice; history before 2000 is the journal."""
    folder = jobs.scratch(spark, "states-twice")
    rows = scored_table(spark, root).select("ticker", "as_of", "state")
    for _ in range(2):
        rows.write.mode("append").parquet(folder)
    states = jobs.read_folder(spark, folder, "ticker string, as_of date, state string")
    journal = batch_transitions(scored_table(spark, root)).where("date < date'2000-01-01'")
    return jobs.drain(jobs.new_transitions(states, journal), "new-transitions")


def _transition_dedupe(spark, root):
    """All transitions arrive twice; history before 2000 is the journal."""
    folder, moves = jobs.scratch(spark, "moves-twice"), batch_transitions(scored_table(spark, root))
    for _ in range(2):
        moves.write.mode("append").parquet(folder)
    stream = jobs.read_folder(spark, folder, jobs.TRANSITION)
    return jobs.drain(jobs.dedupe_transitions(stream, moves.where("date < date'2000-01-01'")), "moves")


def _dedupe(spark, root):
    keys = ["ticker", "user_id"]
    out = jobs.drain(jobs.dedupe(_events(spark, root), keys), "dedupe")
    return out.select(*keys, F.col("start").cast("timestamp_ntz").cast("date").alias("day"))


def _journal(spark, root):
    """Two drains of the same stream: the second one adds nothing."""
    keys = ["ticker", "user_id", "day"]
    path = jobs.scratch(spark, "journal")
    rows = lambda: _events(spark, root).withColumn("day", F.to_date("ts")).select(*keys)
    jobs.drain_journal(rows(), path, keys, "day")
    return jobs.drain_journal(rows(), path, keys, "day")


QUERIES = {
    "stream_bars": lambda s, d: _plain(jobs.drain(jobs.bars(_events(s, d)), "bars")),
    "stream_sliding_bars": lambda s, d: _plain(jobs.drain(jobs.bars(_events(s, d), "1 hour", "15 minutes"), "sliding")),
    "stream_sessions": lambda s, d: _plain(jobs.drain(jobs.sessions(_events(s, d), "user_id"), "sessions")),
    "stream_transitions": _transitions,
    "stream_transition_append": _transition_append,
    "stream_transition_dedupe": _transition_dedupe,
    "stream_dedupe": _dedupe,
    "stream_journal": _journal,
}
