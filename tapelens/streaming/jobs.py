"""Structured Streaming versions of the bar, transition and journal jobs."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.states import KEYS, normalise_transitions
from ..session import checkpoint_folder
from ..sources import ledger

TRANSITION = "ticker string, from_state string, to_state string, date date"


def read_folder(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def bars(prints: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Prints to tumbling or sliding bars; rows later than the watermark are dropped.

    The window aggregate combines map-side, so a hot ticker shuffles one partial row
    per task and window.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    first, last = F.min(F.struct("ts", "seq", "price")), F.max(F.struct("ts", "seq", "price"))
    return (
        prints.withWatermark("ts", late)
        .groupBy("ticker", window.alias("w"))
        .agg(
            first.alias("_f"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("_l"), F.sum("size").alias("volume"), F.count("*").alias("prints")
        )
        .select(
            "ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("_f.price").alias("open"), "high", "low", F.col("_l.price").alias("close"), "volume", "prints"
        )
    )


def sessions(activity: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per key (T5)."""
    return (
        activity.withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def dedupe(rows: DataFrame, keys: list[str], period: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """First arrival per key and period of event time (T3), with the period's start as ``start``.

    The period is part of the key, so the rows don't depend on how the input is cut into
    batches, and the state of a period goes when the watermark has passed it.
    """
    timed = rows.withWatermark("ts", late).withColumn("period", F.window("ts", period))
    return timed.dropDuplicates([*keys, "period"]).select(*keys, F.col("period.start").alias("start"))


class _Changes(StatefulProcessor):
    """State changes of a ticker; the state is its last known value and date.

    Rows that are not newer than that date came too late to have a place in the sequence: they go.
    A timer of event time drops the state of a ticker that was silent for ``quiet_days``.
    """

    def __init__(self, quiet_days: int):
        self.quiet_days = quiet_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, as_of date")

    def _remember(self, state: str, as_of: date) -> None:
        self.last.update((state, as_of))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        end = datetime(as_of.year, as_of.month, as_of.day, tzinfo=timezone.utc) + timedelta(days=self.quiet_days)
        self.handle.registerTimer(int(end.timestamp() * 1000))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.loc[initialState["as_of"].idxmax()]
        self._remember(newest["state"], newest["as_of"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["as_of", "state"])
        last, seen = self.last.get() if self.last.exists() else (None, None)
        if seen is not None:
            got = got[got["as_of"] > seen]
        if got.empty:
            return
        before = got["state"].shift()
        before.iloc[0] = last
        self._remember(got["state"].iloc[-1], got["as_of"].iloc[-1])
        moved = got[before.notna() & (before != got["state"])]
        yield pd.DataFrame({"ticker": key[0], "from_state": before[moved.index], "to_state": moved["state"], "date": moved["as_of"], "at": moved["at"]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=["ticker", "from_state", "to_state", "date", "at"])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which typed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _moves(states: DataFrame, stored: DataFrame | None, late: str, quiet_days: int) -> DataFrame:
    day = F.col("as_of").cast("date")
    rows = states.where("state is not null and as_of is not null").select("ticker", day.alias("as_of"), "state", day.cast("timestamp").alias("at"))
    known = None if stored is None else stored.where("state is not null and as_of is not null").select("ticker", day.alias("as_of"), "state").groupBy("ticker")
    return rows.withWatermark("at", late).groupBy("ticker").transformWithStateInPandas(
        _Changes(quiet_days), TRANSITION + ", at timestamp", "Append", "EventTime", known, "at"
    )


def transitions(states: DataFrame, stored: DataFrame | None = None, late: str = "30 days", quiet_days: int = 400) -> DataFrame:
    """Stateful transition detector keyed by ticker.

    The store holds one word and one date per ticker, from ``stored`` (ticker, as_of, state) on, and
    forgets a ticker that was silent for ``quiet_days``. A micro-batch brings a ticker one row per
    rebalance date, so a group is bounded by the dates that arrived. The same rule as the batch
    ``lag`` version. Start it inside ``rocksdb``.
    """
    return _moves(states, stored, late, quiet_days).drop("at")


def _once(moves: DataFrame, journal: DataFrame | None) -> DataFrame:
    named = normalise_transitions(moves, "at").dropDuplicatesWithinWatermark(KEYS).drop("at")
    return named if journal is None else named.join(normalise_transitions(journal), KEYS, "left_anti")


def dedupe_transitions(moves: DataFrame, journal: DataFrame | None = None, late: str = "30 days") -> DataFrame:
    """First arrival of every transition by its four keys, without those that the journal has.

    A repeat is told as long as it arrives within ``late`` of the first one in event time.
    """
    return _once(moves.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late), journal)


def new_transitions(states: DataFrame, journal: DataFrame | None = None, stored: DataFrame | None = None, late: str = "30 days", quiet_days: int = 400) -> DataFrame:
    """Detector and dedupe in one job: transitions that the journal lacks."""
    return _once(_moves(states, stored, late, quiet_days), journal)


def journal_sink(path: str, keys: list[str], day: str | None = None):
    """``foreachBatch`` writer that appends only rows whose keys the table lacks, exactly once (T4).

    A batch is written into a folder of its own and counts from its commit on, which is named by
    batch id and an order-free digest of the batch: a batch that is repeated after a failure, before
    or after the commit, leaves each row once. With ``day`` (one of the keys) the table is
    partitioned by it, and a batch reads back only the days that it holds.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        half = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *keys).cast("decimal(38,0)")), F.lit(0)).cast("string")
        ends = [F.min(day).alias("first"), F.max(day).alias("last")] if day is not None else []
        seen = batch.agg(F.substring(F.sha2(F.concat_ws("|", half(1), half(2)), 256), 1, 16).alias("digest"), *ends).first()
        token = f"b{batch_id}-{seen.digest}"
        if ledger.committed(spark, path, token):
            return
        inside = None if day is None else F.col(day).between(seen["first"], seen["last"])
        stored = ledger.read(spark, path, batch.schema, where=inside).select(*keys)
        fresh = batch.dropDuplicates(keys).join(stored, keys, "left_anti").select(*batch.columns)
        ledger.append({"": fresh}, path, token, None if day is None else [day])

    return write


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    base = checkpoint_folder(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available into a table and return that table.

    The table holds what the stream has finished: windows and sessions that the final
    watermark has not passed are still open and come with later input.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, name + "-state")
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_journal(stream: DataFrame, path: str, keys: list[str], day: str | None = None) -> DataFrame:
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(journal_sink(path, keys, day)).option("checkpointLocation", scratch(spark, "journal-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return ledger.read(spark, path, stream.schema)
