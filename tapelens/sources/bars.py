"""Bars table: read, write, normalise, check, merge."""
from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.calendar import period_start
from ..functions.columns import nullable_double
from ..session import materialise

PRICES = ("open", "high", "low", "close", "volume", "adj_close")
# Limits of a usable history.
MIN_ROWS = 30
COVERAGE_DAYS = 10
MIN_COVERAGE = 0.75


def read_bars(store: DataFrame, tickers: list[str], interval: str, period: str, today: date) -> DataFrame:
    """Pruned read: ticker, interval and date predicates reach the scan.

    Of a stored table (``open_store``) only the partitions of the interval and the years asked for are listed,
    and row groups are skipped by the statistics of their sorted tickers.
    """
    start = period_start(period, today)
    rows = store.where(F.col("ticker").isin(*tickers) & (F.col("interval") == interval) & (F.col("date") >= F.lit(start)))
    return rows.where(F.col("year") >= start.year).drop("year") if "year" in store.columns else rows


def provenance(rows: DataFrame) -> DataFrame:
    """Provider of the newest bar and newest update per ticker."""
    return rows.groupBy("ticker").agg(
        F.max_by("provider", "date").alias("provider"), F.max("updated_at").alias("updated_at"), F.count("*").alias("rows")
    )


def normalise(raw: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Day keys, numeric coercion, adj_close from close, rows without a close dropped."""
    cols = {c: nullable_double(c) if c in raw.columns else F.lit(None).cast("double") for c in PRICES}
    if "adj_close" not in raw.columns:
        cols["adj_close"] = cols["close"]
    day = F.to_date("date")
    return raw.select(F.col(ticker).alias("ticker"), day.alias("date"), *[v.alias(k) for k, v in cols.items()]).where(
        "close is not null"
    )


def replace_range(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """New contents of the store: each (ticker, interval) drops its incoming date range first (S3).

    The ranges are one aggregated row per ticker and interval.
    """
    span = incoming.groupBy("ticker", "interval").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    kept = store.join(span, ["ticker", "interval"], "left").where("_lo is null or date < _lo or date > _hi")
    return kept.drop("_lo", "_hi").unionByName(incoming)


#: Files that the tickers of one partition are dealt to.
FILES = 4


def write_bars(rows: DataFrame, path: str) -> None:
    """Write whole partitions of the store: one per interval and year, tickers dealt to files.

    Files are sorted by ticker and date, so that row-group statistics prune. Partitions without
    rows here stay as they are. A ticker has at most one bar a day in a file, however many
    prints it has.
    """
    dealt = F.pmod(F.xxhash64("ticker"), F.lit(FILES))
    (
        rows.withColumn("year", F.year("date") if "year" not in rows.columns else F.col("year"))
        .repartition("interval", "year", dealt)
        .sortWithinPartitions("interval", "year", "ticker", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("interval", "year")
        .parquet(path)
    )


def open_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored bars with their partition column ``year``; ``schema`` is that of the bars."""
    return spark.read.schema(StructType([*schema.fields, StructField("year", IntegerType())])).parquet(path).where("ticker is not null")


def merge_bars(incoming: DataFrame, path: str) -> list[tuple[str, int]]:
    """Replace the incoming date ranges in a stored table; returns the partitions that were rewritten (S3).

    Only partitions that a range touches are read and written: at most one per interval and year, so
    their list is small. Their new rows are written to the checkpoint folder first, so that nothing
    is overwritten that is still being read. A row without a ticker in each of them makes sure that a
    partition is replaced even if no bar of it is left; ``open_store`` leaves such rows out.
    """
    spark = incoming.sparkSession
    span = incoming.groupBy("ticker", "interval").agg(F.year(F.min("date")).alias("lo"), F.year(F.max("date")).alias("hi"))
    years = span.select("interval", F.explode(F.sequence("lo", "hi")).alias("year")).distinct()
    touched = sorted((r["interval"], r["year"]) for r in years.collect())
    if not touched:
        return touched
    inside = reduce(or_, [(F.col("interval") == i) & F.col("year").isin(*[y for j, y in touched if j == i]) for i in sorted({i for i, _ in touched})])
    stored = open_store(spark, path, incoming.schema).where(inside).drop("year")
    marks = years.select(*[F.col(c) if c == "interval" else F.lit(None).cast(t).alias(c) for c, t in incoming.dtypes], "year")
    new = replace_range(stored, incoming).withColumn("year", F.year("date")).unionByName(marks)
    write_bars(materialise(new), path)
    return touched


def unique_bars(rows: DataFrame, order: str = "updated_at") -> DataFrame:
    """Latest write wins per (ticker, interval, date)."""
    keys = ["ticker", "interval", "date"]
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order)
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def usable_tickers(rows: DataFrame, start: date, today: date, stale_days: int, allow_stale: bool = False) -> DataFrame:
    """Per-ticker usability of a history."""
    requested = F.col("date") >= F.lit(start)
    weekday = F.weekday("date") < 5
    inside = requested & (F.col("date") <= F.lit(today))
    stats = rows.groupBy("ticker").agg(
        F.count_if(requested).alias("row_count"),
        F.min("date").alias("first_date"),
        F.max(F.when(requested, F.col("date"))).alias("last_date"),
        F.count_distinct(F.when(inside & weekday, F.col("date"))).alias("covered"),
    )
    expected = sum(1 for i in range((today - start).days + 1) if (start + timedelta(days=i)).weekday() < 5)
    fresh = F.lit(True) if allow_stale else F.col("last_date") >= F.lit(today - timedelta(days=stale_days))
    ok = (
        (F.col("row_count") > MIN_ROWS)
        & (F.col("first_date") <= F.lit(start + timedelta(days=COVERAGE_DAYS)))
        & fresh
        & (F.lit(True) if expected == 0 else F.col("covered") / expected >= MIN_COVERAGE)
    )
    return stats.withColumn("usable", F.coalesce(ok, F.lit(False)))


def bars_from_records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON arrays of {t,o,h,l,c,v} to bars; a record with a bad field is dropped."""
    schema = "array<struct<t:string,o:string,h:string,l:string,c:string,v:string>>"
    r = payloads.select("ticker", F.explode(F.from_json(column, schema)).alias("r"))
    num = {k: F.col(f"r.{k}").try_cast("double") for k in "ohlcv"}
    ts = F.timestamp_millis(F.col("r.t").try_cast("bigint"))
    out = r.select(
        "ticker",
        ts.alias("ts"),
        num["o"].alias("open"),
        num["h"].alias("high"),
        num["l"].alias("low"),
        num["c"].alias("close"),
        num["v"].alias("volume"),
        num["c"].alias("adj_close"),
    )
    return out.dropna(how="any")


def wide_to_long(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One column per instrument to one row per instrument and date."""
    columns = [c for c in wide.columns if c != key]
    return wide.unpivot([key], columns, name, value).where(F.col(value).isNotNull())


def pseudo_bars(series: DataFrame, scale: float = 1.0) -> DataFrame:
    """A macro series as flat bars with no volume."""
    v = F.col("value") * scale
    return series.where("value is not null").select(
        F.col("series_id").alias("ticker"),
        "date",
        *[v.alias(c) for c in ("open", "high", "low", "close", "adj_close")],
        F.lit(0.0).alias("volume"),
    )


def merge_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the strongest source per ticker; later list entries win.

    The winner is chosen on the distinct (ticker, source) pairs, not on bars.
    """
    tagged = None
    for rank, (name, rows) in enumerate(sources):
        one = rows.withColumns({"source": F.lit(name), "_rank": F.lit(rank)})
        tagged = one if tagged is None else tagged.unionByName(one)
    best = tagged.groupBy("ticker").agg(F.max("_rank").alias("_rank"))
    return tagged.join(best, ["ticker", "_rank"]).drop("_rank")


def source_report(merged: DataFrame, expected: DataFrame) -> DataFrame:
    """Source and provider of each expected ticker; missing ones are labelled."""
    found = merged.groupBy("ticker").agg(F.max_by("source", "date").alias("source"), F.max_by("provider", "date").alias("provider"))
    return expected.join(found, "ticker", "left").select(
        "ticker", F.coalesce("source", F.lit("missing")).alias("source"), F.coalesce("provider", F.lit("none")).alias("provider")
    )


def provider_mix(merged: DataFrame) -> DataFrame:
    return merged.groupBy("provider").agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("rows"))


def first_positions(tokens: DataFrame, keys: list[str], token: str, pos: str) -> DataFrame:
    """Order-preserving dedupe: first position and repeat count."""
    return tokens.groupBy(*keys, token).agg(F.min(pos).alias("first_pos"), F.count("*").alias("times"))
