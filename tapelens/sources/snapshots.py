"""Provider snapshot and response tables: upsert, history, coverage, freshness."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["provider", "dataset", "ticker", "as_of"]


def with_digest(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """sha-256 of the payload's JSON text."""
    body = F.to_json(payload) if dict(rows.dtypes)[payload] != "string" else F.col(payload)
    return rows.withColumn("payload_sha256", F.sha2(body, 256))


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the newest by the timestamp ``order``, of equally new ones that with the greatest hash.

    Time and hash are one number, so the aggregate holds no payloads and never sorts; rows come back
    by an equi-join on key and number.
    """
    time = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(1 << 55))).cast("decimal(38,0)")
    rank = (time * F.lit(1 << 62).cast("decimal(20,0)")).cast("decimal(38,0)") + F.shiftrightunsigned(F.xxhash64(*rows.columns), 2).cast("decimal(38,0)")
    ranked = rows.distinct().withColumn("_rank", rank.cast("decimal(38,0)"))
    best = ranked.groupBy(*keys).agg(F.max("_rank").alias("_best"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    return ranked.alias("r").join(best.alias("b"), same & (F.col("_rank") == F.col("_best")), "left_semi").drop("_rank")


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows whose key doesn't arrive, and the newest arriving row of each key.

    The store has one row per key. It takes part in one anti-join and is neither aggregated nor
    sorted by payload; only arriving rows are compared with each other.
    """
    keep = store.alias("s").join(incoming.select(*keys).distinct().alias("i"), keys, "left_anti")
    return keep.select(*store.columns).unionByName(newest(incoming, keys, order).select(*store.columns))


def history(store: DataFrame, provider: str, dataset: str, ticker: str) -> DataFrame:
    """Snapshots of one ticker in date order."""
    return store.where((F.col("provider") == provider) & (F.col("dataset") == dataset) & (F.col("ticker") == ticker)).orderBy("as_of")


def coverage(store: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected tickers with their newest snapshot."""
    have = store.groupBy("ticker").agg(F.max("as_of").alias("latest_as_of"), F.max("captured_at").alias("latest_captured_at"), F.count("*").alias("snapshots"))
    return expected.join(have, "ticker", "left").withColumn("covered", F.col("snapshots").isNotNull())


def coverage_state(cover: DataFrame) -> DataFrame:
    """Counts and state of a coverage table, one row."""
    a = cover.agg(
        F.count("*").alias("expected_ticker_count"), F.count_if("covered").alias("covered_ticker_count"), F.max("latest_as_of").alias("latest_as_of")
    ).withColumn("missing_ticker_count", F.col("expected_ticker_count") - F.col("covered_ticker_count"))
    return a.withColumn(
        "state", F.when(F.col("covered_ticker_count") == 0, "empty").when(F.col("missing_ticker_count") > 0, "incomplete").otherwise("ready")
    )


def fresh(cache: DataFrame, now, ttl_seconds: int, allow_stale: bool = False) -> DataFrame:
    """Readable responses: intact payload and inside the time to live."""
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit(now)) - F.unix_timestamp("created_at"))
    df = cache.where(F.sha2("payload", 256) == F.col("payload_sha256")).withColumn("age_seconds", age)
    df = df.withColumn("is_fresh", F.col("age_seconds") <= ttl_seconds)
    return df if allow_stale else df.where("is_fresh")


def pair_coverage(cache: DataFrame, lanes: list[str], tickers: DataFrame) -> DataFrame:
    """Every expected lane and ticker with its newest response.

    The lanes are a configured list, so tickers fan out by an array literal.
    """
    want = tickers.select("ticker", F.explode(F.array(*[F.lit(x) for x in lanes])).alias("lane"))
    have = cache.groupBy("lane", "ticker").agg(F.max("created_at").alias("latest"))
    return want.join(have, ["lane", "ticker"], "left").withColumn("covered", F.col("latest").isNotNull())


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Covered share per lane and over all lanes."""
    g = pairs.rollup("lane").agg(F.count("*").alias("expected"), F.count_if("covered").alias("covered"), F.grouping("lane").alias("_a"))
    return g.select(
        F.when(F.col("_a") == 1, "all").otherwise(F.col("lane")).alias("lane"), "expected", "covered", F.round(F.col("covered") / F.col("expected"), 6).alias("coverage_ratio")
    )


def status(cache: DataFrame) -> DataFrame:
    """Row count and newest response, one row."""
    a = cache.agg(F.count("*").alias("rows"), F.max("created_at").alias("latest_created_at"))
    return a.withColumn("state", F.when(F.col("rows") > 0, "ready").otherwise("empty"))
