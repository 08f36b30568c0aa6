"""Run journal: three append-only tables, content digests, reads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ledger

# Pillar columns kept in their own map.
PILLAR_COLUMNS = ("mom_12_1", "mansfield_rs", "rs_ratio", "rs_momentum", "breadth_50d", "cmf21")
PRIMARY = ("run_id", "ticker", "class", "state", "S_score", "F_score")


# Action of each list kind.
ACTIONS = {"exit": "EXIT", "warn": "WATCH", "buy": "BUY"}


def _map_of(cols: list[str], cast: str) -> Column:
    """Named columns as a map without its nulls."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast(cast).alias("v")) for c in cols])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def score_records(scored: DataFrame) -> DataFrame:
    """Journal form of a scored table: primary columns, pillar map, payload map."""
    pillars = [c for c in PILLAR_COLUMNS if c in scored.columns]
    extra = [c for c in scored.columns if c not in PRIMARY and c not in pillars]

    return scored.select(
        "run_id",
        F.upper("ticker").alias("ticker"),
        F.col("class").alias("asset_class"),
        "state",
        F.col("S_score").alias("s_score"),
        F.col("F_score").alias("f_score"),
        _map_of(pillars, "double").alias("pillar_scores"),
        _map_of(extra, "string").alias("payload"),
    )


def decision_records(documents: DataFrame, text: str = "bluf") -> DataFrame:
    """Decisions out of nested action lists, one row per listed ticker.

    ``documents`` has run_id and the JSON text of one or more action lists of the run. Lists are read
    as variants: groups and items that aren't objects, items without a ticker and texts that aren't
    JSON give no row. A group without a kind asks for a review.
    """
    get = lambda c, path, kind="string": F.try_variant_get(c, path, kind)
    is_object = lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT"))
    lists = documents.select("run_id", F.explode(get(F.try_parse_json(text), "$.actions", "array<variant>")).alias("g")).where(is_object(F.col("g")))
    kind = F.lower(F.trim(F.coalesce(get("g", "$.kind"), F.lit(""))))
    groups = lists.select(
        "run_id", kind.alias("kind"), *[get("g", f"$.{c}").alias(c) for c in ("label", "eta", "state")], F.explode(get("g", "$.tickers", "array<variant>")).alias("i")
    ).where(is_object(F.col("i")))
    named = F.when(F.col("kind") == "", "REVIEW").otherwise(F.upper("kind"))
    for name, word in ACTIONS.items():
        named = F.when(F.col("kind") == name, word).otherwise(named)
    ticker = F.coalesce(F.nullif(get("i", "$.t"), F.lit("")), F.nullif(get("i", "$.ticker"), F.lit("")))
    return groups.where(ticker.isNotNull()).select(
        "run_id",
        F.lit("bluf").alias("decision_type"),
        F.upper(ticker).alias("ticker"),
        named.alias("action"),
        get("i", "$.note").alias("rationale"),
        _map_of(["kind", "label", "eta", "state"], "string").alias("payload"),
    )


def _row_digest(rows: DataFrame) -> DataFrame:
    """Order-free digest per run of (run_id, body): each row is hashed where it lives.

    A run then sums its row hashes in three parts, so no task ever holds a run's rows.
    """
    h = F.sha2("body", 256)
    part = lambda i: F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")
    g = rows.groupBy("run_id").agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"_h{i}") for i in (1, 13, 25)])
    return g.select("run_id", F.col("n").alias("rows"), F.substring(F.sha2(F.concat_ws("|", "n", "_h1", "_h13", "_h25"), 256), 1, 12).alias("digest"))


def _bodies(records: DataFrame, tag: str | None = None) -> DataFrame:
    """(run_id, body): a record's content as JSON, maps in key order."""
    kinds = dict(records.dtypes)
    sort = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c)
    cols = [sort(c) if kinds[c].startswith("map") else F.col(c) for c in records.columns if c != "run_id"]
    return records.select("run_id", F.to_json(F.struct(*([F.lit(tag).alias("_tag")] if tag else []), *cols)).alias("body"))


def run_digests(records: DataFrame) -> DataFrame:
    """Order-free digest of every run's scores."""
    return _row_digest(_bodies(records))


def content_digests(runs: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Order-free digest of a run's scores, decisions and metadata together."""
    rows = _bodies(scores, "score").unionByName(_bodies(decisions, "decision")).unionByName(_bodies(runs.select("run_id", "metadata"), "metadata"))
    return _row_digest(rows).select("run_id", "digest")


def run_records(runs: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run table: journal id from start time and content, provenance, universe size, metadata.

    ``runs`` has one row per run: run_id, started_at_utc, git_sha, app_version, provider, metadata.
    """
    size = scores.groupBy("run_id").agg(F.count("*").alias("universe_count"))
    df = runs.join(content_digests(runs, scores, decisions), "run_id").join(size, "run_id", "left")
    stamp = F.regexp_replace(F.regexp_replace("started_at_utc", r"\+00:00", "Z"), "[^0-9A-Za-z]", "")
    seal = F.to_json(F.struct(F.col("app_version"), F.col("digest").alias("content_digest"), "git_sha", "provider"))
    return df.select(
        *runs.columns,
        F.coalesce("universe_count", F.lit(0)).alias("universe_count"),
        "digest",
        F.concat_ws("-", F.lit("dashboard"), stamp, "digest").alias("journal_id"),
        F.substring(F.sha2(seal, 256), 1, 16).alias("fingerprint"),
    )


def append_runs(runs: DataFrame, scores: DataFrame, decisions: DataFrame, path: str, token: str) -> bool:
    """Append the runs whose content the journal lacks, in one commit over its three tables.

    Of incoming runs with one content the one with the smallest id is new. A token that is published
    already appends nothing; a failed append leaves nothing that readers see.
    """
    spark = runs.sparkSession
    records = run_records(runs, scores, decisions)
    stored = ledger.read(spark, path, records.schema, "runs").select("digest")
    first = records.groupBy("digest").agg(F.min("run_id").alias("run_id")).join(stored, "digest", "left_anti").select("run_id")
    pick = lambda df: df.join(first, "run_id", "left_semi")
    return ledger.append({"scores": pick(scores), "decisions": pick(decisions), "runs": pick(records)}, path, token)


def new_runs(incoming: DataFrame, journal_digests: DataFrame) -> DataFrame:
    """Records of runs whose content the journal lacks."""
    fresh = run_digests(incoming).join(journal_digests.select("digest").distinct(), "digest", "left_anti")
    return incoming.join(fresh.select("run_id"), "run_id", "left_semi")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """Newest n runs (S26): a top-k report."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def run_details(runs: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Scores of the given runs with their decisions."""
    s = scores.join(runs.select("run_id"), "run_id", "left_semi")
    d = decisions.select("run_id", F.upper("ticker").alias("ticker"), "action")
    return s.join(d, ["run_id", "ticker"], "left")


def write_csv(df: DataFrame, path: str) -> None:
    """Report artefact."""
    df.write.mode("overwrite").option("header", True).csv(path)
