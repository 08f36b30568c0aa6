"""Registered queries: bar store, feeds, snapshots, user files, journal, health."""
from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import board, health
from ..session import materialise
from ..sources import bars as bs
from ..sources import feeds, journal, ledger, snapshots as sn
from ..sources.tables import bars, macro, prints, shares_outstanding, table
from ..streaming import jobs
from .boards import _readiness
from .methodology import latest, scored_table

TODAY = date(2001, 11, 5)
NOW = datetime(2001, 8, 2)
COMPUTED = datetime(2001, 8, 2, 0, 45)


def _store(spark, root):
    """The bars with interval, provider and update time, as a store holds them."""
    return bars(spark, root).select(
        "ticker", F.lit("1d").alias("interval"), "date", "open", "high", "low", "close", "volume", "adj_close",
        F.when(F.col("date") < "1999-01-01", "alpha").otherwise("beta").alias("provider"),
        F.date_add("date", 1).cast("timestamp_ntz").alias("updated_at"),
    )


def _written(spark, root):
    """Path and schema of the bars, written as a stored table."""
    path, store = jobs.scratch(spark, "bar-store"), _store(spark, root)
    bs.write_bars(store, path)
    return path, store.schema


def _read(spark, root):
    r = bs.read_bars(bs.open_store(spark, *_written(spark, root)), ["Brand#3", "Brand#4", "Brand#12"], "1d", "3y", TODAY)
    return rounded(r.select("ticker", "date", "close", "volume"), 10)


def _provenance(spark, root):
    return bs.provenance(_store(spark, root))


def _upsert_bars(spark, root):
    """Even brands resend their 1999 bars with doubled closes."""
    path, schema = _written(spark, root)
    store = _store(spark, root)
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    new = store.where((n % 2 == 0) & (F.year("date") == 1999) & (F.day("date") != 9)).withColumn("close", F.col("close") * 2)
    bs.merge_bars(new, path)
    return rounded(bs.open_store(spark, path, schema).select("ticker", "date", "close"), 10)


def _unique(spark, root):
    store = _store(spark, root)
    again = store.where(F.month("date") == 3).withColumns({"close": F.col("close") + 1, "updated_at": F.date_add("date", 9).cast("timestamp_ntz")})
    return rounded(bs.unique_bars(store.unionByName(again)).select("ticker", "date", "close", "provider"), 10)


def _normalise(spark, root):
    """Raw text bars: a seventh of the closes are not numbers."""
    item = table(spark, root, "lineitem")
    raw = item.select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("close"),
        F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_quantity").cast("string")).alias("volume"),
    )
    return bs.normalise(raw).groupBy("ticker").agg(F.count("*").alias("rows"), F.count("volume").alias("volumes"), F.count("open").alias("opens"), F.count_if(F.col("adj_close") == F.col("close")).alias("same"))


def _usable(spark, root):
    return bs.usable_tickers(bars(spark, root), date(2000, 1, 1), date(2001, 6, 30), 5).select("ticker", "row_count", "first_date", "last_date", "covered", "usable")


def _records(spark, root):
    """Events as provider bar records in JSON, some with broken fields."""
    e = table(spark, root, "events")
    t = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    v = F.col("value").cast("string")
    close = F.when(F.col("event_id") % 13 == 0, "bad").otherwise(v)
    body = F.to_json(F.array(F.struct(t.alias("t"), v.alias("o"), v.alias("h"), v.alias("l"), close.alias("c"), F.lit("100").alias("v"))))
    out = bs.bars_from_records(e.select(F.col("event_type").alias("ticker"), body.alias("payload")))
    return rounded(out.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "close", "volume"))


def _wide(spark, root):
    """Monthly series as one wide table, back to long."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = macro(spark, root).groupBy("date").pivot("series_id", names).agg(F.first("value"))
    return rounded(bs.wide_to_long(wide, "date", "ticker", "close"), 5)


def _sources(spark, root):
    """Fetched rows beat fresh cache, which beats stale cache."""
    store = _store(spark, root)
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    stale = store.where((n <= 20) & (F.col("date") < "1998-01-01"))
    cached = store.where((n % 3 == 0) & (F.col("date") < "2000-01-01"))
    fetched = store.where(n % 5 == 0)
    return bs.merge_sources([("stale_cache", stale), ("fresh_cache", cached), ("live", fetched)])


def _source_report(spark, root):
    return bs.source_report(_sources(spark, root), bars(spark, root).select("ticker").distinct())


def _fund_payloads(spark, root):
    """Fund records as provider JSON text with aliased keys and written-out numbers."""
    s = shares_outstanding(spark, root)
    odd = F.month("as_of") % 2 == 1
    rec = F.when(odd, F.to_json(F.struct(
        F.date_format("as_of", "M/d/yyyy").alias("Trade Date"), F.format_string("%.0f", "shares_outstanding").alias("Shares Outstanding"),
        F.format_string("$%.9f", "nav").alias("NAV"), F.format_string("%.12fM", F.col("aum") / 1e6).alias("Total Net Assets"),
    ))).otherwise(F.to_json(F.struct(
        F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), F.format_string("%.0f", "shares_outstanding").alias("sho"),
        F.format_string("%.9f", "nav").alias("nav"), F.format_string("%,.6f", "aum").alias("aum"),
    )))
    return s.select("ticker", F.when(odd, F.concat(F.lit("["), rec, F.lit("]"))).otherwise(F.concat(F.lit('{"records": ['), rec, F.lit("]}"))).alias("payload"))


def _funds(spark, root):
    return rounded(feeds.fund_records(_fund_payloads(spark, root)), aum=3)


def _snap_store(spark, root):
    p = prints(spark, root)
    s = p.groupBy("ticker", F.last_day("date").alias("as_of")).agg(F.count("*").alias("n"), F.sum("size").alias("q"))
    return s.select(F.lit("tape").alias("provider"), F.lit("prints").alias("dataset"), "ticker", "as_of", F.date_add("as_of", 2).cast("timestamp_ntz").alias("captured_at"),
                    F.concat_ws(":", F.col("n").cast("string"), F.format_string("%.0f", "q")).alias("payload"))


def _snapshot_upsert(spark, root):
    store = sn.with_digest(_snap_store(spark, root))
    again = _snap_store(spark, root).where(F.month("as_of") <= 2).withColumns({"captured_at": F.date_add("as_of", 9).cast("timestamp_ntz"), "payload": F.concat("payload", F.lit(":r"))})
    return sn.upsert(store, sn.with_digest(again), sn.KEYS, "captured_at").select("ticker", "as_of", "captured_at", "payload", "payload_sha256")


def _snapshot_coverage(spark, root):
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    expected = bars(spark, root).select("ticker").distinct()
    return sn.coverage(_snap_store(spark, root).where(n % 4 != 0), expected)


def _cache(spark, root):
    """Responses per customer order, a few with a damaged digest."""
    o = table(spark, root, "orders")
    lane = F.concat(F.lit("lane"), (F.col("o_orderkey") % 3).cast("string"))
    body = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return o.select(
        lane.alias("lane"), F.concat(F.lit("U"), (F.col("o_custkey") % 200).cast("string")).alias("ticker"), F.col("o_orderdate").alias("created_at"),
        body.alias("payload"), F.when(F.col("o_orderkey") % 19 == 0, "x").otherwise(F.sha2(body, 256)).alias("payload_sha256"),
    )


def _fresh(spark, root):
    return sn.fresh(_cache(spark, root), NOW, 30 * 86400).select("lane", "ticker", "payload", "age_seconds")


def _cache_pairs(spark, root):
    c = table(spark, root, "customer").select(F.concat(F.lit("U"), (F.col("c_custkey") % 260).cast("string")).alias("ticker")).distinct()
    return sn.pair_summary(sn.pair_coverage(_cache(spark, root), ["lane0", "lane1", "lane2", "lane3"], c))


def _holding_file(spark, root):
    """Line items as a user's holdings file with text cells."""
    item = table(spark, root, "lineitem")
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    return item.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("row_number"),
        F.when(k % 23 == 0, "").when(k % 29 == 0, "BAD#1").otherwise(F.concat(F.lit(" br"), (F.col("l_partkey") % 25).cast("string"), F.lit(" "))).alias("Symbol"),
        F.when(k % 31 == 0, "many").otherwise(F.format_string("%,.0f", q * 100)).alias("Quantity"),
        F.format_string("$%.2f", "l_extendedprice").alias("Market Value"),
        F.when(k % 3 == 0, F.format_string("%.0f%%", q)).when(k % 3 == 1, F.format_string("%.0f", q)).otherwise("").alias("Weight"),
        F.col("l_returnflag").alias("Account Name"),
    )


def _holding_rows(spark, root):
    out = feeds.parse_holdings(_holding_file(spark, root)).where("ticker is not null")
    return rounded(out.select("row_number", "ticker", "shares", "market_value", "weight", "account"))


def _holding_errors(spark, root):
    return feeds.error_rows(feeds.parse_holdings(_holding_file(spark, root)))


def _trade_file(spark, root):
    item = table(spark, root, "lineitem")
    k = F.col("l_orderkey")
    return item.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("row_number"),
        F.when(k % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("l_shipdate", "M/d/yyyy")).otherwise("soon").alias("Trade Date"),
        F.concat(F.lit("br"), (F.col("l_partkey") % 25).cast("string")).alias("Symbol"),
        F.when(F.col("l_returnflag") == "R", "sold").when(F.col("l_returnflag") == "A", "bot").otherwise("swap").alias("Side"),
        F.format_string("%.0f", "l_quantity").alias("Quantity"),
        F.format_string("$%,.2f", F.col("l_extendedprice")).alias("Price"),
        F.when(k % 4 == 0, "1.25").alias("Fees"),
    )


def _trade_rows(spark, root):
    out = feeds.parse_trades(_trade_file(spark, root)).where("size(errors) = 0")
    return rounded(out.drop("errors"))


def _trade_errors(spark, root):
    e = feeds.error_rows(feeds.parse_trades(_trade_file(spark, root)))
    return e.groupBy("message").agg(F.count("*").alias("rows"), F.min("row_number").alias("first_row"))


def _tokens(spark, root):
    """One list per order: its line items' codes, some repeated, some malformed."""
    item = table(spark, root, "lineitem")
    code = F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("bad#"), (F.col("l_partkey") % 7).cast("string"))).otherwise(F.concat(F.lit("q"), (F.col("l_partkey") % 9).cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", code.alias("code"))))
    lists = item.groupBy(F.col("l_orderkey").alias("list_id")).agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["code"]), ", ")
    return feeds.ticker_tokens(lists.select("list_id", F.concat(F.lit(" "), F.regexp_replace(text, ", q1", " ;q1")).alias("text")))


def _scored_runs(spark, root):
    s = scored_table(spark, root).withColumn("run_id", F.date_format("as_of", "yyyy-MM-dd"))
    return s.select("run_id", "ticker", "class", "state", "S_score", "F_score", "mom_12_1", "mansfield_rs", "rs_ratio", "rs_momentum", "breadth_50d", "cmf21", "stage", "selected")


def _journal_records(spark, root):
    r = journal.score_records(_scored_runs(spark, root))
    return r.select(
        "run_id", "ticker", "asset_class", "state", F.size("pillar_scores").alias("pillars"), F.array_join(F.array_sort(F.map_keys("payload")), ",").alias("payload_keys"), F.element_at("payload", "stage").alias("stage")
    )


def _journal_new(spark, root):
    """Runs up to 2000 are stored; all arrive again, the later ones under new ids too."""
    r = journal.score_records(_scored_runs(spark, root))
    stored = journal.run_digests(r.where("run_id < '2000-01-01'"))
    again = r.withColumn("run_id", F.concat(F.lit("again-"), "run_id"))
    return journal.new_runs(again, stored).groupBy("run_id").agg(F.count("*").alias("rows"))


def _action_documents(spark, root):
    """One action list per order: its line items by flag, with items and groups of odd forms."""
    item, k = table(spark, root, "lineitem"), F.col("l_partkey")
    code, note = F.concat(F.lit("br"), (k % 25).cast("string")), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))
    odd = F.when(k % 7 == 0, F.lit('"loose"')).when(k % 7 == 1, F.lit('{"note": "nobody"}')).when(k % 7 == 2, F.to_json(F.struct(F.lit("").alias("t"), code.alias("ticker"))))
    entry = F.coalesce(odd, F.to_json(F.struct(code.alias("t"), note.alias("note"))))
    groups = item.groupBy("l_orderkey", "l_returnflag").agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ", "), F.lit("]")).alias("list"))
    flag = F.col("l_returnflag")
    head = F.when(flag == "R", '"kind": "exit", "label": "Out", "eta": null').when(flag == "A", '"kind": " Warn ", "state": "WARNING"').otherwise('"label": "Rest"')
    group = F.concat(F.lit("{"), head, F.lit(', "tickers": '), "list", F.lit("}"))
    lists = groups.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_join(F.collect_list(group), ", ").alias("g"))
    whole = F.concat(F.lit('{"actions": ["stray", '), "g", F.lit("]}"))
    return lists.select("run_id", F.when(F.col("run_id") % 17 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("bluf"))


def _journal_decisions(spark, root):
    d = journal.decision_records(_action_documents(spark, root))
    return d.select("run_id", "decision_type", "ticker", "action", "rationale", *[F.element_at("payload", c).alias(c) for c in ("kind", "label", "eta", "state")])


def _run_tables(spark, root, prefix: str = ""):
    """Runs, scores and decisions of every scored date. With a prefix they come again under new ids:
    the notes of one month in three and the metadata of another one changed."""
    s, month = _scored_runs(spark, root), F.month(F.to_date("run_id")) % 3
    again = F.lit(bool(prefix))
    kind = F.when(F.col("state").isin("EXIT", "BEARISH_STAGE_4"), "exit").when(F.col("state") == "WARNING", "warn").when(F.col("state") == "STAGE_2_BULLISH", "buy")
    note = F.concat(F.col("state"), F.when(again & (month == 1), "!").otherwise(""))
    item = F.array(F.struct(F.col("ticker").alias("t"), note.alias("note")))
    docs = s.select("run_id", F.to_json(F.struct(F.array(F.struct(kind.alias("kind"), item.alias("tickers"))).alias("actions"))).alias("bluf")).where(kind.isNotNull())
    runs = s.groupBy("run_id").agg(F.lit(None).cast("string").alias("git_sha")).select(
        "run_id", F.concat("run_id", F.lit("T00:00:00+00:00")).alias("started_at_utc"), "git_sha", F.lit("1").alias("app_version"), F.lit("alpha").alias("provider"),
        F.create_map(F.lit("note"), F.when(again & (month == 2), "new").otherwise("old")).alias("metadata"),
    )
    tables = runs, journal.score_records(s), journal.decision_records(docs)
    return [df.withColumn("run_id", F.concat(F.lit(prefix), "run_id")) for df in tables]


def _journal_runs(spark, root):
    """Runs up to 2000 are appended, twice by the same token; then all come again under new ids."""
    path = jobs.scratch(spark, "run-journal")
    base = [df.where("run_id < '2000-01-01'") for df in _run_tables(spark, root)]
    for token in ("base", "base"):
        journal.append_runs(*base, path, token)
    again = _run_tables(spark, root, "again-")
    journal.append_runs(*again, path, "again")
    read = lambda name, df: ledger.read(spark, path, df.schema, name)
    count = lambda df, c: df.groupBy("run_id").agg(F.count("*").alias(c))
    runs = read("runs", journal.run_records(*again))
    out = runs.join(count(read("scores", again[1]), "scores"), "run_id", "left").join(count(read("decisions", again[2]), "decisions"), "run_id", "left")
    return out.select(
        "run_id", F.regexp_extract("journal_id", r"^(dashboard-\w+)-[0-9a-f]{12}$", 1).alias("journal_stem"), "provider", "universe_count", "scores",
        F.coalesce("decisions", F.lit(0)).alias("decisions"), F.element_at("metadata", "note").alias("note"),
    )


def _snapshot_counts(spark, root):
    """States, quadrants and decisions of the latest scored date."""
    now = materialise(latest(scored_table(spark, root)))
    run = now.select(F.date_format("as_of", "yyyy-MM-dd").alias("run_id")).distinct()
    return board.counts(now, _run_tables(spark, root)[2].join(run, "run_id", "left_semi"))


def _fund_csv(spark, root):
    """Fund files of two kinds: columns in another order, other names, a line before the header."""
    path, s = jobs.scratch(spark, "fund-csv"), shares_outstanding(spark, root)
    odd = F.month("as_of") % 2 == 1
    first = s.where(odd).select(F.date_format("as_of", "M/d/yyyy").alias("As Of"), F.format_string("%.0f", "shares_outstanding").alias("Shares Outstanding"),
                                F.format_string("$%.9f", "nav").alias("NAV"), F.format_string("%.6f", "aum").alias("AUM"), "ticker")
    second = s.where(~odd).select("ticker", F.format_string("%,.6f", "aum").alias("aum"), F.format_string("%.9f", "nav").alias("nav"),
                                  F.format_string("%.0f", "shares_outstanding").alias("shares_outstanding"), F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))
    for name, df in (("odd", first), ("even", second)):
        df.write.option("header", True).csv(f"{path}/{name}")
    return rounded(feeds.read_fund_csv(spark, f"{path}/*"), aum=3)


def _filing_table(spark, root):
    """Line items as a filing table: a tab-separated file with its own header."""
    path, item = jobs.scratch(spark, "filings"), table(spark, root, "lineitem")
    day = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "M/d/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    item.select(
        F.concat(F.lit("c "), F.col("l_partkey").cast("string")).alias("CUSIP"), day.alias("REPORTCALENDARORQUARTER"), F.format_string("%,.0f", "l_quantity").alias("SSHPRNAMT")
    ).write.option("header", True).option("sep", "\t").csv(path)
    return rounded(feeds.read_filings(spark, path))


def _csv_artefact(spark, root):
    """The weights of every rebalance as a report file, read back."""
    path = jobs.scratch(spark, "artefact")
    df = scored_table(spark, root).select("as_of", "ticker", "class", "state", "selected")
    journal.write_csv(df, path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


def _journal_read(spark, root):
    o = table(spark, root, "orders")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    runs = journal.latest_runs(o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at")).groupBy("run_id").agg(F.max("started_at").alias("started_at")), 50)
    items = table(spark, root, "lineitem").join(part, "l_partkey")
    scores = items.groupBy(F.col("l_orderkey").alias("run_id"), F.upper("ticker").alias("ticker")).agg(F.sum("l_quantity").alias("s_score"))
    dec = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), "ticker", F.lit("EXIT").alias("action")).distinct()
    return rounded(journal.run_details(runs, scores, dec))


LIMITS = [("1-URGENT", 100), ("2-HIGH", 100), ("3-MEDIUM", None), ("9-GONE", 7)]


def _data_health(spark, root):
    b = bars(spark, root)
    expected = b.select("ticker").distinct()
    limits = spark.createDataFrame(LIMITS, "series_id string, fresh_days int")
    rows = health.health_rows(
        health.bar_health(_store(spark, root), expected, TODAY), health.series_health(macro(spark, root), limits, TODAY), health.provider_lane(_readiness(spark, root)),
        health.compute_health(table(spark, root, "orders").agg(F.max("o_orderdate").alias("created_at")), COMPUTED),
    )
    return health.with_summary(rows)


QUERIES = {
    "bars_read": _read,
    "bars_provenance": _provenance,
    "bars_upsert": _upsert_bars,
    "bars_unique": _unique,
    "bars_normalise": _normalise,
    "bars_usable": _usable,
    "provider_records": _records,
    "wide_to_long": _wide,
    "source_report": _source_report,
    "provider_mix": lambda s, d: bs.provider_mix(_sources(s, d)),
    "fund_records": _funds,
    "fund_csv": _fund_csv,
    "filing_table": _filing_table,
    "csv_artefact": _csv_artefact,
    "snapshot_counts": _snapshot_counts,
    "snapshot_upsert": _snapshot_upsert,
    "snapshot_history": lambda s, d: sn.history(_snap_store(s, d), "tape", "prints", "Brand#7").select("ticker", "as_of", "captured_at", "payload"),
    "snapshot_coverage": lambda s, d: _snapshot_coverage(s, d),
    "snapshot_state": lambda s, d: sn.coverage_state(_snapshot_coverage(s, d)),
    "cache_fresh": _fresh,
    "cache_coverage": _cache_pairs,
    "cache_status": lambda s, d: sn.status(_cache(s, d)),
    "holdings_ingest": _holding_rows,
    "holdings_errors": _holding_errors,
    "trades_ingest": _trade_rows,
    "trades_errors": _trade_errors,
    "ticker_lists": lambda s, d: feeds.ticker_list(_tokens(s, d)),
    "ticker_list_errors": lambda s, d: feeds.token_errors(_tokens(s, d)),
    "journal_records": _journal_records,
    "journal_new_runs": _journal_new,
    "journal_decisions": _journal_decisions,
    "journal_runs": _journal_runs,
    "journal_read": _journal_read,
    "data_health": _data_health,
}
