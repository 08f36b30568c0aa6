"""Provider lanes: ETF flow, block tape, dark pool, short interest, institutional filings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a print a block.
BLOCK_SIZE = 10000.0
BLOCK_NOTIONAL = 200000.0


def etf_flow(records: DataFrame, lookback: int = 5) -> DataFrame:
    """Net creations over the last observations as a share of assets, in percent.

    ``records``: ticker, as_of, shares_outstanding, nav, aum. Fund records are one per
    fund and date.
    """
    w = Window.partitionBy("ticker").orderBy("as_of")
    known = records.where("as_of is not null and shares_outstanding is not null and nav is not null and aum <> 0")
    step = known.withColumn("_flow", (F.col("shares_outstanding") - F.lag("shares_outstanding").over(w)) * F.col("nav"))
    last = w.rowsBetween(-(lookback - 1), 0)
    value = F.sum("_flow").over(last) / F.col("aum") * 100
    return step.select(
        "ticker", "as_of", F.when(F.count("_flow").over(last) == lookback, value).alias("etf_flow_5d_pct")
    )


def clean_prints(tape: DataFrame) -> DataFrame:
    """Uncorrected prints with a positive price and size."""
    ok = (F.col("price") > 0) & (F.col("size") > 0)
    if "correction" in tape.columns:
        ok = ok & (F.coalesce(F.col("correction").try_cast("double"), F.lit(0.0)) == 0)
    return tape.where(ok)


#: Prints of one key and bucket that are scanned in one piece.
RANGE_ROWS = 200_000


def sequence_ranges(tape: DataFrame, keys: list[str], number: str, most: int = RANGE_ROWS, crowd: DataFrame | None = None) -> DataFrame:
    """Cut crowded keys into ranges of their sequence numbers: adds ``_r``, which grows with the number.

    Only keys with more than ``most`` rows are in the small table of cuts; all others are range 0.
    ``crowd``: rows per key as _n, with the number's _low and _high, where a table has them already.
    """
    n = F.col(number).cast("double")
    if crowd is None:
        crowd = tape.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(n).alias("_low"), F.max(n).alias("_high"))
    crowd = crowd.where(F.col("_n") > most)
    cuts = crowd.select(*keys, "_low", ((F.col("_high") - F.col("_low")) / F.ceil(F.col("_n") / most)).alias("_width"))
    inside = F.when(F.col("_width") > 0, F.floor((n - F.col("_low")) / F.col("_width")))
    return tape.join(cuts, keys, "left").withColumn("_r", F.coalesce(inside, F.lit(0).cast("long"))).drop("_low", "_width")


def tick_direction(tape: DataFrame, keys: list[str], order: list[str], bucket: Column, most: int = RANGE_ROWS) -> DataFrame:
    """Previous clean print's price of each print, without one task per key.

    ``order`` names one numeric column that orders the prints of a bucket; buckets follow each
    other. A key may hold a third of the tape, and so may one of its buckets: prints are windowed
    per key, bucket and range of sequence numbers. Each range hands its last price on through an
    edge table, a hash aggregate on plain numbers with one row per range; its window stays small.
    """
    number = order[-1]
    df = sequence_ranges(clean_prints(tape).withColumn("_b", bucket), [*keys, "_b"], number, most)
    place = [*keys, "_b", "_r"]
    edges = df.groupBy(*place).agg(F.max_by("price", number).alias("_last"))
    carry = edges.select(*place, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b", "_r")).alias("_carry"))
    return (
        df.withColumn("_in", F.lag("price").over(Window.partitionBy(*place).orderBy(number)))
        .join(carry, place)
        .withColumn("prev_price", F.coalesce("_in", "_carry"))
        .drop("_in", "_carry", "_b", "_r")
    )


def block_ratio(
    tape: DataFrame,
    keys: list[str],
    order: list[str],
    min_size: float = BLOCK_SIZE,
    min_notional: float = BLOCK_NOTIONAL,
    bucket: Column | None = None,
    most: int = RANGE_ROWS,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """Up-tick over down-tick block notional; 2.0 with no down blocks, null with none.

    ``order`` names the columns that order prints; without a ``bucket`` its first one is the bucket.
    The first column within a bucket is a number, of which crowded buckets are cut into ranges
    (``crowd``: see sequence_ranges, by keys and _b). Prints are read and sorted once: a range's sums
    leave out its first print, which is judged by the last price of the range before it, in a table
    with one row per range.
    """
    within = order[1:] if bucket is None and len(order) > 1 else order
    df = clean_prints(tape).withColumn("_b", F.col(order[0]) if bucket is None else bucket)
    df = sequence_ranges(df, [*keys, "_b"], within[0], most, crowd)
    w = Window.partitionBy("_b", *keys, "_r").orderBy(*within)
    df = df.withColumn("_before", F.lag("price").over(w)).withColumn("_after", F.lead("price").over(w))
    notional = F.col("price") * F.col("size")
    block = (F.col("size") >= min_size) | (notional >= min_notional)
    first = F.col("_before").isNull()
    ranges = df.groupBy("_b", *keys, "_r").agg(
        F.sum(F.when(block & (F.col("price") > F.col("_before")), notional)).alias("_up"),
        F.sum(F.when(block & (F.col("price") < F.col("_before")), notional)).alias("_down"),
        F.max(F.when(first, F.col("price"))).alias("_first"),
        F.max(F.when(first & block, notional)).alias("_opening"),
        F.max(F.when(F.col("_after").isNull(), F.col("price"))).alias("_last"),
    )
    edges = ranges.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b", "_r")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    opening = lambda moved: F.when(moved, F.col("_opening"))
    agg = edges.groupBy(*keys).agg(
        F.sum(zero("_up") + zero(opening(F.col("_first") > F.col("_carry")))).alias("up_notional"),
        F.sum(zero("_down") + zero(opening(F.col("_first") < F.col("_carry")))).alias("down_notional"),
    )
    up, down = F.col("up_notional"), F.col("down_notional")
    return agg.withColumn(
        "block_up_ratio", F.when((up == 0) & (down == 0), None).when(down == 0, 2.0).otherwise(up / down)
    )


def dark_pool_share(records: DataFrame) -> DataFrame:
    """Alternative-venue share of the latest reported week.

    ``records``: ticker, week, summary_type, shares. Weeks aggregate map-side before
    the latest one is chosen.
    """
    ok = records.where("shares >= 0")
    weeks = ok.groupBy("ticker", "week").agg(
        F.sum("shares").alias("_total"),
        F.sum(F.when(F.upper("summary_type").contains("ATS"), F.col("shares")).otherwise(0.0)).alias("_ats"),
    )
    newest = records.groupBy("ticker").agg(F.max("week").alias("week"))
    return newest.join(weeks, ["ticker", "week"], "left").select(
        "ticker", "week", F.when(F.col("_total") > 0, F.col("_ats") / F.col("_total")).alias("dark_pool_pct")
    )


def short_interest_delta(records: DataFrame) -> DataFrame:
    """Change of the latest short position in percent.

    Reported change first, then the record's own previous position, then the
    previous record. ``records``: ticker, settlement, reported, position, previous.
    """
    history = short_interest_history(records)
    return history.groupBy("ticker").agg(F.max_by("si_delta_15d", "settlement").alias("si_delta_15d"))


def short_interest_history(records: DataFrame) -> DataFrame:
    """The change at every settlement date: one row per ticker and date."""
    before = F.lag("position").over(Window.partitionBy("ticker").orderBy("settlement"))
    prev = F.coalesce("previous", before)
    change = F.when(prev != 0, (F.col("position") - prev) / prev * 100)
    return records.select("ticker", "settlement", F.coalesce("reported", change).alias("si_delta_15d"))


def filings_net_buys(records: DataFrame, cusips: DataFrame) -> DataFrame:
    """Change of filed shares between the last two periods, in percent.

    ``records``: cusip, period, shares. ``cusips``: cusip, ticker. Filings meet the map first and
    aggregate per ticker and period map-side: a cusip has few filings a period, so sums per cusip
    would be about as many as the filings. A hot cusip's rows are split by the join.
    """
    clean = F.replace(F.upper("cusip"), F.lit(" "), F.lit(""))
    m = cusips.select(clean.alias("cusip"), "ticker").distinct()
    filed = records.where("shares is not null").select(clean.alias("cusip"), "period", "shares")
    totals = filed.join(m, "cusip").groupBy("ticker", "period").agg(F.sum("shares").alias("shares"))
    w = Window.partitionBy("ticker").orderBy("period")
    steps = totals.withColumn("_prev", F.lag("shares").over(w))
    last = steps.groupBy("ticker").agg(F.max_by(F.struct("shares", "_prev"), "period").alias("r"))
    prev = F.col("r._prev")
    return last.select("ticker", F.when(prev != 0, (F.col("r.shares") - prev) / prev * 100).alias("thirteen_f_q"))


#: Events and sample tickers that a lane's row shows.
SHOWN = 5


def run_health(events: DataFrame) -> DataFrame:
    """Fetch outcomes per lane: counts by status and mode, first tickers and events, detail.

    ``events``: lane, ticker, status, mode, completed_at. Counts combine map-side per (lane, status,
    mode). The first five events and tickers of a lane come from ranked windows that keep five rows
    per task before the shuffle. A lane's only event shows its own status and mode.
    """
    ticker = F.upper("ticker")
    cells = events.groupBy("lane", "status", "mode").agg(F.count(F.lit(1)).alias("n"), F.max("completed_at").alias("last"))

    def shares(key: str) -> Column:
        """``name=count`` of every status or mode, by name."""
        names = F.array_sort(F.collect_set(F.coalesce(key, F.lit(""))))
        pairs = F.collect_list(F.struct(F.coalesce(key, F.lit("")).alias("k"), "n"))
        count = lambda name: F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["k"] == name, p["n"]).otherwise(0))
        return F.array_join(F.transform(names, lambda name: F.concat(name, F.lit("="), count(name).cast("string"))), ", ")

    sums = cells.groupBy("lane").agg(
        F.sum("n").alias("total_count"),
        F.sum(F.when(F.col("status") == "healthy", F.col("n")).otherwise(0)).alias("healthy_count"),
        F.max("last").alias("last_completed"),
        shares("status").alias("status_counts"),
        shares("mode").alias("mode_counts"),
        F.first("status").alias("_status"),
        F.first("mode").alias("_mode"),
    )

    def first_five(rows: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
        w = Window.partitionBy("lane").orderBy(*order)
        top = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= SHOWN)
        return top.groupBy("lane").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))), lambda x: x["v"]).alias(name))

    told = events.select("lane", ticker.alias("ticker"), "status", "mode", "completed_at")
    firsts = told.groupBy("lane", "ticker").agg(F.min("completed_at").alias("completed_at"))
    samples = first_five(firsts, F.col("ticker"), "_samples", "completed_at", "ticker")
    listed = first_five(told, F.concat_ws(" ", "ticker", "mode"), "_events", "completed_at", "ticker", "status", "mode")
    df = sums.join(samples, "lane").join(listed, "lane")
    warn = F.col("total_count") - F.col("healthy_count")
    one = F.col("total_count") == 1
    last = F.concat(F.lit("last completed "), F.date_format("last_completed", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    bad = F.filter("_events", lambda e: ~e.contains(" live ok"))
    detail = F.concat_ws(
        "; ",
        last,
        F.format_string("%d live ok, %d warning across %d tickers", "healthy_count", warn, "total_count"),
        F.concat(F.lit("sample tickers: "), F.array_join("_samples", ", ")),
        F.when(F.size(bad) > 0, F.concat(F.lit("warnings: "), F.array_join(bad, "; "))),
    )
    many = F.when(warn > 0, F.format_string("%d live ok / %d warning", "healthy_count", warn)).otherwise(F.format_string("%d live ok", "healthy_count"))
    return df.select(
        "lane", "total_count", "healthy_count", warn.alias("warning_count"), "last_completed",
        F.when(one, F.col("_status")).when(warn > 0, "warning").otherwise("healthy").alias("status"),
        F.when(one, F.col("_mode")).otherwise(many).alias("mode"),
        "status_counts", "mode_counts",
        F.array_join("_samples", ", ").alias("samples"),
        F.array_join("_events", "; ").alias("events"),
        F.when(one, F.concat_ws("; ", last, F.get("_events", F.lit(0)))).otherwise(detail).alias("detail"),
    )


def last_runs(events: DataFrame) -> DataFrame:
    """Whether the last run of each lane and ticker was live: lane, ticker, live.

    Time and outcome form one number, so the newest run is a plain maximum with map-side combine;
    of runs that end together a live one counts.
    """
    live = (F.col("status") == "healthy") & F.startswith("mode", F.lit("live ok"))
    number = F.unix_micros(F.col("completed_at").cast("timestamp")) * 2 + F.coalesce(live, F.lit(False)).cast("long")
    last = events.groupBy("lane", F.upper("ticker").alias("_t")).agg(F.max(number).alias("_n"), F.min("ticker").alias("ticker"))
    return last.select("lane", "ticker", (F.pmod("_n", F.lit(2)) == 1).alias("live"))


def readiness(config: DataFrame, health: DataFrame) -> DataFrame:
    """Status row per configured lane: stubbed, missing keys, or its run health.

    ``config``: lane, label, stubbed, missing. It is the fixed list of lanes.
    """
    df = config.join(health.select("lane", F.col("status").alias("_s"), F.col("mode").alias("_m"), F.col("detail").alias("_d")), "lane", "left")
    missing = F.col("missing") != ""
    return df.select(
        "lane",
        "label",
        F.when(F.col("stubbed"), "info").when(missing, "warning").otherwise(F.coalesce("_s", F.lit("healthy"))).alias("status"),
        F.when(F.col("stubbed"), "stubbed neutral")
        .when(missing, F.concat(F.lit("missing "), F.col("missing")))
        .otherwise(F.coalesce("_m", F.lit("enabled")))
        .alias("mode"),
        F.when(~F.col("stubbed") & ~missing, F.col("_d")).alias("detail"),
    )
