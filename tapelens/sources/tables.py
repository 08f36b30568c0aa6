"""Readers of the driver tables and the market views derived from them.

Each view is an aggregation Spark computes from the given tables, so the work of
every registered query grows with them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BENCH = "Brand#1"
CASH = "Brand#2"
TOP_PER_CLASS = 2


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def print_number() -> Column:
    """Order of prints as one long: order, line, then a mix of part and supplier."""
    rest = (F.col("l_partkey") * 31 + F.col("l_suppkey")) % (1 << 20)
    return F.col("l_orderkey") * (1 << 23) + F.col("l_linenumber") * (1 << 20) + rest


def print_key() -> Column:
    """Order of prints as one exact number: order, line, part, supplier."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    power = lambda k: F.lit("1" + "0" * k).cast("decimal(38,0)")
    return wide("l_orderkey") * power(23) + wide("l_linenumber") * power(21) + wide("l_partkey") * power(10) + wide("l_suppkey")


def prints(spark: SparkSession, root: str, ticker: str = "p_brand") -> DataFrame:
    """Trade prints: one row per line item, priced per unit."""
    item = table(spark, root, "lineitem")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(ticker).alias("ticker"))
    return item.join(part, "l_partkey").select(
        "ticker",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_discount").alias("discount"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
        ).alias("seq"),
        print_number().alias("number"),
        print_key().alias("print_key"),
    )


def bars_from_prints(ticks: DataFrame) -> DataFrame:
    """Prints to daily bars (R4), one row per (ticker, date).

    First and last prints come from min_by/max_by on the print number: all buffers are plain
    numbers, so Spark plans hash aggregates and never sorts prints. All aggregates combine
    map-side; a hot ticker shuffles at most one partial row per map task and day.
    """
    return ticks.groupBy("ticker", "date").agg(*_bar())


def _bar() -> list[Column]:
    adjusted = F.col("price") * (1 - F.col("discount"))
    return [
        F.min_by("price", "number").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "number").alias("close"),
        F.max_by(adjusted, "number").alias("adj_close"),
        F.sum("size").alias("volume"),
    ]


#: Columns of ``seq`` that order the prints of a day, before size and price.
PRINT_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def ordered_prints(spark: SparkSession, root: str) -> DataFrame:
    """Prints with the plain columns that order them."""
    return prints(spark, root).select("ticker", "date", "price", "size", *[F.col(f"seq.{c}").alias(c) for c in PRINT_ORDER])


BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")


def days_from_prints(ticks: DataFrame) -> DataFrame:
    """Daily bars with what else one pass over the prints can tell of a day: sum and number of the
    prices, the range of order keys, and the volume of all and of every third line."""
    return ticks.groupBy("ticker", "date").agg(
        *_bar(),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("prints"),
        F.min("seq.l_orderkey").alias("first_order"),
        F.max("seq.l_orderkey").alias("last_order"),
        F.sum(F.when(F.col("size") >= 0, F.col("size"))).alias("reported"),
        F.sum(F.when((F.col("size") >= 0) & (F.col("seq.l_linenumber") % 3 == 0), F.col("size"))).alias("third_lines"),
    )


def bars(spark: SparkSession, root: str, ticker: str = "p_brand") -> DataFrame:
    return bars_from_prints(prints(spark, root, ticker))


def with_price(b: DataFrame) -> DataFrame:
    """``price`` is adj_close when the table has that column, else close."""
    return b.withColumn("price", F.col("adj_close" if "adj_close" in b.columns else "close"))


def ticker_class(c="ticker"):
    """Class of a brand: the two reference instruments are benchmarks."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    return F.when(c.isin(BENCH, CASH), "Benchmark").otherwise(F.coalesce(F.concat(F.lit("C"), number % 4), F.lit("Other")))


def macro(spark: SparkSession, root: str) -> DataFrame:
    """Monthly macro series, one per order priority (bounded by months x 5)."""
    o = table(spark, root, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("date")
    ).agg(F.avg("o_totalprice").alias("value"))


def intraday(spark: SparkSession, root: str) -> DataFrame:
    """Intraday prints from the event stream."""
    e = table(spark, root, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_type").alias("ticker"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * F.lit("1" + "0" * 19).cast("decimal(38,0)") + F.col("event_id").cast("decimal(38,0)")).alias("event_key"),
        F.col("value").alias("price"),
        (k * 1000).cast("double").alias("size"),
        F.when(k % 17 == 0, 1).otherwise(0).alias("correction"),
    )


def holdings(spark: SparkSession, root: str) -> DataFrame:
    """Positions per supplier account and brand; every seventh account lacks values."""
    item = table(spark, root, "lineitem")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return (
        item.join(part, "l_partkey")
        .groupBy(F.col("l_suppkey").alias("account"), "ticker")
        .agg(F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("_paid"))
        .select(
            "account",
            "ticker",
            "shares",
            (F.col("_paid") / F.col("shares")).alias("cost_basis"),
            F.when(F.col("account") % 7 != 0, F.col("_paid") * 1.1).alias("market_value"),
            F.when(F.col("account") % 5 == 0, F.col("shares") / 100.0).alias("weight"),
        )
    )


def trades(spark: SparkSession, root: str) -> DataFrame:
    """User trades: one per line item, returned lines are sales."""
    item = table(spark, root, "lineitem")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return item.join(part, "l_partkey").select(
        F.to_date("l_shipdate").alias("trade_date"),
        "ticker",
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """Journalled decisions: one per order."""
    o = table(spark, root, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("started_at"),
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"),
        F.when(status == "F", "EXIT").when(status == "O", "BUY").otherwise("HOLD").alias("action"),
        F.col("o_orderpriority").alias("series_id"),
    )


def shares_outstanding(spark: SparkSession, root: str) -> DataFrame:
    """Monthly fund records per brand: shares outstanding, nav and assets, dated by the month's last
    day, when its last print is known."""
    t = prints(spark, root)
    return (
        t.groupBy("ticker", F.last_day("date").alias("as_of"))
        .agg(F.sum("size").alias("shares_outstanding"), F.avg("price").alias("nav"))
        .withColumn("aum", F.col("shares_outstanding") * F.col("nav"))
    )


def monthly_funds(days: DataFrame) -> DataFrame:
    """The records of ``shares_outstanding`` from the day table."""
    nav = F.sum("price_sum") / F.nullif(F.sum("prints"), F.lit(0))
    funds = days.groupBy("ticker", F.last_day("date").alias("as_of")).agg(F.sum("volume").alias("shares_outstanding"), nav.alias("nav"))
    return funds.withColumn("aum", F.col("shares_outstanding") * F.col("nav"))


def crowd(days: DataFrame) -> DataFrame:
    """Prints of every ticker and day with the range of their order keys, as block_ratio takes it."""
    return days.select("ticker", F.col("date").alias("_b"), F.col("prints").alias("_n"), F.col("first_order").cast("double").alias("_low"), F.col("last_order").cast("double").alias("_high"))
