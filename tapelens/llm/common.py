"""Helpers shared by the operators: scratch tables, byte-level word splits, bounded worker caches."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word splits here: what ``bytes.split()`` splits at.
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; only local mode may make its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and context._jsc.sc().getCheckpointDir().isDefined():
        root = context._jsc.sc().getCheckpointDir().get()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table and read it back: later jobs start from files, not from the lineage."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no column of the input has (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def at_most(df: DataFrame, key: Column, most: int) -> DataFrame:
    """A fixed sample of at most ``most`` rows (all, if there are no more), chosen by hash of ``key``.

    Rows are counted in up to 1024 hash buckets and whole buckets are taken; no task sorts rows.
    """
    n = df.count()
    if n <= most:
        return df
    bucket = F.pmod(F.xxhash64(key), F.lit(1024 * max(1, n // (2 * most))))
    sizes = dict(df.select(bucket.alias("b")).where("b < 1024").groupBy("b").count().collect())
    total = last = 0
    while last < 1024 and total + sizes.get(last, 0) <= most:
        total += sizes.get(last, 0)
        last += 1
    return df.where(bucket < last)


def keep_rows(docs: DataFrame, key: Column, keepers: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is in ``keepers`` (one string column ``key``, no repeats), one row per key.

    Keys hold the row's id, so copies of one text spread over the tasks. Of several rows with one key
    the smallest stays: columns compare in their order, nulls first; types without an order as JSON.
    """
    name = fresh("row_key", docs.columns)
    whole = fresh("row", docs.columns)
    kept = docs.withColumn(name, key).join(keepers.select(F.col("key").alias(name)), name, "left_semi")
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    unordered = [("map" in t or "variant" in t) for _, t in docs.dtypes]
    order = F.struct(*[F.to_json(F.struct(quoted(c))) if u else F.col(quoted(c)) for c, u in zip(docs.columns, unordered)])
    rows = kept.groupBy(name).agg((F.min_by(row, order) if any(unordered) else F.min(row)).alias(whole))
    return rows.select(f"{whole}.*")


def slices(items: list, weight: Callable = len, most: int = 1 << 21) -> Iterator[list]:
    """Cut a batch into lists of about ``most`` bytes, so that the Python objects made from one stay few."""
    if items and sum(map(weight, items)) <= most:
        yield items
        return
    part: list = []
    size = 0
    for item in items:
        part.append(item)
        size += weight(item)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class Cache:
    """Two generations of a bounded dictionary: what was used lately survives, the rest goes.

    ``prepare(keys)`` gives a dictionary that holds all keys; what is missing is made by one call
    of ``make(list of keys) -> list of values``. Keys longer than ``LONG`` stay for one call only.
    """

    LONG = 200

    def __init__(self, make: Callable[[list], list], most: int = 500_000):
        self.make, self.most = make, max(2, most)
        self.young: dict = {}
        self.old: dict = {}
        self.long: list = []

    def prepare(self, keys: Iterable) -> dict:
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        wanted = set(keys)
        missing = wanted.difference(self.young)
        if not missing:
            return self.young
        if len(self.young) + len(missing) > self.most // 2 and self.young:
            missing = wanted
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for k in missing:
            v = old.get(k)
            if v is None:
                new.append(k)
            else:
                young[k] = v
        if new:
            young.update(zip(new, self.make(new)))
            self.long = [k for k in new if len(k) > self.LONG]
        return young
