"""SimHash fingerprints of word shingles, linked through multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. If two fingerprints differ in at most two bits,
they differ in at most one bit of the first segment, or not at all in the second. So a table is
kept per segment; each fingerprint looks up the Hamming ball of radius one around its first
segment and its own second segment, and complete distances are verified. A differing bit is zero
on one side, so only flips of zeros are enumerated.

Buckets of more than ``BUCKET`` fingerprints are left out of this join and searched exactly in
another way: two fingerprints differ in at most two bits if and only if the balls of radius one
around them share a point. Every fingerprint that lies in such a bucket or looks it up is linked
to the smallest fingerprint at each of its 65 points, verified likewise. A point has at most 65
neighbours, so no group, however large, is paired with itself, and no link between groups is lost.

Null texts count as empty; without words the fingerprint is zero and is linked like any other.
Null ids take part, but only their rows stand for them: a component is named by its smallest
non-null id. Repeated rows give repeated results, an empty table an empty one. Very long texts are
hashed in slices. Only the two named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, scratch, stored, text_bytes
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that a bucket may have to be joined directly.
BUCKET = 64
#: Shingles hashed at once.
STEP = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, STEP):
        span = zip(begins[k : min(n, k + STEP)].tolist(), ends[k : min(n, k + STEP)].tolist())
        h = np.array([digest(joined[a:b], seed) for a, b in span], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f (fingerprint as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "f"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, f long")


def segment(f, which: int):
    return F.shiftrightunsigned(f, 32) if which == 0 else f.bitwiseAND(F.lit(0xFFFFFFFF))


def links(distinct: DataFrame, folder: str, bucket: int = BUCKET) -> DataFrame:
    """Stored distinct fingerprints ``f`` -> stored links (a, b), a < b: enough to connect all that differ in at most two bits."""
    f = F.col("f")
    keys = F.array(*[F.struct(F.lit(w).alias("segment"), segment(f, w).alias("key")) for w in (0, 1)])
    table = distinct.select("f", F.inline(keys))
    first = segment(f, 0)
    one = F.lit(1).cast("long")
    flipped = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: first.bitwiseOR(F.call_function("shiftleft", one, b)))
    ball = F.filter(flipped, lambda v: v != first)
    probes = distinct.select("f", F.inline(F.concat(keys, F.transform(ball, lambda v: F.struct(F.lit(0).alias("segment"), v.alias("key"))))))
    large = stored(table.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).drop("n"), folder, "large-buckets")

    at = ["segment", "key"]
    small = table.join(large, at, "left_anti").withColumnRenamed("f", "g")
    found = probes.join(small, at).where(F.col("f") != F.col("g"))
    direct = found.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS).select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b"))

    crowded = probes.join(large, at, "left_semi").select("f").distinct()
    flips = F.concat(F.array(f), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: f.bitwiseXOR(F.call_function("shiftleft", one, b))))
    points = stored(crowded.select("f", F.explode(flips).alias("point")), folder, "points")
    low = points.groupBy("point").agg(F.min("f").alias("a"), F.max("f").alias("top")).where("a < top").drop("top")
    around = points.join(low, "point").where(F.col("f") != F.col("a"))
    shared = around.where(F.bit_count(F.col("f").bitwiseXOR(F.col("a"))) <= RADIUS).select("a", F.col("f").alias("b"))
    return stored(direct.union(shared).distinct(), folder, "links")


def members(rows: DataFrame, folder: str, bucket: int) -> DataFrame:
    """Stored (doc_id, f) -> stored (f, least_id, root), one row per fingerprint; roots name components."""
    nodes = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least_id")), folder, "nodes")
    roots = stored(components(links(nodes.select("f"), folder, bucket), folder), folder, "roots")
    joined = nodes.join(roots.withColumnRenamed("node", "f"), "f", "left")
    return stored(joined.select("f", "least_id", F.coalesce("root", "f").alias("root")), folder, "members")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    folder = scratch(docs.sparkSession, "simhash")
    rows = stored(fingerprints(docs, id_col, text_col), folder, "fingerprints")
    member = members(rows, folder, bucket)
    names = stored(member.groupBy("root").agg(F.min("least_id").alias("component_id")), folder, "names")
    ids = stored(member.join(names, "root").select("f", "component_id"), folder, "components")
    return rows.join(ids, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that with the smallest non-null id."""
    folder = scratch(docs.sparkSession, "simhash")
    member = members(stored(fingerprints(docs, id_col, text_col), folder, "fingerprints"), folder, bucket)
    order = F.struct(F.col("least_id").isNull().alias("blank"), "least_id", "f")
    first = member.groupBy("root").agg(F.min(order).alias("first"))

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64))

    def key(doc_id, f):
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), f.cast("string"))

    return keep_rows(docs, key(F.col(id_col), hashed(text_bytes(text_col))), first.select(key(F.col("first.least_id"), F.col("first.f")).alias("key")))
