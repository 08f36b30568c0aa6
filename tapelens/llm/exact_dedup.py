"""Exact deduplication by a tree-merge of sorted digest runs.

Every task turns its documents into one run: digests in order, with the smallest id and the number
of rows of each. A task's leaf is its number modulo the leaves, so that leaves are right whatever the number
of tasks is. With ``fan_in ** rounds`` leaves, round j brings together the leaves that differ
only in digit j of their number: each sends every partner the slice of its run whose digest falls
to that partner, keeps its own slice, and merges what it gets in one multiway merge. The default
fan-in of two makes these the exchanges of a binomial tree; a larger one takes fewer rounds. Each merge keeps the smallest id of a digest
and verifies that lengths agree. After the last round a leaf owns one range of digests; no task
ever sees them all, and a text with a third of all rows is one entry of a run.

Texts are equal when identical after replacing each white-space run by one space; null counts as
empty. The smallest non-null id stays; without any, one of the rows does. Of repeated rows (same
id, same text) one stays. An empty table gives an empty result. Only the two named columns are
read; names in the input never clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, scratch, stored

#: Leaves that exchange runs in one round; two make the rounds of a binomial tree.
FAN_IN = 2
NO_ID = np.iinfo(np.int64).max
#: One entry of a run: digest, no id (0 or 1), smallest id, rows, bytes of the text.
ENTRY = np.dtype([("digest", "S32"), ("blank", "u1"), ("id", "<i8"), ("rows", "<i8"), ("size", "<i8")])
RUN = "leaf int, run binary"


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes), n_bytes of the normalised text, one row per input row."""
    text = normalised(text_col)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    return picked.select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"))


def merge(entries: np.ndarray) -> np.ndarray:
    """One run from sorted runs laid end to end: smallest id, rows summed, lengths verified.

    The stable sort finds the runs that are there and merges them.
    """
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries["digest"], kind="stable")]
    first = np.r_[True, entries["digest"][1:] != entries["digest"][:-1]]
    at = np.flatnonzero(first)
    out = entries[at].copy()
    out["blank"] = np.minimum.reduceat(entries["blank"], at)
    out["id"] = np.minimum.reduceat(entries["id"], at)
    out["rows"] = np.add.reduceat(entries["rows"], at)
    if (np.maximum.reduceat(entries["size"], at) != np.minimum.reduceat(entries["size"], at)).any():
        raise ValueError("equal digests of texts of different lengths")
    return out


def dealt(run: np.ndarray, leaf: int, digit: int, fan_in: int, leaves: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a run for the leaves that differ from ``leaf`` in this digit only."""
    place = leaves // fan_in ** (digit + 1)
    owner = range_of(run["digest"], leaves) // place % fan_in
    own = leaf // place % fan_in
    for d in range(fan_in):
        part = run[owner == d]
        if len(part):
            yield leaf + (d - own) * place, part


def range_of(digest: np.ndarray, leaves: int) -> np.ndarray:
    """Which of ``leaves`` equal ranges a digest falls into, by its first four bytes."""
    head = np.frombuffer(np.ascontiguousarray(digest.astype("S32")).tobytes(), ">u4").reshape(-1, 8)[:, 0] if len(digest) else np.zeros(0, ">u4")
    return (head.astype(np.uint64) * np.uint64(leaves) >> np.uint64(32)).astype(np.int64)


def to_batch(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([leaf for leaf, _ in parts], pa.int32()), pa.array([run.tobytes() for _, run in parts], pa.binary())], names=["leaf", "run"]
    )


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Groups of equal digests: digest, keep_id, group_size. ``rows`` is a stored table of digests."""
    parts, rounds = rows.rdd.getNumPartitions(), 1  # the scan may turn out to have more; leaves then get several runs
    while fan_in**rounds < parts:
        rounds += 1
    leaves = fan_in**rounds

    def leaf_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[np.ndarray] = []  # each more than twice as long as the next: an entry is merged a logarithm of times
        for batch in batches:
            new = np.zeros(batch.num_rows, ENTRY)
            ids = batch.column("doc_id")
            new["digest"] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "S32")
            new["blank"] = ids.is_null().to_numpy(zero_copy_only=False)
            new["id"] = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            new["rows"] = 1
            new["size"] = batch.column("n_bytes").to_numpy(zero_copy_only=False)
            new = merge(new)
            while runs and len(runs[-1]) <= 2 * len(new):
                new = merge(np.concatenate([runs.pop(), new]))
            runs.append(new)
        run = merge(np.concatenate([np.zeros(0, ENTRY), *runs]))
        leaf = TaskContext.get().partitionId() % leaves
        if len(run):
            yield to_batch(list(dealt(run, leaf, 0, fan_in, leaves)))

    def exchange(digit: int):
        def merged(runs: pa.Table) -> pa.Table:
            leaf = runs.column("leaf")[0].as_py()
            got = [np.frombuffer(x, ENTRY) for x in runs.column("run").to_pylist()]
            run = merge(np.concatenate(got))
            last = digit + 1 == rounds
            return pa.Table.from_batches([to_batch([(leaf, run)] if last else list(dealt(run, leaf, digit + 1, fan_in, leaves)))])

        return merged

    runs = rows.mapInArrow(leaf_runs, RUN)
    for digit in range(rounds):
        runs = runs.groupBy("leaf").applyInArrow(exchange(digit), RUN)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("run").to_pylist():
                run = np.frombuffer(blob, ENTRY)
                for k in range(0, len(run), 50_000):
                    part = run[k : k + 50_000]
                    raw = np.ascontiguousarray(part["digest"]).tobytes()
                    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(raw)]).cast(pa.binary())
                    keep = pa.array(part["id"], mask=part["blank"] == 1)
                    yield pa.RecordBatch.from_arrays([digest, keep, pa.array(part["rows"])], names=["digest", "keep_id", "group_size"])

    return runs.mapInArrow(opened, "digest binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows go back to their groups in a join of two stored tables on the digest; its key side is
    unique, and where one text has many rows the engine splits that partition.
    """
    folder = scratch(docs.sparkSession, "exact-dedup")
    rows = stored(digests(docs, id_col, text_col), folder, "digests")
    groups = stored(tree_merge(rows, fan_in), folder, "groups")
    ids = stored(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), folder, "ids")
    joined = ids.join(groups, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    folder = scratch(docs.sparkSession, "exact-dedup")
    groups = stored(tree_merge(stored(digests(docs, id_col, text_col), folder, "digests"), fan_in), folder, "groups")

    def key(doc_id: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), digest)

    keepers = groups.select(key(F.col("keep_id"), F.lower(F.hex("digest"))).alias("key"))
    return keep_rows(docs, key(F.col(id_col), F.sha2(normalised(text_col), 256)), keepers)
