"""Token counts by a two-tier map-side lookup: a broadcast table of frequent pieces, then worker caches.

A text is cut before every single space that stands between two non-spaces. The pre-tokenizer
always has a boundary there, so a text's count is the sum over its pieces. Tier one is a table
``piece -> tokens`` of the at most ``table_size`` most frequent short pieces of all documents: tasks
count them map-side in bounded counters, and a task's ``table_size`` most frequent ones travel as one
row to a tree of merges. No piece is shuffled by itself. Tier two is a bounded cache in each Python
worker; its misses go to the library in one batch. No text reaches the driver. The table only makes
things fast, results never depend on it.

Null texts count as empty (0 bytes, 0 tokens); one very long text is cut like any other; repeated
rows give repeated results, an empty table an empty one. Only the two named columns are read.
"""
from __future__ import annotations

import heapq
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, scratch, slices, stored

#: Where the pre-tokenizer surely cuts: before one space between two non-spaces.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: HELD: entries of a task's counter before it forgets the rarer half; FAN: summaries merged at once.
TABLE_SIZE, CACHE_SIZE, HELD, FAN = 30_000, 400_000, 300_000, 16
SUMMARY = "leaf int, pieces array<string>, counts array<long>"


@lru_cache(maxsize=4)
def library(path: str):
    """Text counter ``list of str -> list of int`` of a tokenizers (.json) or sentencepiece (.model) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def pieces(text: str) -> list[str]:
    """Cut at single spaces; all but the first piece keep their space. Joined they are the text."""
    parts = text.split(" ")
    if all(parts) and not any(p[0].isspace() or p[-1].isspace() for p in parts):
        return [parts[0], *(" " + p for p in parts[1:])]
    first, *rest = CUT.split(text)
    return [first, *(" " + p for p in rest)]


@lru_cache(maxsize=4)
def worker_cache(path: str, size: int) -> Cache:
    return Cache(library(path), size)


def count_text(parts: list[str], frequent: dict[str, int], cache: Cache) -> int:
    get = frequent.get
    found = [get(p) for p in parts]
    if None not in found:
        return sum(found)
    misses = [p for p, n in zip(parts, found) if n is None]
    known = cache.prepare(misses)
    return sum(n for n in found if n is not None) + sum(map(known.__getitem__, misses))


def frequent_pieces(docs: DataFrame, path: str, text_col: str = "text", table_size: int = TABLE_SIZE, sample_docs: int | None = None) -> dict[str, int]:
    """Tier one: the most frequent pieces of all documents with their token counts.

    Pieces longer than a worker's cache keeps are left out. Only a caller that asks for it gets
    the pieces of ``sample_docs`` texts, as Spark finds them first.
    """
    top = piece_counts(docs if sample_docs is None else docs.limit(sample_docs), text_col, table_size).select("piece").toArrow()  # at most ``table_size``
    names = sorted(top.column("piece").to_pylist())
    return dict(zip(names, library(path)(names))) if names else {}


def pruned(seen: Counter, keep: int) -> Counter:
    """The ``keep`` most frequent entries less the count of the next one: what goes has lost at most that much."""
    ranked = seen.most_common(keep + 1)
    less = ranked[keep][1] if len(ranked) > keep else 0
    return Counter({p: c - less for p, c in ranked[:keep] if c > less})


def summary(leaf: int, seen: Counter, size: int) -> pa.RecordBatch:
    """The most frequent entries of a counter as one row."""
    top = heapq.nlargest(size, seen.items(), key=lambda x: (x[1], x[0]))
    arrays = [pa.array([leaf], pa.int32()), pa.array([[p for p, _ in top]], pa.list_(pa.string())), pa.array([[c for _, c in top]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["leaf", "pieces", "counts"])


def piece_counts(docs: DataFrame, text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """(piece, c) of the at most ``size`` most frequent pieces of up to ``Cache.LONG`` characters.

    Every task reads all of its texts with a bounded counter and hands on one row, its ``size`` most
    frequent pieces. These rows meet ``FAN`` at a time, in as many rounds as their number asks for.
    Counts may fall short by what the counters had to forget (at most 2 / HELD of a task's pieces for one piece).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in slices(pieces(text.as_py())):
                    seen.update(part)
                    if len(seen) > HELD:
                        seen = pruned(short(seen), HELD // 2)
        if seen:
            yield summary(TaskContext.get().partitionId(), short(seen), size)

    def short(seen: Counter) -> Counter:
        return Counter({p: c for p, c in seen.items() if len(p) <= Cache.LONG})

    def merge(rows: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for names, counts in zip(rows.column("pieces").to_pylist(), rows.column("counts").to_pylist()):
            for p, c in zip(names, counts):
                seen[p] += c
        return pa.Table.from_batches([summary(rows.column("leaf")[0].as_py() // FAN, seen, size)])

    texts = docs.where(F.col(text_col).isNotNull()).select(text_col)
    rows = stored(texts.mapInArrow(count, SUMMARY), scratch(docs.sparkSession, "token-counts"), "summaries")
    last = rows.agg(F.max("leaf")).first()[0] or 0
    while last > 0:
        rows, last = rows.groupBy(F.floor(F.col("leaf") / FAN)).applyInArrow(merge, SUMMARY), last // FAN
    return rows.select(F.explode(F.arrays_zip("pieces", "counts")).alias("e")).select(F.col("e.pieces").alias("piece"), F.col("e.counts").alias("c"))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE, sample_docs: int | None = None
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    by_pieces = path.endswith(".json")
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, text_col, table_size, sample_docs) if by_pieces else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, cache = table.value, worker_cache(path, CACHE_SIZE)
        for batch in batches:
            n = []
            for text in batch.column(1).to_pylist():
                if not by_pieces:
                    n.append(library(path)([text])[0])
                    continue
                parts = pieces(text)
                n.append(sum(count_text(x, frequent, cache) for x in slices(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = picked.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
