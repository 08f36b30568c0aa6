"""Ranked lexical search by Block-Max MaxScore over index shards.

**Index.** Every task turns its documents into shards of at most ``SHARD_BYTES`` of text and
``SHARD_DOCS`` rows. A shard holds its terms, their lists of postings (document number and term
frequency) in blocks of ``BLOCK``, each block coded by itself as variable-length bytes of document
gaps and frequencies, and beside the blocks what is needed to skip them: last document, greatest
frequency, smallest length. All rows and all terms are indexed; shards are stored.

**Search.** Corpus counts (N, L, df) are sums over the shards. Items are dealt to blocks of
``ITEMS``; a block of items meets every shard, in an equi-join on block and salt that no task holds
alone. In a shard the lists of an item stand by their
global bounds, greatest first. Lists are essential, and are read whole, until the bounds of the
rest sum to less than the tenth best score so far; a document in none of the essential lists can't
reach that score. The candidates' bounds in the other lists are then taken from the block maxima:
a candidate whose sum stays below the tenth score is rejected before any block is decoded, and
only blocks that a remaining candidate falls into are decoded, list by list, with the tenth score
raised in between. Each shard hands on its ten best; a ranked window with a limit per task merges
these heaps.

Scores are sums of non-negative integers, so bounds are exact and ties are kept: a candidate goes
only if its bound is strictly below. Terms are maximal runs of letters, digits and bytes above
0x7F; only A-Z is lower-cased. Null and empty texts have no terms; they count for nothing. Equal
scores stand by ascending id, null ids last. Repeated documents are documents of their own;
repeated items (same id and text) give one result, and items with one id but different texts are
ranked together as one list of hits per text. Items without known terms give no row; so do empty
tables. A text of any length is split in one piece. Only the named columns are read.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, scratch, stored, text_bytes

SHARD_BYTES, SHARD_DOCS, BLOCK = 12 << 20, 1 << 15, 128
#: Items that meet a shard together.
ITEMS = 1000
#: Fixed values of the score: saturation and length share in eighths and hundredths.
SCALE, STEP, SATURATION, SHARE = 1_000_000_000, 1000, 8, 75
NO_ID = np.iinfo(np.int64).max
TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
SHARD = "docs long, terms long, vocabulary binary, df binary, ids binary, blank binary, lengths binary, last binary, top_tf binary, least_length binary, ends binary, payload binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of seven bits, the last one marked; also the size of each."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += v >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        out[ends[has] - sizes[has] + k] = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
    out[ends - 1] |= 128
    return out, sizes


def decode(raw: np.ndarray) -> np.ndarray:
    """The numbers of whole coded blocks."""
    ends = np.flatnonzero(raw >= 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(raw) else np.zeros(0, np.int64)


class Builder:
    """Collects documents and makes shards of them."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.tf, self.kinds = [], [], []
        self.ids, self.blank, self.lengths, self.size = [], [], [], 0

    def add(self, doc_id, text: bytes):
        counts = Counter(terms_of(text))
        known = self.vocabulary
        self.term.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int64, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.kinds.append(len(counts))
        self.ids.append(0 if doc_id is None else doc_id)
        self.blank.append(doc_id is None)
        self.lengths.append(int(self.tf[-1].sum()))
        self.size += len(text)

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def shard(self) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((self.vocabulary[t] for t in names), np.int64, len(names))] = np.arange(len(names))
        doc = np.repeat(np.arange(len(lengths)), self.kinds)
        term = rank[np.concatenate(self.term)] if len(names) else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")  # documents stay in order
        term, doc, tf = term[order], doc[order], np.concatenate(self.tf)[order] if len(names) else np.zeros(0, np.int64)
        df = np.bincount(term, minlength=len(names))
        inside = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
        first = np.flatnonzero(inside % BLOCK == 0)
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        coded, sizes = encode(np.stack([gap, tf], axis=1).ravel())
        ends = np.r_[first[1:], len(term)]
        columns = {
            "docs": np.count_nonzero(lengths), "terms": int(lengths.sum()), "vocabulary": b" ".join(names), "df": df.astype("<u4"),
            "ids": np.array(self.ids, "<i8"), "blank": np.array(self.blank, "u1"), "lengths": lengths.astype("<i8"),
            "last": doc[ends - 1].astype("<u4"), "top_tf": (np.maximum.reduceat(tf, first) if len(tf) else tf).astype("<i8"),
            "least_length": (np.minimum.reduceat(lengths[doc], first) if len(tf) else tf).astype("<i8"),
            "ends": np.r_[0, np.cumsum(sizes.reshape(-1, 2).sum(axis=1))][ends].astype("<u8"), "payload": coded,
        }
        self.clear()
        return pa.RecordBatch.from_pydict({k: [v.tobytes() if isinstance(v, np.ndarray) else int(v) if k in ("docs", "terms") else v] for k, v in columns.items()})


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored shards of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                builder.add(doc_id, text.as_py())
                if builder.full():
                    yield builder.shard()
        if builder.ids:
            yield builder.shard()

    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_bytes(quoted(text_col)).alias("text"))
    return stored(picked.mapInArrow(run, SHARD), folder, "shards")


def norm(n, documents: int, terms: int):
    """The length part of a score, in hundredths."""
    return 100 - SHARE + (SHARE * n * documents) // terms


def saturated(tf, m):
    return (SCALE * tf) // (STEP * tf + SATURATION * m)


class Shard:
    """One stored shard, opened for search."""

    def __init__(self, row: dict, documents: int, terms: int):
        self.place = {t: k for k, t in enumerate(row["vocabulary"].to_pybytes().split())}
        df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        self.first = np.r_[0, np.cumsum((df + BLOCK - 1) // BLOCK)]
        self.ids, self.blank = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["blank"], "u1") == 1
        self.m = norm(np.frombuffer(row["lengths"], "<i8"), documents, terms)
        self.last = np.frombuffer(row["last"], "<u4").astype(np.int64)
        self.bound = saturated(np.frombuffer(row["top_tf"], "<i8"), norm(np.frombuffer(row["least_length"], "<i8"), documents, terms))
        self.ends = np.r_[0, np.frombuffer(row["ends"], "<u8").astype(np.int64)]
        self.payload = np.frombuffer(row["payload"], np.uint8)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and saturated frequencies of some blocks, decoded one by one."""
        docs, tfs = [], []
        for b in blocks.tolist():
            pairs = decode(self.payload[self.ends[b] : self.ends[b + 1]]).reshape(-1, 2)
            docs.append(np.cumsum(pairs[:, 0]))
            tfs.append(pairs[:, 1])
        doc = np.concatenate(docs)
        return doc, saturated(np.concatenate(tfs), self.m[doc])

    def search(self, weighted: list[tuple[bytes, int]], k: int) -> list[tuple[int | None, int]]:
        """The ``k`` best (id, score) of the shard; ``weighted``: terms with their weights times their repeats."""
        lists = []
        for term, w in weighted:
            at = self.place.get(term)
            if at is not None and w > 0:
                a, b = int(self.first[at]), int(self.first[at + 1])
                lists.append((w * int(self.bound[a:b].max()), w, a, b))
        lists.sort(reverse=True)
        rest = sum(x[0] for x in lists)
        score, met, floor, at = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), 0, 0

        def tenth(values: np.ndarray) -> int:
            return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0

        while at < len(lists) and rest >= floor:  # essential: whole lists
            bound, w, a, b = lists[at]
            doc, value = self.postings(np.arange(a, b))
            score[doc] += w * value
            met[doc] = True
            rest -= bound
            at += 1
            floor = max(floor, tenth(score[met]))
        left = np.flatnonzero(met)
        others = lists[at:]
        caps = np.zeros((len(others), len(left)), np.int64)
        where = np.zeros((len(others), len(left)), np.int64)
        for j, (_, w, a, b) in enumerate(others):
            where[j] = a + np.searchsorted(self.last[a:b], left)
            inside = where[j] < b
            caps[j, inside] = w * self.bound[where[j, inside]]
        room = caps.sum(axis=0)
        for j, (_, w, a, b) in enumerate(others):
            keep = score[left] + room >= floor
            left, room, caps, where = left[keep], room[keep] - caps[j, keep], caps[:, keep], where[:, keep]
            asked = caps[j] > 0
            if asked.any():
                doc, value = self.postings(np.unique(where[j, asked]))
                spot = np.minimum(np.searchsorted(doc, left), len(doc) - 1)
                hit = doc[spot] == left
                score[left[hit]] += w * value[spot[hit]]
                floor = max(floor, tenth(score[left]))
        left = left[(score[left] >= max(floor, 1))]
        order = np.lexsort((np.where(self.blank[left], NO_ID, self.ids[left]), self.blank[left], -score[left]))[:k]
        return [(None if self.blank[d] else int(self.ids[d]), int(score[d])) for d in left[order]]


def vocabulary_of(items: DataFrame, text_col: str) -> DataFrame:
    """Items with their distinct terms and repeats: item, item_id, term, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, name, term, n = [], [], [], []
            for key, item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts = Counter(terms_of(text))
                item += [key] * len(counts)
                name += [item_id] * len(counts)
                term += counts.keys()
                n += counts.values()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(name, pa.int64()), pa.array(term, pa.binary()), pa.array(n, pa.int64())], names=["item", "item_id", "term", "n"])

    return items.mapInArrow(run, "item string, item_id long, term binary, n long")


def frequencies(shards: DataFrame) -> DataFrame:
    """term, df of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, df in zip(batch.column("vocabulary").to_pylist(), batch.column("df").to_pylist()):
                terms, counts = words.split(), np.frombuffer(df, "<u4").astype(np.int64)
                for k in range(0, len(terms), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + 50_000], pa.binary()), pa.array(counts[k : k + 50_000])], names=["term", "df"])

    return shards.select("vocabulary", "df").mapInArrow(run, "term binary, df long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    folder = scratch(docs.sparkSession, "ranking")
    shards = build_index(docs, folder, id_col, text_col)
    documents, terms = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    name, text = F.col(quoted(item_col)).cast("long"), text_bytes(quoted(item_text))
    key = F.concat_ws(":", F.coalesce(name.cast("string"), F.lit("null")), F.sha2(text, 256))
    asked = items.select(key.alias("item"), name.alias("item_id"), text.alias("text")).dropDuplicates(["item"])
    words = stored(vocabulary_of(asked, "text"), folder, "words")
    df = frequencies(shards).join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighted = words.join(df, "term").select("item", "item_id", F.struct("term", (weight * F.col("n")).alias("weight")).alias("part"))
    packed = weighted.groupBy("item", "item_id").agg(F.collect_list("part").alias("parts"))
    deal = max(1, math.ceil(asked.count() / ITEMS))
    spread = max(1, shards.count())
    block = F.pmod(F.xxhash64("item"), F.lit(deal)).alias("block")
    groups = stored(packed.groupBy(block).agg(F.collect_list(F.struct("item", "item_id", "parts")).alias("items")), folder, "items")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = shards.drop("docs", "terms").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))

    parts = [c for c in shards.columns if c not in ("docs", "terms")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row].as_buffer() for c in parts}, documents, terms)
                found = [(q["item"], q["item_id"], *hit) for q in batch.column("items")[row].as_py() for hit in shard.search([(p["term"], p["weight"]) for p in q["parts"]], k)]
                columns = list(zip(*found)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=["item", "item_id", "doc_id", "score"],
                )

    blocks = F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))
    met = dealt.withColumn("block", F.explode(blocks)).join(copies.hint("shuffle_hash"), ["block", "salt"])
    heaps = met.mapInArrow(run, "item string, item_id long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
