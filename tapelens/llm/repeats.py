"""Removal of byte strings that an earlier document holds, by suffix arrays of content shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id. Strings are judged on the input, overlaps count, matches stay inside documents.

1. Documents are packed into *units* of about ``UNIT`` bytes, stored once.
2. Every string of ``length`` bytes has a minimiser: the least hash of the ``GRAM``-byte pieces in
   it. Equal strings have equal minimisers, so a string can only repeat where its minimiser does.
   Units send their distinct minimisers, not per document, to the owners of hash ranges; an owner
   answers with one bit for each: seen in two documents or not.
3. Neighbouring strings with one shared minimiser form a segment. A unit sends each distinct
   segment, with its smallest id, to the shard of its minimiser: so all occurrences of a string
   meet in one shard, whole.
4. Where all units have one and the same segment for a minimiser, its strings are in no other
   segment and its smallest id is known. So it is for a string of the other segments whose first or
   last ``length - 15`` bytes occur once in the shard. The rest of a shard is written piece behind piece
   and all its suffixes sorted by external induced sorting (``induced``). Suffixes that share ``length``
   bytes are neighbours; the smallest id of each such group goes back to the units as runs.
5. A unit marks what a smaller id has, and returns texts without it.

Steps 2, 3 and 5 compute the same minimisers again from the stored units, so no positions travel.
A passage in a third of all documents is one entry of a unit at an owner and in a shard. Shards are
streamed to the task's spill folder; their size is no bound for memory.

Nulls: a null text is empty and loses nothing; a null id counts as greater than any other. Rows
with equal ids never remove each other's bytes. Texts shorter than ``length`` stay whole; an empty
table gives an empty result. A unit holds at least one text, however long: memory grows with the
longest text. A run of n equal bytes takes the sorter n rounds. Only the two named columns are read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, scratch, stored, text_bytes
from .induced import CHUNK, Spool, room, suffix_sort

LENGTH, GRAM = 50, 20
UNIT = 6 << 20
#: Positions hashed at a time: their arrays stay in the processor's cache.
BLOCK = 1 << 16
#: Bytes of text for each owner of hashes; segments that units send to a shard, below ``COLLAPSE`` so that none is held twice.
SHARE, SEGMENTS = 24 << 20, 300_000
#: Distinct segments that a shard compares in memory while it reads, and those it works on at a time.
COLLAPSE, LOT = 400_000, 1 << 12
#: Hashes that a shard sorts at a time.
HASHES = 1 << 22
NO_ID = np.iinfo(np.int64).max
RUN = np.dtype([("segment", "<u4"), ("at", "<u4"), ("count", "<u4"), ("id", "<i8")])
HEAD = np.dtype([("number", "<u4"), ("size", "<u4"), ("least", "<i8")])
UNITS = "ids binary, sizes binary, texts binary, bytes long"


@cache
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def pack(raw, level: int = 1) -> bytes:
    return compressor(level).compress(bytes(raw))


def unpack(raw) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def units_of(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Stored units: ids and byte counts of their documents, the texts behind each other."""

    def unit(ids: list, texts: list) -> pa.RecordBatch:
        row = {
            "ids": np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(),
            "sizes": np.array([len(t) for t in texts], "<i8").tobytes(),
            "texts": pack(b"".join(texts), 3),
            "bytes": sum(map(len, texts)),
        }
        return pa.RecordBatch.from_pydict({"blank": [np.array([i is None for i in ids], "u1").tobytes()], **{k: [v] for k, v in row.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1]) + 16
                if size >= UNIT:
                    yield unit(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield unit(ids, texts)

    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_bytes(quoted(text_col)).alias("text"))
    return stored(picked.mapInArrow(run, "blank binary, " + UNITS).withColumn("unit", F.monotonically_increasing_id()), folder, "units")


def six_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0]


def numbered(known: dict[bytes, int], keys: list[bytes]) -> np.ndarray:
    """The number of each key in ``known``, which takes up new ones in their order."""
    new = dict.fromkeys(k for k in keys if k not in known)
    known.update(zip(new, range(len(known), len(known) + len(new))))
    return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def mixed(text: np.ndarray, at: int, count: int, gram: int) -> np.ndarray:
    """Hashes of the pieces that start at ``at`` and after it; ``text`` ends behind the last one."""
    words = np.lib.stride_tricks.as_strided(text[at : at + 8].view("<u8"), (count + gram - 8,), (1,)).copy()
    h, shifted = np.zeros(count, np.uint64), np.empty(count, np.uint64)
    for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        if k:
            h ^= np.right_shift(h, np.uint64(29), out=shifted)
        h += words[k : k + count]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(32), out=shifted)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= np.right_shift(h, np.uint64(29), out=shifted)
    return h


class Unit:
    """One unit, opened: its documents and its runs of strings with one minimiser."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes, length: int, gram: int):
        self.length = length
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.text = np.frombuffer(unpack(texts), np.uint8)
        self.begins = np.r_[0, np.cumsum(self.sizes)]
        n, width = len(self.text), length - gram + 1
        padded = np.zeros(n + length + gram + 32, np.uint8)
        padded[:n] = self.text
        starts, values, last, last_at = [], [], None, -2
        whole = self.sizes >= length
        lows, highs = self.begins[:-1][whole], self.begins[1:][whole] - length + 1  # strings start in low..high-1
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            h = mixed(padded, lo, hi - lo + width, gram)
            span = 1
            while 2 * span <= width:
                h = np.minimum(h[:-span], h[span:])
                span *= 2
            rest = width - span
            h = (np.minimum(h[:-rest], h[rest:]) if rest else h)[: hi - lo] >> np.uint64(16)
            edge = np.zeros(hi - lo + 1, np.int32)
            a, b = int(np.searchsorted(highs, lo, "right")), int(np.searchsorted(lows, hi, "left"))
            np.add.at(edge, np.maximum(lows[a:b], lo) - lo, 1)
            np.add.at(edge, np.minimum(highs[a:b], hi) - lo, -1)
            valid = np.cumsum(edge[:-1]) > 0
            before = np.r_[np.uint64(0) if last is None else last, h[:-1]]
            fresh = valid & ((h != before) | ~np.r_[last_at == lo - 1, valid[:-1]])
            at = np.flatnonzero(fresh)
            starts.append(at + lo)
            values.append(h[at])
            last, last_at = h[-1], hi - 1 if valid[-1] else -2
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.begins, self.starts, "right") - 1
        close = self.begins[1:][self.doc] - length + 1 if len(self.doc) else self.starts
        self.counts = np.minimum(np.r_[self.starts[1:], n], close) - self.starts
        #: Distinct minimisers, and which of them each run has.
        self.distinct, self.which = np.unique(self.values, return_inverse=True)

    def several(self) -> np.ndarray:
        """Of each distinct minimiser: is it in two documents of the unit?"""
        low, high = np.full(len(self.distinct), NO_ID), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.ids[self.doc])
        np.maximum.at(high, self.which, self.ids[self.doc])
        return low < high

    def segments(self, shared: np.ndarray):
        """Distinct segments with shared minimisers: texts, minimisers, smallest ids; and the runs' places in them."""
        runs = np.flatnonzero(shared[self.which]) if len(self.which) else np.zeros(0, np.int64)
        known, starts = {}, self.starts[runs]
        place = numbered(known, cut(self.text.tobytes(), starts, starts + self.counts[runs] + self.length - 1))
        least = np.full(len(known), NO_ID)
        np.minimum.at(least, place, self.ids[self.doc[runs]])
        value = np.zeros(len(known), np.uint64)
        value[place] = self.values[runs]
        return list(known), value, least, runs, place


def opened(row: dict, length: int, gram: int) -> Unit:
    return Unit(row["ids"], row["sizes"], row["texts"], length, gram)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def shared_minimisers(units: DataFrame, owners: int, length: int, gram: int) -> DataFrame:
    """unit, answers: for each owner in turn the bits of the unit's distinct minimisers; found: how many are set."""
    edges = np.array([-((-k << 48) // owners) for k in range(owners)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            u = opened(row, length, gram)
            cuts = np.r_[np.searchsorted(u.distinct, edges), len(u.distinct)]
            several = u.several()
            out = {"owner": [], "unit": [], "hashes": [], "several": []}
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                out["owner"].append(k)
                out["unit"].append(row["unit"])
                out["hashes"].append(np.ascontiguousarray(u.distinct[part]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                out["several"].append(np.packbits(several[part]).tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("owner", pa.int32()), ("unit", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, hashes, several = [], [], []
        for row in rows_of(batches):
            hashes.append(six_bytes(row["hashes"]))
            several.append(np.unpackbits(np.frombuffer(row["several"], np.uint8), count=len(hashes[-1])))
            asked.append((row["owner"], row["unit"], len(hashes[-1])))
        if not asked:
            return
        hashes, several = np.concatenate(hashes), np.concatenate(several)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        count = np.diff(np.r_[first, len(hashes)])
        yes = (count > 1) | (np.maximum.reduceat(several[order], first) > 0)
        bits, at = np.empty(len(order), bool), 0
        bits[order] = np.repeat(yes, count)
        out = {"unit": [], "owner": [], "bits": [], "n": [], "found": []}
        for owner, unit, n in asked:
            part = bits[at : at + n]
            for name, value in zip(out, (unit, owner, np.packbits(part).tobytes(), n, int(part.sum()))):
                out[name].append(value)
            at += n
        yield pa.RecordBatch.from_pydict(out, pa.schema([("unit", pa.int64()), ("owner", pa.int32()), ("bits", pa.binary()), ("n", pa.int64()), ("found", pa.int64())]))

    asked = units.select("unit", "ids", "sizes", "texts").mapInArrow(ask, "owner int, unit long, hashes binary, several binary")
    answered = asked.repartitionById(owners, "owner").mapInArrow(answer, "unit long, owner int, bits binary, n long, found long")
    return answered.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("owner", "bits", "n"))).alias("answers"), F.sum("found").alias("found"))


def bits_of(answers: list[dict] | None) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in answers or []]
    return np.concatenate(parts) > 0 if parts else np.zeros(0, bool)


def segments(units: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """shard, unit and the unit's segments there: heads (steps of numbers, sizes, smallest ids), minimisers, texts."""
    schema = pa.schema([("shard", pa.int32()), ("unit", pa.int64()), ("heads", pa.binary()), ("values", pa.binary()), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shared = bits_of(row["answers"])
            if not shared.any():
                continue
            texts, value, least, _, _ = opened(row, length, gram).segments(shared)
            home = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(shards)
            order = np.argsort(home, kind="stable")
            home, texts = home[order], [texts[k] for k in order.tolist()]
            heads = np.zeros(len(order), HEAD)
            begins = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            heads["number"] = np.diff(order, prepend=0)
            heads["number"][begins] = order[begins]
            heads["size"], heads["least"] = np.fromiter(map(len, texts), np.int64, len(texts)), least[order]
            values = np.ascontiguousarray(value[order]).view(np.uint8).reshape(-1, 8)[:, :6]
            out = {f.name: [] for f in schema}
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
                out["shard"].append(int(home[a]))
                out["unit"].append(row["unit"])
                out["heads"].append(pack(b"".join(heads[f][a:b].tobytes() for f in HEAD.names)))
                out["values"].append(values[a:b].tobytes())
                out["texts"].append(pack(b"".join(texts[a:b])))
            yield pa.RecordBatch.from_pydict(out, schema)

    return units.mapInArrow(run, "shard int, unit long, heads binary, values binary, texts binary")


def places(sizes: np.ndarray) -> np.ndarray:
    """0 up to size - 1, for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Shard:
    """Segments of one shard, and who asked for them."""

    def __init__(self):
        self.raw, self.sizes, self.values = Spool(np.uint8), Spool(np.int64), Spool(np.uint64)
        self.asked = Spool(np.dtype([("number", "<u4"), ("place", "<i8"), ("least", "<i8")]))
        self.rows: list[tuple[int, int]] = []
        self.known: dict[bytes, int] = {}
        self.before = 0

    def add(self, row: dict):
        heads = unpack(row["heads"])
        n, at, head = len(heads) // HEAD.itemsize, 0, {}
        for f in HEAD.names:
            head[f] = np.frombuffer(heads, HEAD[f], n, at)
            at += n * HEAD[f].itemsize
        ends, known = np.cumsum(head["size"], dtype=np.int64), len(self.known)
        place = numbered(self.known, cut(unpack(row["texts"]), ends - head["size"], ends))
        new = place >= known  # a unit sends a segment once
        self.sizes.append(head["size"][new])
        self.values.append(six_bytes(row["values"])[new])
        asked = np.zeros(n, self.asked.dtype)
        asked["number"], asked["place"], asked["least"] = np.cumsum(head["number"]), place + self.before, head["least"]
        self.asked.append(asked)
        self.rows.append((row["unit"], n))
        if len(self.known) >= COLLAPSE:
            self.write()

    def write(self):
        """Put down the distinct segments seen since the last time."""
        self.raw.append(np.frombuffer(b"".join(self.known), np.uint8))
        self.before += len(self.known)
        self.known = {}

    def least(self) -> np.ndarray:
        """Of each segment: the smallest id that asks for it."""
        out, asked = room(self.before, np.int64, NO_ID), self.asked.array()
        for k in range(0, len(asked), CHUNK):
            part = asked[k : k + CHUNK]
            np.minimum.at(out, np.ascontiguousarray(part["place"]), np.ascontiguousarray(part["least"]))
        return out

    def contested(self) -> np.ndarray:
        """Of each segment: does another one have its minimiser? In passes over so many values at a time."""
        values = self.values.array()
        out, passes = room(len(values), bool, False), len(values) // (1 << 20) + 1
        for p in range(passes):
            at = np.flatnonzero(np.asarray(values) % np.uint64(passes) == p)
            found, which, count = np.unique(values[at], return_inverse=True, return_counts=True)
            out[at] = (count > 1)[which]
        return out

    def chosen(self, contested: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Contested segments, some at a time: numbers, sizes, bytes behind each other."""
        sizes, raw, at = self.sizes.array(), self.raw.array(), 0
        for k in range(0, len(sizes), LOT):
            size, mine = np.asarray(sizes[k : k + LOT]), np.asarray(contested[k : k + LOT])
            total = int(size.sum())
            if mine.any():
                yield k + np.flatnonzero(mine), size[mine], np.asarray(raw[at : at + total])[np.repeat(mine, size)]
            at += total

    def repeated(self, length: int, piece: int, contested: np.ndarray) -> np.ndarray:
        """Of each string of the contested segments, in turn: do its first and its last ``piece`` bytes occur twice in them?

        Hashes tell, so a yes may be wrong; a no is right.
        """
        spool, sizes = Spool(np.uint64), Spool(np.int64)
        for _, size, text in self.chosen(contested):
            h = mixed(np.r_[text, np.zeros(piece, np.uint8)], 0, len(text), piece)
            spool.append(h[places(size) <= np.repeat(size - piece, size)])
            sizes.append(size)
        hashes, passes = spool.array(), spool.n // HASHES + 1
        table = np.zeros(1 << min(26, max(10, (8 * spool.n).bit_length())), bool)
        mask = np.uint64(len(table) - 1)
        for p in range(passes):
            parts = []
            for k in range(0, spool.n, HASHES):
                part = np.asarray(hashes[k : k + HASHES])
                parts.append(part[(part >> np.uint64(32)) % np.uint64(passes) == p] if passes > 1 else part)
            part = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            table[part[1:][part[1:] == part[:-1]] & mask] = True
        out, sizes, at = Spool(bool), sizes.array(), 0
        for k in range(0, len(sizes), LOT):
            size = np.asarray(sizes[k : k + LOT])
            count = size - length + 1
            twice = table[np.asarray(hashes[at : at + int((size - piece + 1).sum())]) & mask]
            string = np.arange(int(count.sum())) + np.repeat(np.arange(len(size)) * (length - piece), count)
            out.append(twice[string] & twice[string + length - piece])
            at += len(twice)
        return out.array()

    def smallest(self, length: int, contested: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of equal smallest ids over the strings of each contested segment: first run of each, start, count, id.

        Text of the sorter: bytes plus one of strings that may be repeated, a zero behind each run of such strings.
        """
        wanted = self.repeated(length, max(min(GRAM, length), length - 15), contested)
        spool, starts_at, owners, counts_of, lots, n, at = Spool(np.uint16), Spool(np.int64), Spool(np.int64), Spool(np.int64), [], 0, 0
        for number, size, raw in self.chosen(contested):
            count = size - length + 1
            mine, which = np.asarray(wanted[at : at + int(count.sum())]), np.repeat(np.arange(len(size)), count)
            at += len(mine)
            same = which[1:] == which[:-1]
            first = np.flatnonzero(mine & np.r_[True, ~(mine[:-1] & same)])
            strings = np.flatnonzero(mine & np.r_[~(mine[1:] & same), True]) + 1 - first
            lots.append((len(first), len(mine)))
            bytes_ = strings + length - 1
            ends = np.cumsum(bytes_ + 1)
            symbols = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
            inside = np.ones(len(symbols), bool)
            inside[ends - 1] = False
            begin = first + which[first] * (length - 1)  # in the segments' bytes
            symbols[inside] = raw[np.repeat(begin, bytes_) + places(bytes_)].astype(np.uint16) + 1
            spool.append(symbols)
            starts_at.append(n + ends - bytes_ - 1)
            owners.append(least[number[which[first]]])
            counts_of.append(strings)
            n += len(symbols)
        text, begins, owners, counts_of = spool.array(), starts_at.array(), owners.array(), counts_of.array()
        order, shared = suffix_sort(text, length)
        group, low = -1, room(n, np.int64, NO_ID)
        for k in range(0, n, CHUNK):
            owner = owners[np.searchsorted(begins, order[k : k + CHUNK], "right") - 1]
            fresh = shared[k : k + CHUNK] < length
            which = group + np.cumsum(fresh)
            first = np.flatnonzero(np.r_[True, fresh[1:]])
            low[which[first]] = np.minimum(low[which[first]], np.minimum.reduceat(owner, first))
            group = int(which[-1])
        ids, group = room(n, np.int64), -1
        for k in range(0, n, CHUNK):
            which = group + np.cumsum(shared[k : k + CHUNK] < length)
            ids[order[k : k + CHUNK]] = low[which]
            group = int(which[-1])
        starts, counts, values, firsts, at, of, run = Spool(np.int64), Spool(np.int64), Spool(np.int64), Spool(np.int64), 0, 0, 0
        for (number, size, _), (runs, strings) in zip(self.chosen(contested), lots):
            count = size - length + 1
            which, found = np.repeat(np.arange(len(size)), count), np.repeat(least[number], count)
            many = np.asarray(counts_of[run : run + runs])
            found[np.asarray(wanted[at : at + strings])] = ids[np.repeat(begins[run : run + runs], many) + places(many)]
            at, run = at + strings, run + runs
            fresh = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (which[1:] != which[:-1])])
            starts.append(places(count)[fresh])
            counts.append(np.diff(np.r_[fresh, len(found)]))
            values.append(found[fresh])
            firsts.append(of + np.searchsorted(which[fresh], np.arange(len(size))))
            of += len(fresh)
        firsts.append([of])
        return firsts.array(), starts.array(), counts.array(), values.array()

    def answers(self, length: int) -> Iterator[tuple[int, bytes]]:
        """For each row that came in, runs whose id isn't just the smallest one that the unit has itself."""
        self.write()
        if not self.rows:
            return
        contested, least = self.contested(), self.least()
        rank = np.cumsum(contested) - 1
        firsts, starts, counts, values = self.smallest(length, contested, least)
        asked, sizes, at = self.asked.array(), self.sizes.array(), 0
        for unit, n in self.rows:
            part = np.asarray(asked[at : at + n])
            at += n
            sure = part[~contested[part["place"]]]
            sure = sure[least[sure["place"]] != sure["least"]]
            alone = np.zeros(len(sure), RUN)
            alone["segment"], alone["count"], alone["id"] = sure["number"], sizes[sure["place"]] - length + 1, least[sure["place"]]
            part = part[contested[part["place"]]]
            lo = firsts[rank[part["place"]]]
            many = firsts[rank[part["place"]] + 1] - lo
            tells = (many > 1) | (values[lo] != part["least"])
            part, lo, many = part[tells], lo[tells], many[tells]
            run = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            out = np.zeros(len(run), RUN)
            out["segment"], out["at"], out["count"], out["id"] = np.repeat(part["number"], many), starts[run], counts[run], values[run]
            if len(out) or len(alone):
                yield unit, pack(np.concatenate([alone, out]).tobytes())


def earliest(parts: DataFrame, shards: int, length: int) -> DataFrame:
    """unit, runs: what the shards say about the unit's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for row in rows_of(batches):
            shard.add(row)
        for unit, runs in shard.answers(length):
            yield pa.RecordBatch.from_pydict({"unit": [unit], "runs": [runs]})

    answered = parts.repartitionById(shards, "shard").mapInArrow(run, "unit long, runs binary")
    return answered.groupBy("unit").agg(F.collect_list("runs").alias("runs"))


def covered(u: Unit, shared: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """Which bytes of a unit a document with a smaller id has."""
    edge = np.zeros(len(u.text) + 1, np.int32)
    texts, _, least, runs, place = u.segments(shared)
    told = np.concatenate([np.frombuffer(unpack(a), RUN) for a in answers]) if answers else np.zeros(0, RUN)
    silent = np.ones(len(texts), bool)
    silent[told["segment"]] = False
    own = np.zeros(int(silent.sum()), RUN)
    own["segment"] = np.flatnonzero(silent)
    own["count"] = [len(texts[k]) - u.length + 1 for k in own["segment"].tolist()]
    own["id"] = least[own["segment"]]
    told = np.concatenate([told, own])
    told = told[np.argsort(told["segment"], kind="stable")]
    firsts = np.searchsorted(told["segment"], np.arange(len(texts) + 1))
    many = firsts[place + 1] - firsts[place]
    run = np.repeat(firsts[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    at, hit = np.repeat(runs, many), told[run]
    smaller = hit["id"] < u.ids[u.doc[at]]
    begin = (u.starts[at] + hit["at"])[smaller]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + hit["count"][smaller].astype(np.int64) + u.length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (bytes that stay), span_starts and span_ends (what went)."""
    folder = scratch(docs.sparkSession, "repeats")
    gram = min(GRAM, length)
    units = units_of(docs, folder, id_col, text_col)
    size = units.agg(F.sum("bytes")).first()[0] or 0
    shares = max(1, math.ceil(size / SHARE))
    answers = stored(shared_minimisers(units, shares, length, gram), folder, "answers")
    found = answers.agg(F.sum("found")).first()[0] or 0
    answers, shards = answers.drop("found"), max(shares, math.ceil(found / SEGMENTS))
    parts = segments(units.drop("bytes", "blank").join(answers.hint("shuffle_hash"), "unit"), shards, length, gram)
    runs = stored(earliest(parts, shards, length), folder, "runs")
    told = answers.join(runs, "unit", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shared = bits_of(row["answers"])
            sizes = np.frombuffer(row["sizes"], "<i8")
            begins = np.r_[0, np.cumsum(sizes)]
            if shared.any():
                u = opened(row, length, gram)
                text, gone = u.text, covered(u, shared, row["runs"] or [])
            else:
                text = np.frombuffer(unpack(row["texts"]), np.uint8)
                gone = np.zeros(len(text), bool)
            ids, blank = np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["blank"], "u1").tolist()
            out = []
            for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                part, here = gone[a:b], text[a:b]
                turns = np.flatnonzero(np.diff(np.r_[False, part, False])) if part.any() else np.zeros(0, np.int64)
                kept = here[~part] if len(turns) else here
                out.append((None if blank[k] else ids[k], b - a, kept.tobytes(), turns[::2].tolist(), turns[1::2].tolist()))
                if len(out) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    joined = units.drop("bytes").join(told.hint("shuffle_hash"), "unit", "left")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, span_starts array<long>, span_ends array<long>")
