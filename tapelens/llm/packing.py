"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers (powers of two): full windows of the largest tier are
cut off, the rest goes to the smallest tier that holds it. Tiers are packed from the longest to
the shortest: a window takes one own fragment, its gap is filled best-fit from shorter tiers, and
where none fits exactly a fragment is cut. What is left at the end of a task is laid out in
windows whose sizes are powers of two, so no sequence needs padding. Sequences are then dealt to
step groups so that each group has about ``step_tokens`` tokens, the largest to the emptiest.

Packing is local to a task and works on ``BUFFER`` tokens at a time: no shuffle, memory is
bounded, and a repeated task gives the same pieces and ids.

Null texts count as empty: they hold the end id alone. Very long texts are worked off in slices
of words. Repeated rows are packed as often as they come, an empty table gives an empty result.
Only the two named columns are read.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, slices, text_bytes

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
#: Tokens that wait to be packed in a task.
BUFFER = 2_000_000
CACHE_SIZE = 500_000
#: As the tokenizer file writes that runs of marks are tokens of their own; words that end in such a run.
SPLIT = json.dumps(r"[^\s\p{L}\p{N}]+")[1:-1]
STEM_AND_MARKS = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([.,;:!?*$%&#|()\[\]\"]+)\Z", re.S)
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"


class Words:
    """Tokenizer with a cache of words (UTF-8) -> ids as little-endian uint32 bytes.

    For files whose tokenizer drops white space. If it lower-cases as well, A-Z are lower-cased
    first, unless the text then holds the string of a special token.
    """

    def __init__(self, path: str, cache_words: int = CACHE_SIZE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        batch = getattr(model, "encode_batch_fast", model.encode_batch)
        normalizer = json.loads(model.to_str())["normalizer"] or {}
        self.lower = any(x["type"] == "Lowercase" for x in normalizer.get("normalizers", [normalizer]) if x)
        self.special = [x.content.lower().encode() for x in model.get_added_tokens_decoder().values()]
        self.splits = self.lower and SPLIT in json.dumps(json.loads(model.to_str())["pre_tokenizer"])
        self.stems = Cache(lambda words: [array("I", x.ids).tobytes() for x in batch([w.decode() for w in words], add_special_tokens=False)], cache_words // 2)
        self.cache = Cache(self.make, cache_words)

    def make(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; where the pre-tokenizer cuts between letters and marks, both are looked up alone."""
        parts = [m.groups() if (m := STEM_AND_MARKS.match(w)) and b"<|" not in w else (w,) for w in words] if self.splits else [(w,) for w in words]
        known = self.stems.prepare(p for ps in parts for p in ps)
        return [b"".join(map(known.__getitem__, ps)) for ps in parts]

    def ids(self, text: bytes) -> bytes:
        if self.lower:
            low = text.lower()
            if not any(s in low for s in self.special):
                text = low
        prepare = self.cache.prepare
        return b"".join(b"".join(map(prepare(x).__getitem__, x)) for x in slices(text.split()))


@lru_cache(maxsize=2)
def words_of(path: str, cache_words: int = CACHE_SIZE) -> Words:
    return Words(path, cache_words)


def tokenize(text: bytes, words: Words, end_id: int) -> bytes:
    """Ids of a text and the end id; words between white space are independent of each other."""
    return words.ids(text) + array("I", [end_id]).tobytes()


class Packer:
    """Packs the documents of one task. A fragment is (document, first id, ids)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.longest = self.tiers[-1]
        self.next_sequence = self.next_group = first_id
        self.docs: list[tuple] = []
        self.waiting: list[tuple[int, int, int]] = []
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.size = 0

    def add(self, doc_id, ids: bytes) -> None:
        k, n = len(self.docs), len(ids) // 4
        self.docs.append((doc_id, ids))
        self.size += n
        full = n - n % self.longest
        for start in range(0, full, self.longest):
            self.windows.append((self.longest, [(k, start, self.longest)]))
        if full < n:
            self.waiting.append((k, full, n - full))

    def pack(self, last: bool) -> list[tuple]:
        """Rows of all windows that are full; the rest waits unless ``last``."""
        pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # (ids, document, first id)
        for k, start, n in self.waiting:
            insort(pools[next(t for t in self.tiers if n <= t)], (n, k, start))
        self.waiting = []
        for i in range(len(self.tiers) - 1, -1, -1):
            tier, own = self.tiers[i], pools[self.tiers[i]]
            shorter = [pools[t] for t in self.tiers[i::-1]]  # the own tier last helps to fill the shortest windows
            while own:
                n, k, start = own.pop()
                window, gap = [(k, start, n)], tier - n
                while gap and (piece := self._fill(gap, shorter[1:] if i else shorter)):
                    window.append(piece)
                    gap -= piece[2]
                if gap:  # nothing shorter is left: the window's content waits
                    self.waiting += window
                else:
                    self.windows.append((tier, window))
        if last:
            self._tail()
        return self._rows()

    @staticmethod
    def _fill(gap: int, pools: list[list[tuple[int, int, int]]]) -> tuple[int, int, int] | None:
        """The longest fragment that fits, or else the start of the shortest that doesn't."""
        for pool in pools:
            at = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if at >= 0:
                n, k, start = pool.pop(at)
                return k, start, n
        for pool in reversed(pools):
            if pool:
                n, k, start = pool.pop(0)
                insort(pool, (n - gap, k, start + gap))
                return k, start, gap
        return None

    def _tail(self) -> None:
        """Lay out what waits, end to end, in windows of the longest tier and then of powers of two."""
        total = sum(n for _, _, n in self.waiting)
        sizes = [self.longest] * (total // self.longest) + [1 << b for b in range(self.longest.bit_length() - 2, -1, -1) if (total % self.longest) >> b & 1]
        rest = iter(self.waiting)
        k = start = n = 0
        for size in sizes:
            window, gap = [], size
            while gap:
                if not n:
                    k, start, n = next(rest)
                took = min(n, gap)
                window.append((k, start, took))
                start, n, gap = start + took, n - took, gap - took
            self.windows.append((size, window))
        self.waiting = []

    def _rows(self) -> list[tuple]:
        windows = sorted(self.windows, key=lambda w: -w[0])
        groups = max(1, -(-sum(w[0] for w in windows) // self.step_tokens))
        load = [(0, g) for g in range(groups)]
        heapify(load)
        rows = []
        for size, window in windows:
            filled, g = load[0]
            heapreplace(load, (filled + size, g))
            offset = 0
            tier = next((t for t in self.tiers if size <= t))
            for k, start, n in window:
                doc_id, ids = self.docs[k]
                rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, self.next_sequence, offset, size, tier, self.next_group + g))
                offset += n
            self.next_sequence += 1
        self.next_group += groups
        kept = sorted({k for k, _, _ in self.waiting})
        renamed = {k: i for i, k in enumerate(kept)}
        self.docs = [self.docs[k] for k in kept]
        self.waiting = [(renamed[k], start, n) for k, start, n in self.waiting]
        self.windows, self.size = [], sum(n for _, _, n in self.waiting)
        return rows


def pack_documents(
    docs: DataFrame, path: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_SIZE
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id,
    offset, sequence_tokens, tier, step_group. Sequences are full: their tokens are a power of two.
    ``cache_words`` bounds the words that a worker remembers."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path, cache_words)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 36)
        schema = None

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 5000]), schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([(id_col, batch.schema.field(0).type), *((n, pa.int64()) for n in ("start", "length")), ("ids", pa.binary()), *((n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset", "sequence_tokens")), ("tier", pa.int32()), ("step_group", pa.int64())])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, tokenize(text.as_py(), words, end_id))
                if packer.size >= BUFFER:
                    yield from out(packer.pack(last=False))
        if packer.docs:
            yield from out(packer.pack(last=True))

    picked = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {SCHEMA}")
