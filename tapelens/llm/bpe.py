"""Byte-level BPE by backtracking over an Aho-Corasick automaton, and its inverse.

Bytes are read as Latin-1 characters, so the automaton finds every token at every position in one
pass. The encoder places the longest token, and steps back to a shorter one where two neighbours
could not stand side by side in a true merge sequence. Whether two tokens can is decided by
undoing their merges from the latest on (memoised); positions that led nowhere stay closed, so a
piece takes linear time. The result is that of applying the merges one by one.

``encode_documents`` gives ids (and, if asked, the bytes that these ids decode to) per row. Null
texts count as empty: no ids. Very long texts are worked off in slices; one piece without any
white space is matched in blocks, so memory stays small. Repeated rows give repeated results, an
empty table an empty one. Only the two named columns are read.
"""
from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, slices
from .token_counts import pieces

#: Start positions matched at once in a long piece, and how many such blocks are kept.
BLOCK, BLOCKS = 8192, 4
CACHE_SIZE, PAIRS = 500_000, 1_000_000
#: Ids decoded at once.
DECODE_STEP = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file (base64 token and rank a line); ranks have no gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class BytePairs:
    """Encoder and decoder over tokens in merge order."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        self.longest = max(self.sizes)
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.memo: dict[int, bool] = {}
        self.merged: dict[int, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        for i, t in enumerate(tokens):
            self.parts.append(self._last_merge(i, t))
        self.memo.clear()
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size_of = np.array(self.sizes, np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of

    def _last_merge(self, i: int, token: bytes) -> tuple[int, int] | None:
        """The two earlier tokens whose merge gives this one; None for a single byte."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ids.get(token[:cut], i), self.ids.get(token[cut:], i)
            if a < i and b < i and self._compatible(a, b):
                self.merged[a << 32 | b] = i
                return a, b
        return None

    def _compatible(self, a: int, b: int) -> bool:
        """Do the merges of the joined bytes leave exactly a and b?

        Walk back through the merges of both sides, the latest first. If the two tokens that face
        each other could merge earlier than the merge just undone, that merge would have won.
        """
        merged, parts = self.merged, self.parts
        before = len(self.tokens)
        while True:
            joint = merged.get(a << 32 | b)
            if joint is not None and joint < before:
                return False
            pa_, pb = parts[a], parts[b]
            if pa_ is not None and (a > b or pb is None):
                before, a = a, pa_[1]
            elif pb is not None:
                before, b = b + 1, pb[0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._compatible(a, b)
        return known

    def _found(self, text: str, begin: int) -> list[list[int]]:
        """Tokens at each of BLOCK start positions, shortest first."""
        stop = min(len(text), begin + BLOCK)
        found: list[list[int]] = [[] for _ in range(stop - begin)]
        sizes = self.sizes
        for end, i in self.automaton.iter(text[begin : stop + self.longest - 1]):
            start = end - sizes[i] + 1
            if start < stop - begin:
                found[start].append(i)
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        text, n, sizes = data.decode("latin-1"), len(data), self.sizes
        blocks: dict[int, list[list[int]]] = {}

        def at(pos: int) -> list[int]:
            k = pos // BLOCK
            if k not in blocks:
                if len(blocks) >= BLOCKS:
                    del blocks[min(blocks) if k > min(blocks) else max(blocks)]
                blocks[k] = self._found(text, k * BLOCK)
            return blocks[k][pos % BLOCK]

        out: list[int] = []
        tried: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        pos, level = 0, len(at(0)) - 1 if n else -1
        while pos < n:
            choice = at(pos)
            while level >= 0:
                i = choice[level]
                if alive[pos + sizes[i]] and (not out or self.fits(out[-1], i)):
                    break
                level -= 1
            if level >= 0:
                out.append(i)
                tried.append(level)
                pos += sizes[i]
                level = len(at(pos)) - 1 if pos < n else -1
            else:
                alive[pos] = 0
                pos -= sizes[out.pop()]
                level = tried.pop() - 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, in steps of DECODE_STEP ids."""
        out = []
        for k in range(0, len(ids), DECODE_STEP):
            part = ids[k : k + DECODE_STEP]
            size = self.size_of[part]
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) + np.repeat(self.start_of[part] - (ends - size), size)
            out.append(self.flat[index].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[BytePairs, Cache]:
    """Encoder of a worker process with its caches: pieces of text, and below them the pattern's
    matches (a word met with new marks is not encoded again) -> ids as int32 bytes."""
    pairs, split = BytePairs(read_ranks(path)), regex.compile(pattern)
    matches = Cache(lambda found: [array("i", pairs.encode_piece(m.encode())).tobytes() for m in found], CACHE_SIZE // 2)

    def make(texts: list[str]) -> list[bytes]:
        parts = [split.findall(t) for t in texts]
        known = matches.prepare(m for ms in parts for m in ms)
        return [b"".join(map(known.__getitem__, ms)) for ms in parts]

    return pairs, Cache(make, CACHE_SIZE)


def encode_documents(docs: DataFrame, path: str, pattern: str, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int>, and decoded binary if asked.

    ``pattern`` must always cut before a single space between two non-spaces, as the public
    byte-level patterns do; pieces between such cuts are encoded on their own and cached.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, cache = coder(path, pattern)
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1).to_pylist()):
                buffers = []
                for text in texts:
                    buffers.append(b"".join(b"".join(map(cache.prepare(x).__getitem__, x)) for x in slices(pieces(text))))
                flat = np.frombuffer(b"".join(buffers), np.int32)
                ends = np.cumsum([0] + [len(b) // 4 for b in buffers]).astype(np.int32)
                columns = [batch.column(0).slice(done, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decode:
                    columns.append(pa.array([pairs.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decode)
