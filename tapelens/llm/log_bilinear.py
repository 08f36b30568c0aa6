"""A log-bilinear language model, trained in numpy by noise-contrastive estimation.

The model's words are all training tokens with a count of ``LEAST`` or more (and the ``CLASSES``
most frequent, where those are fewer): they grow with the corpus. Only rarer words fall into
``ENDINGS`` classes by their last letters. Every word and every ending class is a unit with a
context vector R, a target vector Q and a bias b of its own. With position matrices C1 and C2 a
unit w after h1 h2 has the score (C1 R[h1] + C2 R[h2]) . Q[w] + b[w].

Units are sorted by their endings and cut into blocks of blocks (a tree of three levels, about
U^(1/3) branches each), whose nodes have target vectors and biases too. Every trainer takes all
levels through all training tokens of its rows, from one common start, against noise drawn from the
unigram distribution. A row of parameters is averaged over the trainers by how often each has seen it.
There are as many trainers as cores, and more only while each has ``SHARE`` tokens for every unit:
what they send stays in proportion to the corpus.
P(w | h1 h2) is the product of three softmaxes, each over a node's children: log Z is exact, in
batched products over the contexts that occur, and costs U^(1/3) a token. A word of an ending
class has its class's probability times (c + 1) / (N' + V' + 1), over that class's words.

Counts of all training tokens are a stored table that grows with the corpus. The model's words and
the ``FREQUENT`` most frequent are broadcast; other tokens of a document are looked up in a join,
where no token is frequent enough to be hot. Results of a document meet again under a row key.

Tokens are words between white space, A-Z lower-cased, then one end per text (the empty string,
which no word can be). Null texts count as empty: the end alone. Null ids are not held out.
Repeated rows give repeated results; an empty table gives an empty one. Without training tokens
all counts are 0. Texts are cut into words by Arrow, in slices of a batch. Only the two named columns
are read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, text_bytes

LEAST = 20
CLASSES, ENDINGS, DIMENSIONS, NOISE, BATCH, RATE, SEED = 1000, 256, 16, 32, 2048, 0.15, 42
FREQUENT = 200_000
#: Entries of a task's counter before it is passed on, bytes of a slice of texts, tokens scored at once, rare words in a row.
HELD, SLICE, SCORED, RARE = 300_000, 1 << 22, 1 << 18, 5_000
#: Tokens for every unit that a trainer has at least, where there are more trainers than cores.
SHARE = 64
#: Units whose parameters are averaged together.
BLOCK = 256
END = b""
MARKS = b".,;:!?\"')]#*$%&|<>"


def ending(word: bytes) -> int:
    """Class of a word that isn't frequent: its last letters, hashed."""
    return crc32(word.rstrip(MARKS)[-3:]) % ENDINGS


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def coded(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """The tokens of a batch, by slices of texts: the first text's place, where each text begins, every token's number, and the words of these numbers."""
    as_text = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + SLICE, "right")))
        part = pc.cast(texts[lo:hi], options=as_text)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        words, cuts = lists.flatten(), lists.offsets.to_numpy()
        there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # an outer space leaves an empty word
        cuts = np.concatenate([[0], np.cumsum(there)])[cuts - cuts[0]]
        found = words.filter(pa.array(there)).dictionary_encode()
        names = [*found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), END]
        yield lo, cuts[:-1] + np.arange(hi - lo), np.insert(found.indices.to_numpy().astype(np.int64), cuts[1:], len(names) - 1), names
        lo = hi


def units_of(names: list[bytes], known: np.ndarray, classes: int) -> np.ndarray:
    """Units of words: the known one's, or (where that is negative) an ending class's."""
    at = known.copy()
    other = np.flatnonzero(at < 0).tolist()
    at[other] = [classes + ending(names[i]) for i in other]
    return at


def token_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts; every task sends its own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "c"])
            seen.clear()

        for batch in batches:
            for _, _, codes, names in coded(batch.column(0)):
                for word, c in zip(names, np.bincount(codes, minlength=len(names)).tolist()):
                    seen[word] += c
                if len(seen) > HELD:
                    yield from out()
        yield from out()

    return train.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def branches(n: int) -> int:
    """Children of a node: the smallest number whose cube is at least ``n``."""
    k = max(2, round(n ** (1 / 3)))
    while k**3 < n:
        k += 1
    return k


def summed(x: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``x`` over blocks of ``size`` neighbours."""
    return np.add.reduceat(x, np.arange(0, len(x), size))


@dataclass
class Parameters:
    """Context vectors and position matrices; ``q``: target vectors with the bias last, of the tree's levels from the units up."""

    r: np.ndarray
    c: np.ndarray
    q: list[np.ndarray]
    k: int

    @classmethod
    def start(cls, share: np.ndarray, d: int) -> Parameters:
        rng = np.random.default_rng(SEED)
        k = branches(len(share))
        draw = lambda n: rng.standard_normal((n, d), np.float32) * np.float32(0.1)
        levels = [share, summed(share, k), summed(share, k * k)]
        q = [np.column_stack([draw(len(x)), np.log(x).astype(np.float32)]) for x in levels]
        return cls(draw(len(share)), np.concatenate([np.eye(d, dtype=np.float32)] * 2), q, k)

    @property
    def b(self) -> np.ndarray:
        return self.q[0][:, -1]

    def tables(self) -> list[np.ndarray]:
        return [self.r, self.c, *self.q]


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps over batches of (h1, h2, w), for each level of the tree."""

    def __init__(self, start: Parameters, share: np.ndarray, seed: int):
        self.k, self.c = start.k, start.c
        self.r, self.q = _with_sums(start.r), [_with_sums(q) for q in start.q]
        self.c_sums = np.full(start.c.shape, 1e-6, np.float32)
        shares = [share, summed(share, start.k), summed(share, start.k**2)]
        self.noise = [np.log(NOISE * x).astype(np.float32) for x in shares]
        self.ladders = [np.cumsum(x) for x in shares]
        self.rng = np.random.default_rng([SEED, seed])
        self.waiting: list[np.ndarray] = []
        self.seen = np.zeros(len(share), np.int64)
        self.n = self.trained = 0

    def add(self, units: np.ndarray, starts: np.ndarray, end: int) -> None:
        """Token units of texts, each closed by an end, and where the texts begin; contexts begin with two ends."""
        h1 = np.concatenate([[end], units[:-1]])
        h2 = np.concatenate([[end, end], units[:-2]])[: len(units)]
        h2[starts] = end
        triples = np.stack([h1, h2, units])
        for k in range(0, len(units), 8 * BATCH):
            self.waiting.append(triples[:, k : k + 8 * BATCH])
            self.n += self.waiting[-1].shape[1]
            if self.n >= 8 * BATCH:
                self.finish()

    def finish(self) -> None:
        if not self.n:
            return
        triples = np.concatenate(self.waiting, axis=1)
        self.seen += np.bincount(triples[2], minlength=len(self.seen))
        triples = triples[:, self.rng.permutation(triples.shape[1])]
        with np.errstate(over="ignore"):  # a sigmoid of nearly zero
            for k in range(0, triples.shape[1], BATCH):
                self.step(triples[:, k : k + BATCH])
        self.trained += self.n
        self.waiting, self.n = [], 0

    def step(self, triples: np.ndarray) -> None:
        n, d = triples.shape[1], self.c.shape[1]
        h1, h2, w = triples.take(np.argsort(triples[2], kind="stable"), 1)  # rows of a node stand together, on all levels
        pairs = np.stack([h1, h2], axis=1).ravel()
        order = np.argsort(pairs, kind="stable")
        ids, first = _runs(pairs.take(order))
        held = self.r.take(ids, 0)
        place = np.empty(2 * n, np.int64)
        place[order] = np.repeat(np.arange(len(ids)), np.diff(first, append=2 * n))
        both = np.ascontiguousarray(held[:, 0]).take(place, 0).reshape(n, 2 * d)
        context = np.zeros((n, d + 2), np.float32)  # the score, the bias's one, a zero that fills a pair
        np.matmul(both, self.c, out=context[:, :d])
        context[:, d] = 1

        drawn = [np.minimum(np.searchsorted(x, self.rng.random(NOISE) * x[-1]), len(x) - 1) for x in self.ladders]
        other = -np.concatenate([q.take(at, 0)[:, 0] for q, at in zip(self.q, drawn)])
        down = other @ context.T  # the levels' noise, one below the other
        down += np.concatenate([x.take(at) for x, at in zip(self.noise, drawn)])[:, None]
        _falling(down)
        g = down.T @ other[:, :d]
        pushed = down @ context
        pushed /= -n
        for k, (q, log_noise, noise) in enumerate(zip(self.q, self.noise, drawn)):
            at, first_at = _runs(w // self.k**k)
            rows, runs = q.take(at, 0), np.diff(first_at, append=n)
            own = np.repeat(rows[:, 0], runs, axis=0)
            up = _falling(np.einsum("ij,ij->i", context, own) - np.repeat(log_noise.take(at), runs))[:, None]
            own *= up
            g += own[:, :d]
            _move(q, at, rows, _sums(context * (up / n), first_at))
            turn = np.argsort(noise, kind="stable")
            at, first_at = _runs(noise.take(turn))
            _move(q, at, q.take(at, 0), _sums(pushed[k * NOISE : (k + 1) * NOISE].take(turn, 0), first_at))
        grad = both.T @ g / n
        back = (g @ (self.c.T / n)).reshape(2 * n, d)
        _move(self.r, ids, held, _sums(back.take(order, 0), first))
        self.c_sums += grad * grad
        self.c += RATE * grad / np.sqrt(self.c_sums)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, rows, times seen, values) of what this task has trained."""
        k, all_seen = self.k, [self.seen, np.full(len(self.c), self.trained)]
        tables = [self.r[:, 0], self.c, *[q[:, 0, : self.c.shape[1] + 1] for q in self.q]]
        for t, (x, seen) in enumerate(zip(tables, [*all_seen, self.seen, summed(self.seen, k), summed(self.seen, k * k)])):
            for at in range(0, len(x), BLOCK):
                ids = np.flatnonzero(seen[at : at + BLOCK]) + at
                if len(ids):
                    yield t, ids, seen[ids], x[ids]


def _with_sums(x: np.ndarray) -> np.ndarray:
    """A row's values (an even number of them) and their sums of squared gradients, side by side."""
    out = np.zeros((len(x), 2, x.shape[1] + x.shape[1] % 2), np.float32)
    out[:, 0, : x.shape[1]], out[:, 1] = x, 1e-6
    return out


def _falling(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array and where each begins."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x.take(first), first


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows of ``x``, two columns at a time."""
    return np.add.reduceat(x.view(np.complex64), first).view(np.float32)


def _move(x: np.ndarray, at: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """An AdaGrad step of the rows ``at`` of ``x``, which are ``rows``."""
    rows[:, 1] += grad * grad
    grad *= RATE
    grad /= np.sqrt(rows[:, 1])
    rows[:, 0] += grad
    x[at] = rows


def trainers(n_tokens: int, units: int, cores: int) -> int:
    """Into how many shares the training rows go at most: a multiple of the cores."""
    return cores * max(1, n_tokens // (SHARE * units * cores))


ROWS = "part int, block int, ids binary, seen binary, x binary"


def averaged(parts: pa.Table) -> pa.Table:
    """One block of a table of parameters from the tasks' rows of it, each weighted by how often it was seen."""
    t, block = parts.column("part")[0].as_py(), parts.column("block")[0].as_py()
    n, total = np.zeros(BLOCK), None
    for ids, seen, x in zip(*(parts.column(c).to_pylist() for c in ("ids", "seen", "x"))):
        at, weight = np.frombuffer(ids, np.int64) - block * BLOCK, np.frombuffer(seen, np.int64)
        values = np.frombuffer(x, np.float32).reshape(len(at), -1)
        total = np.zeros((BLOCK, values.shape[1])) if total is None else total
        n[at] += weight
        total[at] += weight[:, None] * values
    at = np.flatnonzero(n)
    x = np.round(total[at] / n[at, None], 6).astype(np.float32)
    return pa.Table.from_batches([_rows(t, at + block * BLOCK, n[at].astype(np.int64), x)])


def _rows(t: int, ids: np.ndarray, seen: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    blobs = [pa.array([v.tobytes()], pa.binary()) for v in (ids.astype(np.int64), seen.astype(np.int64), x.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([ids[0] // BLOCK], pa.int32()), *blobs], names=["part", "block", "ids", "seen", "x"])


@dataclass
class Model:
    """Everything that scoring broadcasts: the words known map-side and the parameters of all units."""

    words: list[bytes]
    counts: np.ndarray
    units: np.ndarray  # of each known word
    classes: int  # words with a unit of their own; the ending classes' units follow
    end: int
    n_tokens: int
    n_types: int
    parameters: Parameters
    rest: np.ndarray  # tokens and types of each ending class

    def log_probability(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(unit w | h1 h2)."""
        p = self.parameters
        if not hasattr(self, "first"):
            d = p.r.shape[1]
            self.first, self.second = p.r @ p.c[:d], p.r @ p.c[d:]
        key = np.sort(w * len(w) + np.arange(len(w)))  # children of a node stand together, on all levels
        w = key // max(1, len(w))
        order = key - w * len(w)
        context = np.ones((len(w), p.r.shape[1] + 1), np.float32)
        np.add(self.first.take(h1.take(order), 0), self.second.take(h2.take(order), 0), out=context[:, :-1])
        logs = np.zeros(len(w))
        z, ones = np.empty(len(w), np.float32), np.ones(p.k, np.float32)
        for level, q in enumerate(p.q):
            parent = w // p.k ** (level + 1)
            cuts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1], True]) if len(w) else [0]
            for lo, hi, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), parent[cuts[:-1]].tolist()) if len(w) else ():
                children = q[k * p.k : (k + 1) * p.k].T
                for a in range(lo, hi, 8192):
                    s = context[a : min(hi, a + 8192)] @ children
                    np.exp(s, s)
                    np.matmul(s, ones[: s.shape[1]], out=z[a : a + len(s)])
            log_z = np.log(z)
            for i in np.flatnonzero(~((z > 1e-30) & (z < 1e30))).tolist():  # out of range of short floats
                s = q[parent[i] * p.k : (parent[i] + 1) * p.k].astype(float) @ context[i]
                log_z[i] = s.max() + np.log(np.exp(s - s.max()).sum())
            logs += np.einsum("ij,ij->i", context, q.take(w // p.k**level, 0)) - log_z
        out = np.empty(len(w))
        out[order] = logs
        return out


def rest_sizes(counts: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """Tokens and types of each ending class, over the words outside ``frequent`` (ENDINGS rows)."""
    known = counts.sparkSession.sparkContext.broadcast(set(frequent))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if word not in known.value:
                    k = ending(word)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS, dtype=np.int32)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    out = np.zeros((ENDINGS, 2), np.int64)
    for r in counts.mapInArrow(add, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        out[r["k"]] = r["n"], r["v"]
    return out


def size_class() -> Column:
    """Counts in steps of a sixteenth of a power of two."""
    return F.floor(F.log2("c") * 16).cast("int")


def frequency_bound(counts: DataFrame, most: int) -> int:
    """The smallest size class from which on there are at most ``most`` words; a histogram of a few hundred rows."""
    total, bound = 0, 1 << 30
    for r in sorted(counts.groupBy(size_class().alias("k")).count().collect(), key=lambda r: -r["k"]):
        total += r["count"]
        if total > most:
            break
        bound = r["k"]
    return bound


def learn(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the stored counts (word, c) of all training tokens."""
    train = docs.where(~held_out(id_col)).select(text_bytes(text_col).alias("text"))
    counts = stored(token_counts(train), folder, "counts")
    is_end = F.octet_length("word") == 0
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0)).alias("ends")).first()
    bound = frequency_bound(counts, FREQUENT)
    known = counts.where((size_class() >= bound) | (F.col("c") >= LEAST) | is_end).toArrow()
    top = sorted(zip(known.column("c").to_pylist(), known.column("word").to_pylist()), key=lambda x: (x[1] != END, -x[0], x[1]))  # the end always has a unit
    words, freq = [w for _, w in top], np.array([c for c, _ in top], np.int64)
    if not words:
        words, freq = [END], np.zeros(1, np.int64)
    classes = max(min(CLASSES, len(words)), 1 + int((freq[1:] >= LEAST).sum()))
    rest = rest_sizes(counts, words[:classes])
    order = sorted(range(classes), key=lambda k: words[k].rstrip(MARKS)[::-1])
    units = np.array([0] * classes + [classes + ending(w) for w in words[classes:]], np.int64)
    units[order] = np.arange(classes)
    end = int(units[0])
    seen = np.concatenate([freq[order], rest[:, 0]]) + 1.0
    share = seen / seen.sum()
    shared = docs.sparkSession.sparkContext.broadcast(([words[k] for k in order], share))

    def train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, odds = shared.value
        ids = {w: i for i, w in enumerate(names)}
        trainer = Trainer(Parameters.start(odds, DIMENSIONS), odds, TaskContext.get().partitionId())
        for batch in batches:
            for _, starts, codes, found in coded(batch.column(0)):
                at = np.fromiter(map(ids.get, found, repeat(-1)), np.int64, len(found))
                trainer.add(units_of(found, at, len(names)).take(codes), starts, end)
        trainer.finish()
        if trainer.trained:
            for rows in trainer.rows():
                yield _rows(*rows)

    parameters = Parameters.start(share, DIMENSIONS)
    tables = parameters.tables()
    split = train.coalesce(trainers(int(total["n"]), len(share), docs.sparkSession.sparkContext.defaultParallelism))
    for r in split.mapInArrow(train_task, ROWS).groupBy("part", "block").applyInArrow(averaged, ROWS).toArrow().to_batches():
        for t, ids, x in zip(*(r.column(c).to_pylist() for c in ("part", "ids", "x"))):
            ids = np.frombuffer(ids, np.int64)
            tables[t][ids] = np.frombuffer(x, np.float32).reshape(len(ids), -1)
    shared.unpersist()
    return Model(words, freq, units, classes, end, int(total["n"]), int(total["v"]), parameters, rest), counts


PARTIAL = "row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, model_log double, rare array<binary>"


def score_parts(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """What a document's frequent tokens give, with its other tokens in ``rare``; long lists take several rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        index = {w: i for i, w in enumerate(m.words)}
        logs = np.log10(m.counts + 1.0)
        scale = np.concatenate([np.zeros(m.classes), np.log10(m.rest.sum(axis=1) + 1.0)])
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, starts, codes, found in coded(batch.column(2)):
                n = len(starts)
                at = np.fromiter(map(index.get, found, repeat(-1)), np.int64, len(found))
                unit = units_of(found, np.where(at < 0, -1, m.units[at]), m.classes)
                known = (at >= 0) & (m.counts[at] > 0)
                found_log = np.where(known, logs[at], 0.0)
                within = np.where(at >= m.classes, logs[at], 0.0) - scale[unit]
                units, end = unit.take(codes), np.int64(m.end)
                h1 = np.concatenate([[end], units[:-1]])
                h2 = np.concatenate([[end, end], units[:-2]])[: len(units)]
                h2[starts] = end
                scores = within.take(codes)
                for k in range(0, len(units), SCORED):
                    part = slice(k, k + SCORED)
                    scores[part] += m.log_probability(h1[part], h2[part], units[part]) / np.log(10)
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64).take(codes), found_log.take(codes), scores)]
                places = np.flatnonzero(at.take(codes) < 0)
                first = np.searchsorted(places, starts)  # rare words of the texts before
                rows = np.maximum(1, -(-np.diff(first, append=len(places)) // RARE))
                of = np.repeat(np.arange(n), rows)
                more = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
                head, none = more == 0, pa.nulls(len(of))
                rare = pa.array(found, pa.binary()).take(pa.array(codes.take(places)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + of),
                        *[pc.if_else(pa.array(head), batch.column(c).slice(lo, n).take(pa.array(of)), none.cast(batch.column(c).type)) for c in (0, 1)],
                        *[pa.array(np.where(head, x[of], 0)) for x in (np.diff(starts, append=len(codes)), *sums)],
                        pa.ListArray.from_arrays(pa.array(np.append(first[of] + more * RARE, len(places)), pa.int32()), rare),
                    ],
                    names=[c.split()[0] for c in PARTIAL.split(", ")],
                )
                key += n

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("text"))
    return picked.mapInArrow(run, PARTIAL)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    folder = scratch(docs.sparkSession, "log-bilinear")
    model, counts = learn(docs, folder, id_col, text_col)
    parts = stored(score_parts(docs, model, id_col, text_col), folder, "parts")
    rare = parts.select("row_key", F.explode("rare").alias("word")).join(counts, "word", "left")
    found = rare.select(
        "row_key",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.col("c").isNotNull().cast("long").alias("n_known"),
        F.log10(F.coalesce("c", F.lit(0)) + 1.0).alias("known_log"),
        F.log10(F.coalesce("c", F.lit(0)) + 1.0).alias("model_log"),
    )
    sums = parts.drop("rare").unionByName(found).groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "known_log", "model_log")]
    )
    n, v = model.n_tokens, model.n_types
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        F.col("model_log").alias("score"),
    )
