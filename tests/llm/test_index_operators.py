"""Ranked search, suffix-array dedup and Merkle manifest against brute force."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapelens.llm import induced, merkle, ranking, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, unit long, branch int"


def docs_frame(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, g, s, n, "x", 1, 2) for i, t, g, s, n in rows], SCHEMA)


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    words = ["alpha", "Beta", "gam-ma", "é", "日本", "x1", "the", "the", "of"]
    passage = "a passage of more than fifty bytes that many of the documents share, é日 " * 2
    out = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        if i % 3 == 0:
            text += passage[rng.randrange(20) :] + text
        out.append((rng.randrange(40) if i % 9 else None, None if i % 11 == 5 else text, rng.choice(["en", "de", None, ""]), rng.choice([None, "s"]), i))
    out += [(70, "q" * 300, "en", None, None), (71, "q" * 80 + "r", "en", None, 1), (72, "ab" * 500, "fr", "s", 2), (73, "", "one", "s", 0)]
    out += [(74, "long " * 20_000 + passage, "en", "s", 3), out[3], out[3]]
    return out


# ---- ranked search ----------------------------------------------------------------------------


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(rows, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        asked = terms(text)
        hits = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            if score > 0:
                hits.append((-score, i is None, i or 0))
        for r, (score, blank, i) in enumerate(sorted(hits)[:k]):
            out.append((item, r + 1, None if blank else i, -score))
    return sorted(map(repr, out))


ITEMS = [(1, "alpha the THE beta"), (2, "nothing known"), (3, None), (4, "日本 x1 é"), (4, "alpha"), (5, "passage of more than fifty bytes x1 x1"), (1, "alpha the THE beta"), (None, "gam")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ranking(spark, monkeypatch, k):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    monkeypatch.setattr(ranking, "SHARD_DOCS", 9)
    monkeypatch.setattr(ranking, "ITEMS", 3)
    rows = odd_rows()
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string")
    got = ranking.rank_documents(docs_frame(spark, rows), items, k)
    assert sorted(map(repr, map(tuple, got.collect()))) == ranked(rows, ITEMS, k)
    assert ranking.rank_documents(docs_frame(spark, rows).limit(0), items).count() == 0
    assert ranking.rank_documents(docs_frame(spark, rows), items.limit(0)).count() == 0


def test_codes_and_block_search():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 33, 1000) >> rng.integers(0, 33, 1000)
    assert (ranking.decode(ranking.encode(values)[0]) == values).all()
    builder = ranking.Builder()
    for i in range(300):
        builder.add(i, b"w%d the" % (i % 7) + b" the" * (i % 5))
    row = builder.shard().to_pylist()[0]
    total = row["terms"]

    shard = ranking.Shard({k: pa.py_buffer(v) for k, v in row.items() if isinstance(v, bytes)}, 300, total)
    decoded = []
    inner = shard.postings
    shard.postings = lambda blocks: decoded.append(len(blocks)) or inner(blocks)
    hits = shard.search([(b"w3", 5000), (b"the", 1)], 3)
    assert len(hits) == 3 and all(i % 7 == 3 for i, _ in hits)
    assert sum(decoded) <= 1 + 3  # of the 3 blocks of the frequent term at most those with candidates


# ---- suffix arrays ----------------------------------------------------------------------------


def sorted_suffixes(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i : i + cap])

    def shared(a, b):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        return k

    return order, [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def test_induced_sorting(monkeypatch):
    """Tiny chunks, queues that spill at once and deep recursion give the same order."""
    rng = random.Random(7)
    for case in range(400):
        t = np.array([rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(1, 60))], np.uint16)
        t = np.repeat(t, rng.randrange(1, 5)) if case % 5 == 0 else np.tile(t, 3) if case % 7 == 0 else t
        for name, choices in (("CHUNK", (1, 3, 1 << 18)), ("MEMORY", (9, 60, 1 << 20)), ("SMALL", (16, 1 << 20))):
            monkeypatch.setattr(induced, name, rng.choice(choices))
        cap, base = rng.choice([3, 10, 60]), rng.choice([1, 4, 1000])
        order, lcp = induced.suffix_sort(t, cap, base)
        plain = t.tolist()
        assert sorted(order.tolist()) == list(range(len(plain)))
        keys = [plain[i : i + cap] for i in order.tolist()]
        assert keys == sorted(keys) and lcp.tolist() == sorted_suffixes(plain, cap)[1]
    assert len(induced.suffix_sort(np.zeros(0, np.uint16), 50)[0]) == 0


def removed(rows, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in texts:
        k = math.inf if i is None else i
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, math.inf), k)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (math.inf if i is None else i):
                gone[p : p + length] = b"\1" * length
        edges = [k for k in range(len(t) + 1) if (gone[k] if k < len(t) else 0) != (gone[k - 1] if k else 0)]
        out.append((i, len(t), bytes(c for c, g in zip(t, gone) if not g), edges[::2], edges[1::2]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("length, unit", [(50, 1 << 20), (50, 3000), (12, 2000)])
def test_repeats(spark, monkeypatch, length, unit):
    monkeypatch.setattr(repeats, "UNIT", unit)
    monkeypatch.setattr(repeats, "SHARE", 20_000)
    monkeypatch.setattr(repeats, "COLLAPSE", 50)
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000]
    got = repeats.remove_repeats(docs_frame(spark, rows), length).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, bytes(r.kept), r.span_starts, r.span_ends)) for r in got) == removed(rows, length)
    assert repeats.remove_repeats(docs_frame(spark, rows).limit(0), length).count() == 0


def test_repeats_in_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(repeats, "UNIT", 4000)
    df = docs_frame(spark, odd_rows())
    columns = ["doc_id", "n_bytes", F.sha2("kept", 256), "span_starts", "span_ends"]
    answers = {tuple(sorted(map(repr, repeats.remove_repeats(df.repartition(n)).select(*columns).collect()))) for n in (1, 5)}
    assert len(answers) == 1


def test_shards_follow_the_segments_sent(spark, monkeypatch):
    seen, segments = [], repeats.segments
    monkeypatch.setattr(repeats, "SEGMENTS", 10)
    monkeypatch.setattr(repeats, "segments", lambda units, shards, *rest: (seen.append(shards), segments(units, shards, *rest))[1])
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000]
    repeats.remove_repeats(docs_frame(spark, rows))
    assert 1 < seen[0] < 200 and repeats.SEGMENTS < repeats.COLLAPSE


def test_shard_sorts_only_what_may_repeat(monkeypatch):
    """One minimiser, many contexts: strings that occur once in a shard never reach its sorter."""
    rng, sorted_sizes = random.Random(5), []
    text = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    gram, shared = text(20), text(25)
    units = [[(text(30) + gram + text(30), 100 + rng.randrange(50)) for _ in range(40)] for _ in range(4)]
    for k, unit in enumerate(units):
        unit += [(shared + gram + shared[:10] + text(15), 3 + k), (text(5) + shared + gram + shared, 20 - k)]
    monkeypatch.setattr(repeats, "LOT", 8)
    monkeypatch.setattr(repeats, "HASHES", 64)
    monkeypatch.setattr(repeats, "COLLAPSE", 50)
    sort = repeats.suffix_sort
    monkeypatch.setattr(repeats, "suffix_sort", lambda t, cap: (sorted_sizes.append(len(t)), sort(t, cap))[1])
    shard, low = repeats.Shard(), {}
    for k, unit in enumerate(units):
        heads = np.zeros(len(unit), repeats.HEAD)
        heads["number"][1:], heads["size"], heads["least"] = 1, [len(t) for t, _ in unit], [i for _, i in unit]
        packed = repeats.pack(b"".join(heads[f].tobytes() for f in repeats.HEAD.names))
        shard.add({"unit": k, "heads": packed, "values": b"minims" * len(unit), "texts": repeats.pack(b"".join(t for t, _ in unit))})
        for t, i in unit:
            for a in range(len(t) - 49):
                low[t[a : a + 50]] = min(i, low.get(t[a : a + 50], i))
    told = {k: np.frombuffer(repeats.unpack(r), repeats.RUN) for k, r in shard.answers(50)}
    assert sum(sorted_sizes) < sum(len(t) for unit in units for t, _ in unit) / 4
    for k, unit in enumerate(units):
        for number, (t, i) in enumerate(unit):
            got = [i] * (len(t) - 49)
            for run in told[k][told[k]["segment"] == number] if k in told else []:
                got[run["at"] : run["at"] + run["count"]] = [run["id"]] * int(run["count"])
            assert got == [low[t[a : a + 50]] for a in range(len(t) - 49)]


# ---- Merkle manifest --------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root, and the list of siblings (before, after) of every leaf."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k - k % 8 : k - k % 8 + 8]
            paths[leaf].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def manifest(rows):
    def leaf(i, t, g, s, n):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, g, n, t)])

    groups = defaultdict(list)
    for i, t, g, s, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if t is not None and hit else t
        groups[g].append(((i is not None, i), leaf(i, t, g, s, n), leaf(i, low, g, s, n)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(groups[g], key=lambda m: (m[0][0], m[0][1] or 0, m[1])) for g in names}
    trees = {g: tree([m[1] for m in members[g]]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (known, i), own, changed, path in [(*m, p) for m, p in zip(members[g], trees[g][1])]:
            node = changed
            for before, after in path + top:
                node = sha(before, node, after)
            out.append((i if known else None, own, trees[g][0], root, sha(*[b + a for b, a in path + top]), node, node == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("levels", [1, 3])
def test_merkle(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows = odd_rows() * 2 + [(100 + k, "T%d" % k, "many", "s", k) for k in range(140)] + [(300, "AbC", "L%d" % k, "s", k) for k in range(20)]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0

    def run(df):
        return merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": merkle.lower_ascii(F.col("text"))}, where=hit)

    assert sorted(map(repr, map(tuple, run(docs_frame(spark, rows)).collect()))) == manifest(rows)
    one = [(1, "x", "en", "s", 1)]
    assert sorted(map(repr, map(tuple, run(docs_frame(spark, one)).collect()))) == manifest(one)
    assert run(docs_frame(spark, rows).limit(0)).count() == 0
