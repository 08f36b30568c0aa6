"""Operators over the whole corpus against brute force: WARC, dedup, packing, language model, SimHash, pipeline."""
from __future__ import annotations

import array
import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tapelens.llm import components, exact_dedup, log_bilinear, packing, quality, queries, simhash, toxicity, warc
from tapelens.llm.common import scratch, stored

ROOT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, keep_id string, f int"
texts_of = lambda root: dict(duckdb.sql(f"SELECT doc_id, text FROM '{root}/documents.parquet'").fetchall())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOCS).repartition(5)


def test_warc(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{ROOT}/pages.parquet").collect()]
    pages += [(1000 + i, "http://x\r\ny", pages[i % 5][2]) for i in range(40)]
    pages += [(None, None, None), (2000, "u", ""), (2001, "u", None), (None, "u", pages[3][2]), (2000, "u", ""), (3000, "u", "é\r\n\r\nWARC/1.1\r\n" * 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit(1)).repartition(3)
    first: dict = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want, done = [], set()
    for p, _, h in pages:
        h = h or ""
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        response = p == first[h] and h not in done
        done |= {h} if response else set()
        want.append((p, len(h.encode()), digest, "response" if response else "revisit", None if response else first[h]))
    got = warc.deduplicate_pages(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["verified"] for r in got if r["record_type"] == "response")
    assert {r["record_type"] for r in warc.deduplicate_pages(df, min_bytes=1 << 30).collect()} == {"response"}
    assert warc.deduplicate_pages(df.limit(0)).count() == 0


def test_warc_payloads_round_trip(spark):
    folder = scratch(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "aé"), (2, "v", "aé"), (3, "w", "b" * 3_000_000)], "page_id long, url string, html string")
    manifest = warc.rewrite(warc.resolve(warc.write_archives(df, folder), folder), folder)
    got = {r["page_id"]: r for r in warc.read_archives(manifest, payloads=True).collect()}
    assert bytes(got[1]["payload"]) == "aé".encode() and got[2]["payload"] is None and bytes(got[3]["payload"]) == b"b" * 3_000_000
    assert got[2]["refers_to_id"] == got[1]["record_id"]


ROWS = [(5, "a b"), (3, "a  b"), (9, "a\tb\n"), (9, "a\x0b b "), (None, "a b"), (None, None), (None, ""), (4, "x"), (4, "x"), (4, "y"), (None, "z"), (8, "w" * 100_000)]


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(spark, fan_in):
    rows = ROWS + [(100 + i, f"t{i % 50}") for i in range(400)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = []
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            kept = d == keep and left == 1
            left -= kept
            want.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    df = frame(spark, rows)
    got = exact_dedup.exact_groups(df, fan_in=fan_in).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in kept.collect()), key=repr) == sorted(
        ((min((d for d in ids if d is not None), default=None), t) for t, ids in groups.items()), key=repr
    )


def test_surviving_row_does_not_depend_on_partitions(spark):
    rows = [(i % 4 if i % 4 else None, "same text", f"l{(i * 7) % 20:02d}", None, i, {"k": str(i)}) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, f int, m map<string,string>")
    for drop in (exact_dedup.drop_copies, simhash.drop_near_copies):
        for cols in (["doc_id", "text", "lang", "keep_id", "f"], df.columns):
            got = {tuple(map(str, r)) for n in (1, 2, 3, 7, 16) for r in drop(df.select(cols).orderBy(F.xxhash64("f", F.lit(n))).repartition(n)).collect()}
            assert len(got) == 1
            assert next(iter(got))[:3] == ("1", "same text", min(r[2] for r in rows if r[0] == 1))


@pytest.mark.parametrize("planned", [1, 2, 7])
def test_exact_dedup_when_the_scan_has_more_tasks_than_planned(spark, planned):
    rows = exact_dedup.digests(frame(spark, [(i, f"t{i % 20}") for i in range(200)])).repartition(24)

    class Planned:
        class rdd:
            getNumPartitions = staticmethod(lambda: planned)

        mapInArrow = staticmethod(rows.mapInArrow)

    got = exact_dedup.tree_merge(Planned, fan_in=2).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == [(i, 10) for i in range(20)]


def test_merge_verifies_lengths():
    run = np.zeros(2, exact_dedup.ENTRY)
    run["digest"], run["size"] = b"x" * 32, [1, 2]
    with pytest.raises(ValueError):
        exact_dedup.merge(run)


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """(id, fingerprint) -> smallest non-null id of the component, per fingerprint."""
    f = sorted({x for _, x in pairs})
    root = {x: x for x in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = np.array(f, np.uint64)
    for k, x in enumerate(f):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= 2):
            root[find(f[j])] = find(x)
    least: dict = {}
    for d, x in pairs:
        r = find(x)
        least[r] = min((y for y in (least.get(r), d) if y is not None), default=None)
    return {x: least[find(x)] for x in f}


@pytest.mark.parametrize("bucket", [0, 3, 64])
def test_links_connect_all_that_are_near(spark, bucket):
    rng = random.Random(bucket)
    fs = {0, (1 << 64) - 1}
    for _ in range(25):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8, 40])):
            c2 = c
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 6])):
                c2 ^= 1 << b
            fs.add(c2)
            if rng.random() < 0.4:
                c = c2
    fs = sorted(fs)
    folder = scratch(spark, "links")
    df = stored(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fs], "f long").repartition(4), folder, "distinct")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.components(simhash.links(df, folder, bucket), folder).collect()}
    want = brute_components([(x, x) for x in fs])
    assert Counter(Counter(want.values()).values()) == Counter(Counter([roots.get(x, x) for x in fs]).values())
    by_root = defaultdict(set)
    for x in fs:
        by_root[roots.get(x, x)].add(want[x])
    assert all(len(v) == 1 for v in by_root.values())


def test_simhash_rows(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(400)]
    rows = [(None, None), (7, ""), (None, "one two"), (6, "One  two"), (6, "one two"), (30, " ".join(base) * 200)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(400)] = "zz"
        rows.append((100 + i, " ".join(w)))
    rows += [(500, " ".join(base)), (500, " ".join(base).upper())]
    pairs = [(d, brute_fingerprint(t)) for d, t in rows]
    names = brute_components(pairs)
    df = frame(spark, rows)
    got = simhash.near_groups(df, bucket=4).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d, f"{x:016x}", names[x]) for d, x in pairs), key=repr)
    assert len(set(names.values())) < len(names)
    assert simhash.near_groups(df.limit(0)).count() == 0
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(set(names.values()), key=repr)


def test_simhash_query(spark):
    pairs = [(d, brute_fingerprint(t)) for d, t in texts_of(ROOT).items()]
    names = brute_components(pairs)
    assert sorted(map(tuple, queries.op10_simhash(spark, ROOT).collect())) == sorted((d, f"{x:016x}", names[x]) for d, x in pairs)


def check_packing(pieces, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(array.array("I", ids[d][at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for rs in by_sequence.values():
        rs = sorted(rs, key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:k]) for k in range(len(rs))]
        n = sum(r["length"] for r in rs)
        assert n <= 4096 and n & (n - 1) == 0 and {r["sequence_tokens"] for r in rs} == {n}


def test_packing(spark):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    words = ["Alpha", "beta,", "ÉTÉ", "x1y22", "it's", "<|endoftext|>", "<|ENDOFTEXT|>", "Σας", "áb", " ", "\x1c", "##"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "word " * 9000)] + [(4 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1500)))) for i in range(60)]
    ids = {d: model.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    df = frame(spark, rows)
    pack = lambda x: packing.pack_documents(x, P.path("word_bpe_49k.json"), end_id=2).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(pack(df).collect(), ids)
    doubled = pack(df.union(df)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] == 2 * len(ids[r["doc_id"]]) for r in doubled)
    nulls = pack(df.withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("length")).first()[0]
    assert nulls == sum(map(len, ids.values())) and pack(df.limit(0)).count() == 0


def test_packing_query(spark):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: model.encode(t, add_special_tokens=False).ids + [2] for d, t in texts_of(ROOT).items()}
    check_packing(queries.op7_packing(spark, ROOT).collect(), ids)


def base_scores(rows):
    counts = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(log_bilinear.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = log_bilinear.tokens((t or "").encode())
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        out.append((d, held, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


def close(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_language_model_query(spark):
    rows = list(texts_of(ROOT).items())
    got = queries.op9_log_bilinear(spark, ROOT).collect()
    close([tuple(r)[:6] for r in got], base_scores(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_edges(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "FREQUENT", 3)  # most words go through the join
    rng = random.Random(4)
    rows = [(None, "A b"), (None, None), (7, ""), (8, "c " * 12_000), (8, "é É c"), (8, "é É c")] + [(20 + i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(40)]
    df = frame(spark, rows)
    got = log_bilinear.score_documents(df).collect()
    close([tuple(r)[:6] for r in got], base_scores(rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert log_bilinear.score_documents(df.limit(0)).count() == 0


def test_language_model_is_normalised(spark):
    model, counts = log_bilinear.learn(frame(spark, [(i, "a b c a b d e" + " xa yb" * i) for i in range(30)]), scratch(spark, "lbl"))
    n = len(model.parameters.b)
    for h1, h2 in ((0, 1), (2, 2), (n - 1, 0)):
        p = np.exp(model.log_probability(np.full(n, h1), np.full(n, h2), np.arange(n)))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_language_model_words_grow_with_the_corpus(spark):
    rows = [(i, " ".join(f"w{k}e" for k in range(i % 2, 3000, 2))) for i in range(100)]
    model, _ = log_bilinear.learn(frame(spark, rows), scratch(spark, "lbl"))
    own = {w: int(model.units[i]) for i, w in enumerate(model.words) if model.units[i] < model.classes}
    assert len(own) == len(set(own.values())) == 3001  # all words and the end, whatever their rank
    p, start = model.parameters, log_bilinear.Parameters.start(np.full(len(model.parameters.b), 1 / len(model.parameters.b)), log_bilinear.DIMENSIONS)
    k = own[b"w2999e"]
    assert (p.r[k] != start.r[k]).all() and (p.q[0][k, :-1] != start.q[0][k, :-1]).all()
    n = len(p.b)
    for h in (own[b"w2997e"], n - 1):
        p = np.exp(model.log_probability(np.full(n, h), np.full(n, k), np.arange(n)))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_model_sends_its_parameters_once_a_trainer(spark, monkeypatch):
    cores, averaged = spark.sparkContext.defaultParallelism, log_bilinear.averaged

    def counted(parts):
        if len(parts) > cores:
            raise AssertionError(f"{len(parts)} copies of a block of parameters")
        return averaged(parts)

    monkeypatch.setattr(log_bilinear, "averaged", counted)
    rows = [(i, "a b c a b d e " * 5) for i in range(40 * cores)]
    model, _ = log_bilinear.learn(frame(spark, rows).repartition(5 * cores), scratch(spark, "lbl"))
    assert model.n_tokens == sum(len(t.split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    few, many = (log_bilinear.trainers(n, 1000, 6) for n in (10**5, 10**8))
    assert few == 6 and many % 6 == 0 and many * 1000 * log_bilinear.SHARE <= 10**8


def test_language_model_words(monkeypatch):
    monkeypatch.setattr(log_bilinear, "SLICE", 12)
    texts = [b"", b" ", b"A b", b" a\x0b\x0cB\r\n", "É\x85é\u2003z \xa0 Q".encode(), b"\x1c\x1f\xff \xfe", b"long " * 9, b"A b"] + [bytes([65, k, 66]) for k in range(256)]
    batch = pa.array([b"cut", *texts, b"off"], pa.binary())[1:-1]
    got = []
    for lo, starts, codes, names in log_bilinear.coded(batch):
        assert lo == len(got)
        got += [[names[k] for k in part] for part in np.split(codes, starts[1:])]
    assert got == [log_bilinear.tokens(t) for t in texts]
    assert list(log_bilinear.coded(batch[:0])) == []


def test_language_model_score_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "RARE", 7)
    monkeypatch.setattr(log_bilinear, "SLICE", 500)
    rng = random.Random(9)
    rows = [(None, None), (3, "b zz1 b"), (3, "b zz1 b")] + [(i, " ".join(rng.choices("abcdefgh", k=40)) + f" r{i}x zz{i} é{i % 9}" * (i % 12)) for i in range(10, 90)]
    df = frame(spark, rows).localCheckpoint()
    model, counts = log_bilinear.learn(df, scratch(spark, "lbl"))
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    p, units = model.parameters, {w: int(u) for w, u in zip(model.words, model.units)}

    def score(words):
        total, before = 0.0, [model.end, model.end]
        for word in words:
            u = units.get(word, model.classes + log_bilinear.ending(word))
            x = np.append(np.concatenate([p.r[before[-1]], p.r[before[-2]]]).astype(float) @ p.c, 1)
            for level, q in enumerate(p.q):
                at = u // p.k**level
                s = q[at // p.k * p.k : (at // p.k + 1) * p.k].astype(float) @ x
                total += s[at % p.k] - math.log(np.exp(s).sum())
            if u >= model.classes:
                total += math.log((c.get(word, 0) + 1) / (model.rest[u - model.classes].sum() + 1))
            before.append(u)
        return total / math.log(10)

    want = sorted((repr(d), score(log_bilinear.tokens((t or "").encode()))) for d, t in rows)
    got = sorted((repr(r["doc_id"]), r["score"]) for r in log_bilinear.score_documents(df).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5)


def test_pipeline_by_brute_force(spark):
    docs, labels = queries.table(spark, ROOT, "documents"), queries.table(spark, ROOT, "labels")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).collect()}
    clean = docs.where(F.col("doc_id").isin([d for d, p in scores.items() if not p]))
    good = {r["doc_id"] for r in quality.judge_quality(clean, labels).where("kept").collect()}
    texts = {d: t for d, t in texts_of(ROOT).items() if d in good}
    first: dict = {}
    for d, t in sorted(texts.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    pairs = [(d, brute_fingerprint(texts[d])) for d in first.values()]
    names = brute_components(pairs)
    left = {d for d, x in pairs if names[x] == d}
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: model.encode(texts[d], add_special_tokens=False).ids + [2] for d in left}
    check_packing(corpus_pipeline.run(spark, ROOT).collect(), ids)
    assert 0 < len(left) < docs.count() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_the_columns(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "you stupid idiot moron scum", "en", None, 5), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = scratch(spark, "pipeline-test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stored(stage(spark, docs, ROOT), folder, str(k))
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    assert [r["doc_id"] for r in docs.collect()] == [3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), ROOT).count() == 0
