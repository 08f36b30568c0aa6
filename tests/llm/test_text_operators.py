"""Row-wise operators against libraries and brute force: urls, BPE, token counts, quality, toxicity."""
from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapelens.llm import bpe, quality, queries, token_counts, toxicity, urls
from tapelens.llm.common import Cache, scratch

ROOT = "/root/testdata/sf0.001"
LETTERS = "ab '  \n\t.,1é 　 ß😀<|endoftext|>st\x1c\x0b"
DOCS = "doc_id long, text string, lang string, score double, n_words int"


def odd_texts(n: int = 60) -> list[str | None]:
    rng = random.Random(5)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [None, "", " ", "\n\n", "a" * 5000, "word " * 30_000, "no_space-" * 2000, "<|endoftext|> x <|endoftext|>", *made]


def frame(spark, texts):
    rows = [(i if i % 7 else None, t, "en", 0.5, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], DOCS)


def duck(name: str):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    return [c[0] for c in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    names, rows = duck(name)
    got = queries.QUERIES[name](spark, ROOT).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def test_url_cases(spark):
    given = [
        (1, "http://a.example.net/en/x"), (2, "http://EXAMPLE.com/de/"), (3, "http://www.example.com?x/de/"), (4, "http://b.org/fr/a#b"),
        (5, None), (6, ""), (7, "casino.example.com/x"), (8, "https://x.com/free-bets"), (9, "https://x.com/freebets/winner1"), (10, "http://net/"),
        (11, "http://xnet/"), (12, "https://x.com/free/free"), (13, "http://a.net"), (13, "http://a.net"),
    ]
    df = spark.createDataFrame(given, "page_id long, url string").withColumn("host", F.lit("other")).withColumn("verdict", F.lit(1))
    got = urls.judge_urls(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [
            (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.com", "/de/", "example.com/de/", "block"),
            (3, "www.example.com", "", None, "allow"), (4, "b.org", "/fr/a", "org/fr/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
            (7, "", "", None, "block"), (8, "x.com", "/free-bets", None, "block"), (9, "x.com", "/freebets/winner1", None, "allow"),
            (10, "net", "/", "net/", "block"), (11, "xnet", "/", None, "allow"), (12, "x.com", "/free/free", None, "allow"),
            (13, "a.net", "", None, "allow"), (13, "a.net", "", None, "allow"),
        ], key=repr,
    )
    assert urls.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_cache_generations():
    made = []
    cache = Cache(lambda keys: [made.append(k) or len(k) for k in keys], most=8)
    rng = random.Random(0)
    for _ in range(300):
        keys = ["x" * rng.choice([1, 2, 3, 4, 5, 6, 7, 300]) + str(rng.randrange(4)) for _ in range(rng.randrange(1, 6))]
        known = cache.prepare(k for k in keys)  # a generator is read once
        assert all(known[k] == len(k) for k in keys)
        assert len(cache.young) <= 10
    assert cache.prepare([]) is cache.young


def test_words_equal_the_library_past_the_cache(monkeypatch):
    import array

    from tapelens.llm import packing

    monkeypatch.setattr(packing, "CACHE_SIZE", 20)
    words, library = packing.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choice("abé,.!*'s ×÷ÿ́Σ\x1c1<|endoftext|>\n") for _ in range(rng.randrange(30)))
        assert words.ids(text.encode()) == array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def test_bpe_is_the_library(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    texts = odd_texts()
    df = bpe.encode_documents(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True)
    want = [(i if i % 7 else None, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts)]
    got = [(r[0], tuple(r[1]), bytes(r[2])) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want + want[:3], key=repr)
    assert bpe.encode_documents(frame(spark, texts).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_blocks_of_a_long_piece():
    pairs = bpe.BytePairs(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks(), special_tokens={})
    rng = random.Random(3)
    for text in ("-" * 20_000 + "abcab" * 3000, "".join(rng.choice("etaoin shrd") for _ in range(30_000))):
        assert pairs.encode_piece(text.encode()) == library.encode_ordinary(text)


def test_bpe_query(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{ROOT}/documents.parquet'").fetchall())
    for r in queries.op2_byte_bpe(spark, ROOT).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_counts_are_the_library(spark):
    model, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), odd_texts()
    got = token_counts.count_tokens(frame(spark, texts), P.path("byte_bpe_50k.json"), table_size=5, sample_docs=3).collect()
    want = []
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i % 7 else None, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, got), key=repr) == sorted(want + want[:3], key=repr)
    assert token_counts.count_tokens(frame(spark, texts).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_frequent_pieces_are_those_of_all_documents(spark):
    texts = ["a b c"] * 2_100 + ["z" * 1_000] + [" ".join(["w"] * 1_100 + ["late"] * 5_000)] * 3
    got = token_counts.frequent_pieces(frame(spark, texts).coalesce(1), P.path("byte_bpe_50k.json"), table_size=2)
    assert set(got) == {" late", " w"}  # behind the first 2,000 texts and 1,000 words
    counts = {r["piece"]: r["c"] for r in token_counts.piece_counts(frame(spark, texts)).collect()}
    assert counts[" late"] >= 15_000 and "z" * 1_000 not in counts


def test_piece_counts_over_many_tasks(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(200)) for _ in range(300)] + [None, ""]
    df = frame(spark, texts).repartition(40)
    want = Counter(p for r in df.collect() if r["text"] is not None for p in token_counts.pieces(r["text"]))
    assert {r["piece"]: r["c"] for r in token_counts.piece_counts(df, size=100_000).collect()} == dict(want)
    monkeypatch.setattr(token_counts, "HELD", 200)
    got = token_counts.piece_counts(df, size=20)
    assert got.count() == 20 and {p for p, _ in want.most_common(8)} <= {r["piece"] for r in got.collect()}


def test_pruned_counters():
    assert token_counts.pruned(Counter(a=9, b=7, c=3, d=1), 2) == Counter(a=6, b=4)
    assert token_counts.pruned(Counter(a=2, b=2, c=2), 2) == Counter()
    assert token_counts.pruned(Counter(a=2), 2) == Counter(a=2)


def test_token_count_query(spark):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{ROOT}/documents.parquet'").fetchall())
    for r in queries.op8_token_counts(spark, ROOT).collect():
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def rules(text: str | None) -> tuple:
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    windows = list(zip(w, w[1:], w[2:]))
    n, covered = Counter(windows), set()
    for i, g in enumerate(windows):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_base_counts(spark):
    texts = [*odd_texts(), "a b c a b c d", "a a a a", "x\ny\nx\n\n \nx", "p q r s\n" * 40, "# $ | a"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(frame(spark, texts), labels)
    rows = got.select(*BASE, "kept").collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter([rules(t) for t in texts + texts[:3]])
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # without trusted documents only the rules judge
    assert quality.judge_quality(frame(spark, texts).limit(0), labels).count() == 0


def test_quality_ratio_by_brute_force(spark):
    import math

    import xxhash

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{ROOT}/documents.parquet'").fetchall())
    good = {d for d, q in duckdb.sql(f"SELECT doc_id, quality FROM '{ROOT}/labels.parquet'").fetchall() if q == 1}

    def grams(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        keys = [(a[-3:],) for a in w] + [(a[-2:], " ", b[-2:]) for a, b in zip(w, w[1:])]
        out = []
        for parts in keys:
            h = 42
            for part in parts:
                h = xxhash.xxh64_intdigest(part.encode(), h)
            out.append((h - (1 << 64) if h >> 63 else h) % quality.BUCKETS)
        return out

    by = {d: grams(x) for d, x in texts.items()}
    raw = Counter(g for v in by.values() for g in v)
    trusted = Counter(g for d, v in by.items() if d in good for g in v)
    n, t, k = sum(raw.values()), sum(trusted.values()), quality.SMOOTHING
    weight = {g: math.log((trusted[g] + k) / (t + k * quality.BUCKETS)) - math.log((raw[g] * t / n + k) / (t + k * quality.BUCKETS)) for g in raw}
    for r in queries.op6_quality_rules(spark, ROOT).collect():
        assert tuple(r[c] for c in BASE) == rules(texts[r["doc_id"]])
        want = sum(weight[g] for g in by[r["doc_id"]]) / len(by[r["doc_id"]])
        assert r["ratio"] == pytest.approx(want, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and want >= quality.THRESHOLD)


def test_clauses():
    read = lambda s: "".join(o for o, _ in toxicity.read_clause(list(s)))
    assert read("oIo") == "oIo" and read("YooI") == "YooD" and read("IoY") == "DoY"
    assert read("NooI") == "Noon" and read("NoooI") == "NoooI" and read("RoooooI") == "Rooooor"
    assert read("YTo") == "YMo" and read("YNoI") == "YNon"
    assert toxicity.read_clause(list("YI"))[1][1] > toxicity.read_clause(list("oI"))[1][1] > toxicity.read_clause(list("NI"))[1][1]


def test_threats_without_a_target_nearby():
    read = lambda s: "".join(o for o, _ in toxicity.read_clause(list(s)))
    assert read("TooooY") == "MooooY" and read("IooooY") == "IooooY" and read("NTo") == "Nno"
    features = lambda text, **counts: toxicity.text_features(text, toxicity.Lexicon(counts, 100, 900), {})
    assert features("kill every last one of you")[1] > 0
    assert features("we will murder all those people", murder=(20, 2))[0] > 0
    assert not any(features("beat all those eggs", beat=(2, 60)))  # labels decide


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, root, "documents"), queries.table(spark, root, "labels")
    rows = toxicity.score_documents(docs, labels).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{root}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in held]) > 0.9
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_documents(docs, flipped).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in again) == sorted((r["doc_id"], r["predicted"]) for r in rows)


def test_toxicity_recall(spark):
    """Held-out rows of the larger table; accuracy alone has the clean share as its floor."""
    root = "/root/testdata/sf0.1"
    rows = toxicity.score_documents(queries.table(spark, root, "documents"), queries.table(spark, root, "labels")).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{root}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_toxicity_labels_of_equal_texts(spark):
    texts = ["you are a stupid idiot"] * 30 + ["nice day today"] * 30 + [f"plain words {k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0 and i < 30)) for i in range(100)], "doc_id long, quality int, toxic int")
    answers = set()
    for n in (1, 2, 3, 7, 16):
        rows = toxicity.score_documents(docs.orderBy(F.xxhash64("doc_id", F.lit(n))).repartition(n), labels).collect()
        answers.add(tuple(sorted((r["doc_id"], r["score"]) for r in rows)))
        train = toxicity.training_rows(docs.repartition(n), labels, scratch(spark, "t"), "doc_id", "text", 1000)
        assert {r["text"]: r["toxic"] for r in train.where("text like 'you%' or text like 'nice%'").collect()} == {texts[0]: 1, "nice day today": 0}
    assert len(answers) == 1


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, [None, "", "you are a stupid worthless idiot, you moron", "a fine day", "x " * 50_000])
    got = toxicity.score_documents(df, labels).collect()
    assert len(got) == 8 and sum(r["predicted"] for r in got) == 2
    assert toxicity.score_documents(df.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 6
