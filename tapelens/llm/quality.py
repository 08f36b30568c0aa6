"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over ``BUCKETS`` hash buckets of n-grams of word endings (the last three characters
of a word, and the last two of a word and of the next; endings are few, so that also words that no
trusted document has are judged): one of the whole raw corpus, one of trusted documents (labelled good; at most ``TRUSTED_DOCS`` of them, chosen by
hashes of their ids, so that the set of ids has a fixed bound). Counts are summed before
the shuffle, so at most ``BUCKETS`` rows leave a task and as many reach the driver. A document's
ratio is the mean over its n-grams of log(p_trusted / p_raw); a document below ``THRESHOLD`` goes.
The weights travel as one literal array; scoring is a projection without a shuffle, and everything
a document needs is computed inside its row, so groups and sources never meet in a task.

Null texts have no words: all counts are 0, ``base_failed`` is true and ``ratio`` null. Rows with
null ids are scored as any other; repeated rows give repeated results; an empty table an empty
one. Without trusted documents all weights are 0 and only the rules judge. Very long texts are
handled whole: all steps in a row are linear or n log n. Input names never clash, for only the
named columns are read.
"""
from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, at_most, fresh, quoted

BUCKETS, SMOOTHING, THRESHOLD, TRUSTED_DOCS = 16_384, 50.0, -0.15, 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[^#*$%&|<>]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in several places, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array ``w``.

    Windows are hashed to 64 bits; only where some hash repeats are they sorted with their places.
    A place that repeats covers three words, less what the repeat before it has covered.
    """

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.filter(s, lambda x, k: _same(s, x, k - 1) | _same(s, x, k + 1)))

    def _same(s: Column, x: Column, k: Column) -> Column:
        return (k >= 0) & (k < F.size(s)) & (F.get(s, k)["h"] == x["h"])

    def covered(p: Column) -> Column:
        after = F.transform(p, lambda i, k: F.when(k + 1 < F.size(p), F.least(F.lit(3), F.get(p, k + 1) - i)).otherwise(3))
        return F.aggregate(after, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)))
    counted = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.array_sort(F.transform(places(h), lambda x: x["i"])), covered)),
    )
    return F.when(F.size(w) < 4, 0).otherwise(counted).cast("long")


def buckets(w: Column) -> Column:
    """Hash buckets of the n-grams of word endings of ``w``: unigrams, then bigrams."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(F.right(x, F.lit(3))), F.lit(BUCKETS)).cast("int"))
    two = let(
        F.transform(w, lambda x: F.right(x, F.lit(2))),
        lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.pmod(F.xxhash64(F.get(e, i), F.lit(" "), F.get(e, i + 1)), F.lit(BUCKETS)).cast("int")),
    )
    return F.when(F.size(w) < 2, one).otherwise(F.concat(one, two))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """Ids of at most ``most`` documents labelled good."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return at_most(good, F.col("trusted_id"), most)


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRUSTED_DOCS) -> list[float]:
    """log(p_trusted / p_raw) of every bucket, from counts over all documents."""
    ids = F.broadcast(trusted_ids(labels, most))  # at most ``most`` longs
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("trusted_id"), "left")
    grams = marked.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode(let(words(F.col("text")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted")).collect()
    raw, trusted = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["bucket"]], trusted[r["bucket"]] = r["raw"], r["trusted"]
    n_raw, n_trusted = sum(raw), sum(trusted)
    if not n_trusted:
        return [0.0] * BUCKETS
    # Both sides are smoothed with the same prior mass, so a bucket that neither has seen weighs nothing.
    share = n_trusted / n_raw
    return [math.log((t + SMOOTHING) / (n_trusted + SMOOTHING * BUCKETS)) - math.log((r * share + SMOOTHING) / (n_raw * share + SMOOTHING * BUCKETS)) for t, r in zip(trusted, raw)]


def measures(docs: DataFrame, table: list[float], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed, kept
    (names start with ``prefix``). ``kept``: passes the rules and ratio >= THRESHOLD."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    weight = F.from_json(F.lit(json.dumps([round(x, 9) for x in table])), "array<double>")

    def read(w: Column) -> Column:
        n = F.size(w)
        grams = 2 * n - 1
        total = F.aggregate(buckets(w), F.lit(0.0), lambda a, b: a + F.get(weight, b))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated(w).alias("n_repeat_words"),
            F.when(n > 0, total / grams).alias("ratio"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = docs.withColumn(f"{prefix}read", let(words(text), read))
    at = lambda name: F.col(f"{prefix}read")[name]
    failed = (at("n_words") < MIN_WORDS) | (100 * at("n_repeat_words") > MAX_REPEAT_PERCENT * at("n_words"))
    return out.withColumns(
        {
            f"{prefix}n_words": at("n_words"),
            f"{prefix}word_chars": at("word_chars"),
            f"{prefix}n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
            f"{prefix}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            f"{prefix}n_repeat_words": at("n_repeat_words"),
            f"{prefix}ratio": at("ratio"),
            f"{prefix}base_failed": failed,
            f"{prefix}kept": ~failed & (at("ratio") >= THRESHOLD),
        }
    ).drop(f"{prefix}read")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the measures, base_failed, ratio, kept."""
    table = weights(docs, labels, id_col, text_col)
    return measures(docs.select(F.col(id_col), F.col(text_col)), table, text_col).drop(text_col)


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the rules or the ratio reject, all columns kept."""
    prefix = fresh("quality", [c[:7] for c in docs.columns]) + "_"
    judged = measures(docs, weights(docs, labels, id_col, text_col), text_col, prefix)
    return judged.where(F.col(f"{prefix}kept")).select(*[F.col(quoted(c)) for c in docs.columns])
