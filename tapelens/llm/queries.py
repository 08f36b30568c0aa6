"""Registered queries of the operators, with DuckDB statements where SQL can say the same."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, log_bilinear, merkle, packing, quality, ranking, repeats, simhash, token_counts, toxicity, urls, warc
from .common import table

URL_RULES = urls.UrlRules(rules=(("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op1_warc_revisits(spark: SparkSession, root: str) -> DataFrame:
    return warc.deduplicate_pages(table(spark, root, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_url_filters(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge_urls(table(spark, root, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.score_documents(table(spark, root, "documents"), table(spark, root, "labels"))


def op5_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, root, "documents"))


def op6_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, root, "documents"), table(spark, root, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op7_packing(spark: SparkSession, root: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, cache_words=1_000_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


def op8_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_log_bilinear(spark: SparkSession, root: str) -> DataFrame:
    return log_bilinear.score_documents(table(spark, root, "documents"))


def op10_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_groups(table(spark, root, "documents"))


def op11_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return ranking.rank_documents(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    clean = repeats.remove_repeats(table(spark, root, "documents"))
    return clean.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return merkle.manifest(table(spark, root, "documents"), LEAF_FIELDS, tampered={"text": merkle.lower_ascii(F.col("text"))}, where=hit)


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_log_bilinear": op9_log_bilinear,
    "op10_simhash": op10_simhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _merkle_sql(levels: int = 9) -> str:
    """Levels unrolled: as many as ``8 ** levels`` leaves a branch need."""

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in fields) + "))"

    def tree(name: str, source: str) -> list[str]:
        parts = [f"{name}0 AS (SELECT g, place, h, count(*) OVER (PARTITION BY g) AS n FROM {source})"]
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT g, place // 8 AS place, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE max(h) END AS h,"
                f" CASE WHEN max(n) > 1 THEN (max(n) + 7) // 8 ELSE 1 END AS n FROM {name}{k} GROUP BY g, place // 8)"
            )
        return parts

    def climb(name: str, node: str, k: int) -> str:
        """Siblings of the node at level k of each row, and the hash of its run with ``node`` in its place."""
        side = f"PARTITION BY g, place // 8 ORDER BY place ROWS BETWEEN"
        return (
            f"SELECT g, place, n, coalesce(string_agg(h, '') OVER ({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,"
            f" coalesce(string_agg(h, '') OVER ({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}"
        )

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = [
        "bytes AS (SELECT DISTINCT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS l FROM documents WHERE doc_id IS NOT NULL)",
        """crcs AS (SELECT doc_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, b:
            list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) AS crc FROM bytes)""",
        f"""docs AS (SELECT doc_id, lang AS g, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS start
            FROM documents LEFT JOIN crcs USING (doc_id))""",
        "leaves AS (SELECT coalesce('=' || g, '') AS g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS h, doc_id, start FROM docs)",
        *tree("l", "leaves"),
        f"roots AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS place, h, g AS name FROM l{levels})",
        *tree("t", "roots"),
        "path0 AS (SELECT g, place AS at, h AS leaf, doc_id, start AS node, '' AS proof FROM leaves)",
    ]
    step = "CASE WHEN s.n > 1 THEN sha256(s.b || p.node || s.a) ELSE p.node END AS node, CASE WHEN s.n > 1 THEN p.proof || s.b || s.a ELSE p.proof END AS proof"
    for k in range(levels):
        parts.append(f"path{k + 1} AS (SELECT p.g, p.at // 8 AS at, p.leaf, p.doc_id, {step} FROM path{k} p JOIN ({climb('l', 'node', k)}) s ON p.g = s.g AND p.at = s.place)")
    parts.append(f"up0 AS (SELECT p.g, r.place AS at, p.leaf, r.h AS subroot, p.doc_id, p.node, p.proof FROM path{levels} p JOIN roots r ON p.g = r.name)")
    for k in range(levels):
        parts.append(f"up{k + 1} AS (SELECT p.g, p.at // 8 AS at, p.leaf, p.subroot, p.doc_id, {step} FROM up{k} p JOIN ({climb('t', 'node', k)}) s ON p.at = s.place)")
    last = f"SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified FROM up{levels}, t{levels}"
    return "WITH " + ",\n".join(parts) + "\n" + last


def _names(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


SQL = {
    "op1_warc_revisits": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS x FROM pages),
        ranked AS (
            SELECT page_id, strlen(p) AS payload_bytes, x, min(page_id) OVER (PARTITION BY p) AS first, row_number() OVER (PARTITION BY p, page_id) AS k FROM payloads
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first AND k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first AND k = 1 THEN NULL ELSE first END AS refers_to
        FROM ranked
    """,
    "op11_ranked_search": """
        WITH low AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS line, text FROM documents
            UNION ALL SELECT 'q', item_id, row_number() OVER (), text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        words AS (
            SELECT kind, id, line, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM low
        ),
        postings AS (SELECT id, line, term, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY ALL),
        lengths AS (SELECT line, sum(tf)::BIGINT AS n FROM postings GROUP BY line),
        corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
        weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus),
        asked AS (SELECT id AS item_id, line AS item, term, count(*) AS n FROM words WHERE kind = 'q' GROUP BY ALL),
        scored AS (
            SELECT item_id, item, id AS doc_id, p.line,
                   sum(a.n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * l.n * docs) // terms))))::BIGINT AS score
            FROM asked a JOIN weights USING (term) JOIN postings p USING (term) JOIN lengths l ON l.line = p.line, corpus
            GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 10
    """,
    "op12_suffix_dedup": """
        WITH docs AS (
            SELECT row_number() OVER () AS line, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
        ),
        grams AS (SELECT line, k, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT line, k, h, unnest(range(length(h) // 2 - 49)) AS p FROM docs)),
        least AS (SELECT s, min(k) AS k FROM grams GROUP BY s),
        hits AS (SELECT g.line, g.p, coalesce(g.p - lag(g.p) OVER (PARTITION BY g.line ORDER BY g.p) > 50, true) AS fresh
            FROM grams g JOIN least USING (s) WHERE least.k < g.k),
        numbered AS (SELECT line, p, sum(fresh::INTEGER) OVER (PARTITION BY line ORDER BY p) AS i FROM hits),
        spans AS (SELECT line, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY line, i),
        pieces AS (SELECT line, a, b, lag(b, 1, 0) OVER (PARTITION BY line ORDER BY a) AS before FROM spans),
        kept AS (
            SELECT line, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
                   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h
            FROM pieces JOIN docs USING (line) GROUP BY line
        )
        SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
        FROM docs d LEFT JOIN kept k USING (line)
    """,
    "op13_merkle_manifest": _merkle_sql(),
    "op5_exact_dedup": """
        WITH hashed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, text_sha256,
               doc_id = min(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept
        FROM hashed WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op3_url_filters": f"""
        WITH cut AS (
            SELECT page_id, lower_ascii, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
            FROM (SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM pages)
        ), parts AS (
            SELECT page_id, lower_ascii,
                   coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut
        ), judged AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
                list_distinct(regexp_split_to_array(lower_ascii, '[^a-z0-9]+')) AS words
            FROM parts
        ), counted AS (
            SELECT *, CAST(coalesce(len(list_intersect(words, {_names(urls.STRICT)})), 0) AS INTEGER) AS strict_hits,
                   CAST(coalesce(len(list_intersect(words, {_names(urls.SOFT)})), 0) AS INTEGER) AS soft_hits
            FROM judged
        )
        SELECT page_id, host, path, rule, strict_hits, soft_hits,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict
        FROM counted
    """,
}
