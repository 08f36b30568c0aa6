"""URL filter: host and path rules first, then a weighted vocabulary of strict and soft terms.

One Aho-Corasick pass per url finds all terms. A hit counts only between boundaries (no ASCII
letter or digit beside it). One strict term rejects; soft terms reject from ``min_soft``
different ones on. A rule that fits (longest first) overrides the vocabulary.

Null urls and urls without ``://`` have an empty host and path and fit no rule; the vocabulary
still judges the whole string, null is allowed. Repeated rows give repeated results, an empty
table an empty one; only the two named columns are read, so other columns never clash.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary. Terms are ASCII letters and digits, lower case.
STRICT = ("adult", "camgirls", "casino", "escorts", "hentai", "malware", "phishing", "porn", "porno", "sexcam", "slots", "spam", "viagra", "xxx")
SOFT = (
    "bet", "bets", "betting", "bonus", "cheap", "cialis", "crack", "dating", "deal", "deals", "diet", "discount", "free", "gamble",
    "jackpot", "keygen", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pills", "poker", "replica", "sex", "torrent",
    "warez", "weightloss", "win", "winner",
)
ALPHANUMERIC = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
LOWER = {i: i + 32 for i in range(65, 91)}
END_OF_HOST, END_OF_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")


@dataclass(frozen=True)
class UrlRules:
    """``rules``: (action, host/path) pairs; ``strict`` and ``soft``: the terms."""

    rules: tuple[tuple[str, str], ...] = ()
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    min_soft: int = 2


@lru_cache(maxsize=8)
def automaton(strict: tuple, soft: tuple):
    out = ahocorasick.Automaton()
    for term in soft:
        out.add_word(term, (term, False))
    for term in strict:
        out.add_word(term, (term, True))
    out.make_automaton()
    return out


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    m = END_OF_HOST.search(rest)
    cut = m.start() if m else len(rest)
    tail = rest[cut:]
    m = END_OF_PATH.search(tail)
    return rest[:cut].translate(LOWER), tail[: m.start() if m else len(tail)]


@lru_cache(maxsize=8)
def rules_by_host(rules: tuple) -> dict[str, list[tuple[str, str, str]]]:
    """Host -> (path, rule, action), longest path first; of equal rules a block comes first."""
    out: dict[str, list] = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host.translate(LOWER), []).append((slash + path, rule, action))
    for host in out:
        out[host].sort(key=lambda x: (-len(x[0]), x[2] != "block"))
    return out


def find_rule(host: str, path: str, by_host: dict) -> tuple[str, str] | None:
    """The longest rule (host and path together) that fits the host or a parent of it."""
    best: tuple[int, str, str] | None = None
    while host:
        for prefix, rule, action in by_host.get(host, ()):
            if path.startswith(prefix):
                if best is None or len(rule) > best[0]:
                    best = (len(rule), rule, action)
                break
        host = host.partition(".")[2]
    return best and best[1:]


def hits(url: str, strict: tuple, soft: tuple) -> tuple[set, set]:
    """Different strict and soft terms that stand between boundaries."""
    low = url.translate(LOWER)
    found: tuple[set, set] = (set(), set())
    for end, (term, hard) in automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1] in ALPHANUMERIC) or (end + 1 < len(low) and low[end + 1] in ALPHANUMERIC):
            continue
        found[0 if hard else 1].add(term)
    return found


def judge_urls(pages: DataFrame, rules: UrlRules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, strict_hits, soft_hits."""

    @F.pandas_udf("host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
    def judge(urls: pd.Series) -> pd.DataFrame:
        by_host, rows = rules_by_host(rules.rules), []
        for url in urls:
            host, path = parse(url)
            hard, soft = hits(url, rules.strict, rules.soft) if url else (set(), set())
            fit = find_rule(host, path, by_host)
            own = "block" if hard or len(soft) >= rules.min_soft else "allow"
            rows.append((host, path, fit[0] if fit else None, fit[1] if fit else own, len(hard), len(soft)))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    picked = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    return picked.withColumn("judged", judge("url")).select(id_col, "judged.*")
