"""Toxicity scores from a weighted finite-state pattern grammar over clauses.

A clause is read as symbols: insult, threat, target, negation, reporting verb, other. Three
transducers rewrite them and are composed into one machine: negation turns insults in its scope
into negated ones, reported speech marks insults and threats up to the clause's end, and a target
nearby turns an insult or threat into a directed one (the same machine also reads the clause from
the right, for targets that follow; a threat's target may stand further off). Every rewritten symbol carries the product of the weights of
the arcs it took, so what is scored are matched clauses: a bare insult or threat counts by its
learned weight, a directed one more, a negated or reported one apart. A logistic regression of the clause sums gives the score.

The insult transducer's lexicon is a fixed list plus words and stems learned from labels. At most
``MAX_LABELLED`` labelled rows are used (chosen by hashes of their ids, one per
text); words and stems are counted over them in Spark, and at most ``MAX_LEXICON`` entries with a
positive lower bound of their log-odds come to the driver. Rows whose ids are held out are never
used. Only the text enters a score.

Null texts count as empty and get the score of a text without a matched clause. Null ids are
scored, but never learned from. Repeated rows give repeated results, an empty table an empty one.
Long texts are read clause by clause. Only the named columns are read.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, fresh, scratch, stored

MAX_LABELLED, MAX_LEXICON, MIN_SUPPORT, MIN_WEIGHT, PRIOR = 20_000, 5_000, 4, 1.0, 3.0
STEM_FROM, STEM_TO, CACHE = 4, 8, 100_000

# The starting vocabulary of each symbol.
INSULTS = (
    "arsehole asshole bastard bimbo bitch bonehead clown coward cretin degenerate dickhead dimwit dirtbag disgusting dolt douchebag dumb dumbass "
    "dunce fool freak garbage halfwit idiot idiotic imbecile jackass jerk lame loser lowlife lunatic maggot moron moronic numbskull nutjob parasite "
    "pathetic pig prick psycho retard scum scumbag simpleton slut snowflake stupid subhuman swine thug trash twat twit vermin weirdo whore worthless wretch"
).split()
THREATS = "beat burn choke crush destroy hang hurt kill murder punch shoot slap smash stab strangle".split()
TARGETS = "you your yours yourself u ur he she they them him her his their ye du dich ihr sie tu toi vous te usted ustedes tú".split()
NEGATIONS = "not no never none isn't aren't wasn't don't nicht kein keine nie pas jamais ni nunca".split()
REPORTS = "said says say saying told called calls wrote writes quoted quotes claimed claims alleged reported according sagte dit dijo".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITYNRo"
CLAUSE, WORD = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
FEATURES = ("plain", "directed", "aside", "largest", "share", "clauses")


@dataclass(frozen=True)
class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, output, weight).

    A symbol without an arc is copied with weight one and the state moves to ``falls[state]``.
    """

    arcs: dict
    falls: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.falls.get(state, state), symbol, 1.0)

    def then(self, other: Transducer, symbols: str) -> Transducer:
        """Composition: what this one writes, ``other`` reads. States are pairs."""
        arcs, todo, seen = {}, [(0, 0)], {(0, 0)}
        while todo:
            a, b = todo.pop()
            for s in symbols:
                a2, middle, w1 = self.step(a, s)
                b2, out, w2 = other.step(b, middle)
                arcs[((a, b), s)] = ((a2, b2), out, w1 * w2)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer({(self._flat(p), s): (self._flat(q), o, w) for (p, s), (q, o, w) in arcs.items()}, {})

    @staticmethod
    def _flat(pair):
        return 0 if pair == (0, 0) else pair


def scope(opener: str, length: int, rewrites: dict) -> Transducer:
    """After ``opener`` the next ``length`` symbols are rewritten: symbol -> (output, weight)."""
    arcs = {(s, opener): (length, opener, 1.0) for s in range(length + 1)}
    for s in range(1, length + 1):
        arcs |= {(s, i): (s - 1, out, w) for i, (out, w) in rewrites.items()}
    return Transducer(arcs, {s: s - 1 for s in range(1, length + 1)})


def to_end(opener: str, rewrites: dict) -> Transducer:
    """After ``opener`` all symbols up to the clause's end are rewritten."""
    return Transducer({(s, opener): (1, opener, 1.0) for s in (0, 1)} | {(1, i): (1, out, w) for i, (out, w) in rewrites.items()}, {})


NEGATED, REPORTED, DIRECTED, MENACE = "nrDM"
SYMBOLS = "ITYNRonrDM"
LEFT = (
    scope(NEGATION, 3, {INSULT: (NEGATED, 0.25), THREAT: (NEGATED, 0.25)})
    .then(to_end(REPORT, {INSULT: (REPORTED, 0.4), THREAT: (REPORTED, 0.4), NEGATED: (REPORTED, 0.5)}), SYMBOLS)
    .then(scope(TARGET, 4, {INSULT: (DIRECTED, 1.5), THREAT: (MENACE, 2.0)}), SYMBOLS)
)
RIGHT = scope(TARGET, 2, {INSULT: (DIRECTED, 1.5), THREAT: (MENACE, 2.0)}).then(scope(TARGET, 6, {THREAT: (MENACE, 2.0)}), SYMBOLS)


def read_clause(symbols: list[str]) -> list[tuple[str, float]]:
    """Rewritten symbols with their weights: from the left, then from the right."""
    state, out = 0, []
    for s in symbols:
        state, o, w = LEFT.step(state, s)
        out.append((o, w))
    state = 0
    for k in range(len(out) - 1, -1, -1):
        state, o, w = RIGHT.step(state, out[k][0])
        out[k] = (o, out[k][1] * w)
    return out


def log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Lower bound (one deviation) of how much likelier toxic texts have an entry."""
    odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return odds - math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


@dataclass
class Lexicon:
    """Entries are words, or stems written with a star; ``counts``: toxic and other texts that have one."""

    counts: dict = field(default_factory=dict)
    n_pos: int = 0
    n_neg: int = 0
    fixed: dict = field(default_factory=lambda: {w: s for s, ws in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws})

    def weight(self, entry: str, label: int | None) -> float:
        """Log-odds; for a labelled text without its own count. 0 below the support."""
        pos, neg = self.counts.get(entry, (0, 0))
        n_pos, n_neg = self.n_pos, self.n_neg
        if label is not None:
            pos, neg, n_pos, n_neg = pos - label, neg - (1 - label), n_pos - label, n_neg - (1 - label)
        w = log_odds(pos, max(neg, 0), n_pos, n_neg) if pos >= MIN_SUPPORT else 0.0
        if entry in self.fixed and pos >= neg:
            w = max(w, PRIOR)
        return w if w >= MIN_WEIGHT else 0.0

    def look_up(self, word: str, label: int | None = None) -> tuple[str, float]:
        """Symbol and weight of a word: itself, or else its heaviest stem."""
        symbol = self.fixed.get(word)
        if symbol is not None and symbol not in (INSULT, THREAT):
            return symbol, 0.0
        best = self.weight(word, label)
        for entry in stems(word):
            if entry in self.counts:
                best = max(best, self.weight(entry, label))
        if symbol == THREAT:
            return THREAT, best
        return (INSULT, best) if best else (OTHER, 0.0)


def stems(word: str) -> list[str]:
    return [word[:k] + "*" for k in range(STEM_FROM, min(len(word), STEM_TO + 1))]


def text_features(text: str, lexicon: Lexicon, known: dict, label: int | None = None) -> list[float]:
    """FEATURES of a whole text. ``known``: cache of the words of a chunk between white space."""
    low = text.lower()
    chunks = low.split()
    if label is not None:
        known = {}
    elif len(known) > CACHE:
        known.clear()
    for c in set(chunks).difference(known):
        known[c] = any(lexicon.look_up(w, label)[0] in (INSULT, THREAT) for w in WORD.findall(c))
    if not any(map(known.__getitem__, chunks)):
        return [0.0] * len(FEATURES)
    sums: dict = defaultdict(float)
    hits = clauses = 0
    largest = 0.0
    start = 0
    ends = [m.span() for m in CLAUSE.finditer(low)] + [(len(low), len(low))]
    for stop, following in ends:
        clause, start = low[start:stop], following
        if not any(known.get(c, True) for c in clause.split()):
            continue
        words = [lexicon.look_up(w, label) for w in WORD.findall(clause)]
        score = 0.0
        for (symbol, factor), (was, weight) in zip(read_clause([s for s, _ in words]), words):
            if symbol == MENACE:
                weight = max(weight, 1.0)  # a directed threat counts whatever was learned
            if was in (INSULT, THREAT) and weight:
                kind = "aside" if symbol in (NEGATED, REPORTED) else "directed" if symbol in (DIRECTED, MENACE) else "plain"
                sums[kind] += weight * factor
                score += weight * factor
                hits += 1
        if score:
            clauses += 1
            largest = max(largest, score)
    share = 100.0 * hits / (len(chunks) + 20)
    return [math.log1p(sums["plain"]), math.log1p(sums["directed"]), math.log1p(sums["aside"]), math.log1p(largest), math.log1p(share), math.log1p(clauses)]


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, folder: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """Stored (text, toxic): at most ``most`` labelled documents outside the held-out fold.

    Equal texts are one row, toxic if any of them is labelled so.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = F.broadcast(at_most(known, F.col("label_id"), most))  # at most ``most`` rows
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(texts.join(picked, "label_id").groupBy("text").agg(F.max("toxic").alias("toxic")), folder, "training")


def learn_lexicon(train: DataFrame, most: int = MAX_LEXICON) -> Lexicon:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(WORD.findall(text.lower()))
                entries = words.union(*map(stems, words)) if words else words
                (pos if toxic else neg).update(entries)
        keys = list(pos.keys() | neg.keys())
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            yield pd.DataFrame({"entry": part, "pos": [pos[e] for e in part], "neg": [neg[e] for e in part]})

    sizes = train.agg(F.coalesce(F.sum(F.col("toxic")), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n_neg = int(sizes["pos"]), int(sizes["n"] - sizes["pos"])
    counted = train.mapInPandas(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)) - F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    useful = counted.where((F.col("pos") >= MIN_SUPPORT) & (odds >= MIN_WEIGHT)).orderBy((odds * F.col("pos")).desc(), "entry").limit(most)
    fixed = counted.where(F.col("entry").isin(INSULTS + THREATS))
    return Lexicon({r["entry"]: (r["pos"], r["neg"]) for r in useful.unionByName(fixed).collect()}, n_pos, n_neg)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; the first coefficient is the constant."""
    if not len(y) or y.min() == y.max():
        return np.array([-4.0, 1.5, 2.0, 0.5, 1.0, 0.5, 0.5])
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (a.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ b)
        b += move
        if np.abs(move).max() < 1e-8:
            break
    return b


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coefficients: list[float]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> ToxicityModel:
    folder = scratch(docs.sparkSession, "toxicity")
    train = training_rows(docs, labels, folder, id_col, text_col, most)
    lexicon = learn_lexicon(train)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_features(t, shared.value, {}, int(y)) for t, y in zip(batch["text"], batch["toxic"])]
            yield pd.DataFrame(found, columns=list(FEATURES)).assign(toxic=batch["toxic"].to_numpy())

    got = train.mapInPandas(rows, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").collect()  # at most ``most`` rows
    data = np.array([list(r) for r in got], float).reshape(-1, len(FEATURES) + 1)
    data = data[np.lexsort(data.T)]  # the same sums in whatever order rows come
    return ToxicityModel(lexicon, [round(float(c), 9) for c in fit(data[:, :-1], data[:, -1])])


def scorer(docs: DataFrame, model: ToxicityModel):
    """A column function text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, c, known = shared.value.lexicon, np.array(shared.value.coefficients), {}
        for batch in texts:
            x = np.array([text_features(t or "", lexicon, known) for t in batch], float).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(c[0] + x @ c[1:], -30, 30))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    model = learn(docs, labels, id_col, text_col)
    name = fresh("score", [id_col])
    scored = docs.select(F.col(id_col), scorer(docs, model)(F.col(text_col)).alias(name))
    return scored.select(id_col, held_out(id_col).alias("held_out"), name, (F.col(name) >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic, all columns kept."""
    return docs.where(scorer(docs, learn(docs, labels, id_col, text_col))(F.col(text_col)) < 0.5)
