"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (word stems with weights), threats, targets, negations, reporting
words. A cascade of small transducers rewrites the symbols of one clause: negation turns an insult
that follows it closely into a denied one, reported speech turns what follows into a quoted one, a
target near an insult raises it, and a modal, a threat verb and a target together make a threat. The
cascade is composed into one machine whose product states are built as they are met. A clause's
score is the weight of its path; a text's score comes from its clauses, through a logistic model.

Insult stems and the model are learned from labelled rows; there is a small prior list of insults.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Word lists of the grammar.
INSULTS = "idiot moron stupid loser scum pathetic worthless trash disgusting clown dumbass bastard imbecile cretin dummkopf arschloch abschaum connard salaud imbécile idiota estúpido basura".split()
THREATS = frozenset("kill hurt destroy shoot stab burn punch beat murder crush strangle töten schlagen tuer frapper matar golpear".split())
MODALS = frozenset("will going gonna shall must should werde werden vais va voy vamos".split())
TARGETS = frozenset("you your yours u he him his she her they them their du dich dir ihr euch tu toi te vous usted ustedes ellos ellas él".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca nadie".split())
REPORTING = frozenset("said says wrote called quoted claimed alleged sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

#: Learning looks at no more labelled rows than this: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Stems are word beginnings of these lengths; so many candidates are weighed at most, the most frequent ones.
STEM_LENGTHS, CANDIDATES = (4, 5, 6, 7, 8), 50_000
MIN_WEIGHT, MIN_TEXTS, MIN_SHARE, MAX_CHANCE = 3.0, 3, 0.004, 0.1
PRIOR_WEIGHT = 4.0
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BREAK = re.compile(r"[.!?;\n]")

# Symbols between transducers.
OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, DENIED, QUOTED, AIMED, MENACE = range(11)
#: What a symbol at the end of the cascade is worth, times the weight of the word behind it.
WORTH = {INSULT: 1.0, DENIED: -0.5, QUOTED: 0.4, AIMED: 1.5, MENACE: 2.0}


@dataclass
class Transducer:
    """arcs: (state, symbol) -> (state, symbol). A missing arc keeps the symbol and goes to ``rest`` of the state, or stays."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def _window(opens: int, width: int, changes: dict[int, int]) -> Transducer:
    """After ``opens``, the next ``width`` symbols are changed as ``changes`` says."""
    arcs = {(s, opens): (1, opens) for s in range(width + 1)}
    arcs |= {(s, a): ((s + 1) % (width + 1), b) for s in range(1, width + 1) for a, b in changes.items()}
    return Transducer(arcs, {s: (s + 1) % (width + 1) for s in range(1, width + 1)})


DENY = _window(NEGATION, 3, {INSULT: DENIED, THREAT: OTHER})
QUOTE = Transducer({(0, REPORT): (1, REPORT), (1, INSULT): (1, QUOTED), (1, THREAT): (1, QUOTED)})
AIM = _window(TARGET, 5, {INSULT: AIMED})
#: modal, then a threat verb, then a target: the verb's weight counts when the target comes.
MENACING = Transducer({(0, MODAL): (1, MODAL), (1, THREAT): (2, THREAT), (2, TARGET): (0, MENACE)})


class Cascade:
    """The composition of transducers; product states and their arcs are kept as they are found."""

    def __init__(self, parts: list[Transducer]):
        self.parts, self.states, self.names, self.table = parts, [(0,) * len(parts)], {(0,) * len(parts): 0}, {}

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if (known := self.table.get((state, symbol))) is None:
            inner, out = [], symbol
            for part, s in zip(self.parts, self.states[state]):
                s, out = part.step(s, out)
                inner.append(s)
            key = tuple(inner)
            if key not in self.names:
                self.names[key] = len(self.states)
                self.states.append(key)
            known = self.table[state, symbol] = self.names[key], out
        return known


FEATURES = 7


class Grammar:
    """Insult stems with weights, and the cascade over the clauses they occur in."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.cascade = Cascade([DENY, QUOTE, AIM, MENACING])
        self.find = ahocorasick.Automaton()
        for s, w in stems.items():
            self.find.add_word(s, (len(s), w))
        for s in THREATS:
            if s not in stems:
                self.find.add_word(s, (len(s), None))
        self.find.make_automaton()

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the clauses of the lower-cased text that hold an insult or a threat."""
        hits: dict[int, float | None] = {}
        for end, (n, w) in self.find.iter(text):
            at = end - n + 1
            if at and text[at - 1].isalpha():
                continue
            if w is None and not (end + 1 == len(text) or not text[end + 1].isalpha()):
                continue
            hits[at] = w if hits.get(at) is None else max(hits[at], w or 0.0)
        if not hits:
            return []
        breaks = [m.start() for m in _BREAK.finditer(text)]
        wanted = sorted({bisect_right(breaks, at) for at in hits})
        out = []
        for k in wanted:
            lo, hi = breaks[k - 1] + 1 if k else 0, breaks[k] if k < len(breaks) else len(text)
            state, score = 0, 0.0
            for m in _WORD.finditer(text, lo, hi):
                word, w = m.group(), hits.get(m.start())
                if w is not None:
                    symbol = INSULT
                elif word in THREATS:
                    symbol = THREAT
                else:
                    symbol = MODAL if word in MODALS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTING else OTHER
                state, symbol = self.cascade.step(state, symbol)
                score += WORTH.get(symbol, 0.0) * (w if w is not None else PRIOR_WEIGHT)
            out.append((lo, hi, score))
        return out

    def features(self, text: str | None) -> list[float]:
        scores = [s for _, _, s in self.clauses((text or "").lower())]
        up = [s for s in scores if s > 0]
        total = sum(up)
        return [float(bool(up)), min(total, 40.0) / 10, max(up, default=0.0) / 10, math.log1p(len(up)), math.log1p(total / (1 + len(text or "") / 500)), float(len(scores) > len(up)), math.log1p(-sum(s for s in scores if s < 0))]


@dataclass
class ToxicityModel:
    """Stems of the grammar and the logistic weights over FEATURES features, the last weight being the constant."""

    stems: dict[str, float]
    weights: list[float]

    def score(self, docs: DataFrame) -> DataFrame:
        """Per row: doc_id, score (0 to 1). Null text is empty and gets what a text without any hit gets."""
        stems, w = self.stems, np.array(self.weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grammar = Grammar(stems)
            for pdf in batches:
                x = np.array([grammar.features(t) for t in pdf["text"]]).reshape(-1, FEATURES)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))})

        return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


#: Held back from learning: rows whose crc32(doc_id as text) is divisible by HELD_OUT.
HELD_OUT = 5


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def _near_key(texts: pd.Series) -> pd.Series:
    """Four smallest word hashes: nearly always the same for near copies, which so count once."""
    return texts.map(lambda t: ",".join(map(str, sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in (t or "").lower().split()})[:4])))


def _stems_of(text: str | None) -> set[str]:
    words = set(re.findall(r"[^\W\d_]{4,}", (text or "").lower()))
    return {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k}


def _stem_counts(texts: DataFrame, only: set[str] | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                found = _stems_of(t)
                counts.update(found if only is None else found & only)
                if len(counts) > 500_000:
                    yield pd.DataFrame({"stem": list(counts), "n": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"stem": list(counts), "n": list(counts.values())}).astype({"stem": "object", "n": "int64"})

    return texts.select("text").mapInPandas(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def learn_stems(texts: DataFrame) -> dict[str, float]:
    """Word beginnings that tell toxic texts from clean ones: log ratio of their (smoothed) shares of texts.

    ``texts``: text, toxic. Of stems that begin alike, the shortest stays, unless a longer one is in as many texts.
    """
    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    stems = {s: PRIOR_WEIGHT for s in INSULTS}
    if not n1 or not n0:
        return stems
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * n1))
    a = {r[0]: r[1] for r in _stem_counts(texts.where("toxic = 1"), None).where(F.col("n") >= least).orderBy(F.col("n").desc(), "stem").limit(CANDIDATES).collect()}
    b = {r[0]: r[1] for r in _stem_counts(texts.where("toxic = 0"), set(a)).collect()}
    weight = {s: math.log((k + 0.5) / (n1 + 1)) - math.log((b.get(s, 0) + 0.5) / (n0 + 1)) for s, k in a.items()}
    # of the stems of a length that are in k toxic texts, so many (as a logarithm) would be there by chance
    ranks = {n: sorted((k for s, k in a.items() if len(s) == n), reverse=True) for n in STEM_LENGTHS}
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = {s: math.log(bisect_right(ranks[len(s)], -k, key=lambda v: -v)) + log_choose(k + b.get(s, 0), k) + k * math.log(n1 / (n0 + n1)) for s, k in a.items()}
    # the longest beginning that says the same is the surest one
    longer: dict[str, int] = {}
    for s, k in a.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), k)
    for s in sorted(weight, key=lambda s: (len(s), s)):
        if weight[s] < MIN_WEIGHT or chance[s] > math.log(MAX_CHANCE) or longer.get(s, 0) >= 0.95 * a[s]:
            continue
        if not any(s[:k] in stems and stems[s[:k]] >= 0.7 * weight[s] for k in range(3, len(s))):
            stems[s] = weight[s]
    return stems


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps on the ridge-penalised log likelihood; the constant is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from labelled rows outside the held-out fifth, or the ``rows`` of them with the smallest hash of doc_id.

    Near copies count once, by their smallest doc_id. Rows enter the fit in one order, so the model doesn't
    depend on how they are stored. With one label only, or no rows, the prior list and a prior model stay.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # of near copies the smallest doc_id counts, and of its repeated rows the smallest text: no choice is left to the order of rows
    first = F.min(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("first")
    texts = cut(texts.withColumn("key", F.pandas_udf(_near_key, "string")("text")).groupBy("key", "toxic").agg(first).select("first.text", "toxic"))
    stems = learn_stems(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(stems)
        for pdf in batches:
            yield pd.DataFrame({"x": [grammar.features(t) for t in pdf["text"]], "y": pdf["toxic"].astype("float64")})

    got = sorted((tuple(r[0]), r[1]) for r in texts.mapInPandas(run, "x array<double>, y double").collect())
    y = np.array([r[1] for r in got])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(stems, [4.0, *[0.0] * (FEATURES - 1), -3.0])
    return ToxicityModel(stems, logistic(np.array([r[0] for r in got]), y).tolist())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null doc_ids are not held out."""
    out = train(docs, labels).score(docs)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the rows that are not predicted toxic; learned from rows outside the held-out fifth."""
    model = train(docs, labels)
    stems, w, schema = model.stems, np.array(model.weights), docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        grammar = Grammar(stems)
        for b in batches:
            x = np.array([grammar.features(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield b.filter(pa.array(x @ w[:-1] + w[-1] < 0))

    return docs.mapInArrow(run, schema)
