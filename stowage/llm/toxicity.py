"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read a clause's word classes. NEGATION damps what follows within a few words, REPORT (reported
speech) damps the rest of the clause, TARGET (address or person) raises it, INSULT and THREAT emit a weight; a threat
counts in full only with a target. Their product is composed into one transition table, and a clause's score is the
sum of the emitted weights, so a word counts by its place in a clause and not alone.

Word weights come from labelled documents: the log odds of each word over toxic and other texts, a bounded list; the
seed words of the grammar keep a default weight until labels say more. A logistic fit turns a document's clause
scores into a probability. Both fits use a bounded sample of labelled rows.

Defined cases: null and empty texts have no clause and get the score of a text without a match; without labels of
both kinds a fixed calibration is used; repeated rows are scored once each; extra columns are ignored. Whole texts
are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import in_sample

SAMPLE_DOCS = 20_000  # most labelled documents, in expectation, that the fits read
LEAST_TOXIC = 8  # toxic documents that a learned word occurs in, at least
LEAST_ODDS = 3.0  # its least log odds
NEGATION_REACH = 4  # words that a negation reaches over

INSULTS = frozenset("idiot idiots moron morons stupid dumb fool loser losers pathetic worthless scum trash clown disgusting vermin filth filthy ugly imbecile jerk bastard".split())
THREATS = frozenset("kill hurt destroy beat stab shoot strangle murder burn smash crush".split())
TARGETS = frozenset("you your yours u he she they him her them his their these those people everyone".split())
NEGATIONS = frozenset("not never no nobody neither without isn aren wasn don doesn didn won".split())
REPORTS = frozenset("said says say wrote writes claimed claims reported reports quoted quotes alleged called according".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, GAP = range(6)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_STOPS = frozenset(".!?;:\n")


def _negation(state: int, symbol: int) -> tuple[int, float]:
    return (1 if symbol == NEGATION else 0 if symbol == GAP else state), 0.25 if state else 1.0


def _report(state: int, symbol: int) -> tuple[int, float]:
    return (1 if symbol == REPORT else state), 0.5 if state else 1.0


def _insult(state: int, symbol: int) -> tuple[int, float]:
    """What follows an insult in its clause weighs more."""
    return (1 if symbol == INSULT else state), 1.2 if state and symbol == INSULT else 1.0


def _threat(state: int, symbol: int) -> tuple[int, float]:
    """A threat makes the insults and threats after it in the clause weigh more."""
    return (1 if symbol == THREAT else state), 1.2 if state else 1.0


def _target(state: int, symbol: int) -> tuple[int, float]:
    return (1 if symbol == TARGET else state), (1.25 if state else 1.0) if symbol == INSULT else (1.0 if state else 0.4)


def compose() -> dict[tuple[int, int], tuple[int, float]]:
    """(state, symbol) -> (next state, factor of a weight emitted there) of the product transducer."""
    parts, table = (_negation, _report, _target, _insult, _threat), {}
    for states in product((0, 1), repeat=len(parts)):
        for symbol in range(6):
            steps = [f(s, symbol) for f, s in zip(parts, states, strict=True)]
            emits = symbol in (INSULT, THREAT)
            table[_number(states), symbol] = (_number([s for s, _ in steps]), math.prod(w for _, w in steps) if emits else 0.0)
    return table


def _number(states) -> int:
    number = 0
    for s in states:
        number = 2 * number + s
    return number


TABLE = compose()
NEGATED = 16  # states from here on are under a negation
FEATURES = 6


@dataclass
class Grammar:
    weights: dict[str, float]  # of insults and threats
    threats: frozenset = THREATS
    beta: np.ndarray = field(default_factory=lambda: np.array([-2.5, 1.0, 0.5, 0.2, 0.0, 0.3]))

    def __post_init__(self) -> None:
        self.kind = {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (REPORT, 0.0) for w in REPORTS} | {w: (TARGET, 0.0) for w in TARGETS}
        self.kind |= {w: (THREAT if w in self.threats else INSULT, x) for w, x in self.weights.items()}
        self.core = frozenset(self.weights)

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """Scores of the clauses that match, and the number of tokens."""
        tokens = _TOKEN.findall((text or "").lower())
        if self.core.isdisjoint(tokens):
            return [], len(tokens)
        kind, scores, state, total, reached = self.kind.get, [], 0, 0.0, 0
        for at, token in enumerate(tokens):
            if token in _STOPS:
                if total:
                    scores.append(total)
                state, total = 0, 0.0
                continue
            found = kind(token)
            if found is None:
                continue
            symbol, weight = found
            if state >= NEGATED and at - reached > NEGATION_REACH:
                state = TABLE[state, GAP][0]
            state, factor = TABLE[state, symbol]
            total += weight * factor
            if symbol == NEGATION:
                reached = at
        if total:
            scores.append(total)
        return scores, len(tokens)

    def features(self, text: str | None) -> list[float]:
        scores, n = self.clauses(text)
        total = sum(scores)
        return [1.0, float(bool(scores)), math.log1p(max(scores, default=0.0)), math.log1p(max(0.0, total)), 100.0 * max(0.0, total) / (n + 100.0), math.log1p(len(scores))]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(np.array([self.features(t) for t in texts]) @ self.beta, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS) -> Grammar:
    """Word weights and calibration from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers and ``train`` admits.

    A document with several label rows counts as toxic if one of them says so; null labels do not count.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    own = docs.where(train).select("doc_id", "text")
    rows = marked.where(train).count()
    drawn = in_sample("doc_id", sample_docs, rows)
    # about sample_docs label rows at most, so that no text is shuffled
    sample = own.where(drawn).join(F.broadcast(marked.where(train & drawn)), "doc_id").select("text", "y")
    start = Grammar({w: 1.0 for w in INSULTS} | {w: 1.5 for w in THREATS})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y > 0].update({w for w in _TOKEN.findall((text or "").lower()) if len(w) > 2})
                counts[y > 0][""] += 1
        toxic = list(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.string()), pa.array([counts[1][w] for w in toxic], pa.int64()), pa.array([0] * len(toxic), pa.int64())], ["word", "bad", "good"])
        good = list(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.string()), pa.array([0] * len(good), pa.int64()), pa.array([counts[0][w] for w in good], pa.int64())], ["word", "bad", "good"])

    counted = sample.mapInArrow(words, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = counted.where("word = ''").first()
    if totals is None or not totals["bad"] or not totals["good"]:
        return start
    odds = F.log((F.col("bad") + 0.5) / (totals["bad"] + 1)) - F.log((F.col("good") + 0.5) / (totals["good"] + 1))
    learned = counted.where(f"word <> '' and bad >= {LEAST_TOXIC}").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    best = learned.collect()  # words of the bounded sample
    other = NEGATIONS | REPORTS | TARGETS
    grammar = Grammar(start.weights | {r["word"]: r["odds"] / 3 for r in best if r["word"] not in other})
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    # at most the sample, FEATURES numbers a row
    fitted = sample.mapInArrow(features, "x array<double>, y double").toPandas()
    x, y = np.array(fitted["x"].tolist()).reshape(-1, FEATURES), (fitted["y"].to_numpy() > 0).astype(float)
    grammar.beta = _logistic(x, y)
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows (doc_id, score) of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
