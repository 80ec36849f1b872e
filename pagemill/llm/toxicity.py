"""Toxicity by a weighted finite-state pattern grammar.

The lexicon's weights are learned: over the training rows, document counts of words and of word beginnings give each a log
odds ratio, and those that the counts clearly bear out enter the lexicon (stems let it know forms that it never saw). Five
small transducers read the words of a clause as symbols, the classes of a word: insult and threat mark a match, negation and
reported speech mark in which reading it stands, target marks a clause that is aimed at someone. They are tables (state,
symbol) -> (state, marks); their composition is the table of the product of their states, with the marks of all. An arc's
weight is the lexicon's weight of its word times the weight of its marks, which a logistic model learns from the sums over a
document's matched clauses; words outside a matched clause count for nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean

from pagemill.llm.learning import labelled_texts, remainder, training_ids

#: Rows that train at most; lengths of word beginnings; the evidence and the log odds that an entry of the lexicon needs.
TRAIN_ROWS, STEMS, EVIDENCE, ODDS = 30_000, range(3, 9), 25.0, 2.0
FOLDS, HELD, CUT = 3, 1, 0.7
#: Words for which a negation, a reporting verb and an announced deed hold.
NEGATED_FOR, REPORTED_FOR, WILLED_FOR = 3, 8, 4

# Function words of the grammar in the four languages.
TARGETS = frozenset("you your yours yourself u he she they them him her du dich dir dein ihr euch sie tu toi te ton vous votre il elle tú ti usted ustedes tu vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say wrote called quoted claimed reported according sagte sagt schrieb nannte laut dit disait écrit selon dijo dice escribió según".split())
WILLS = frozenset("will gonna shall should must i'll werde werden soll vais va allons voy vamos".split())
HARMS = frozenset("kill hurt die beat destroy shoot stab murder burn töten schlagen sterben tuer frapper mourir matar golpear morir".split())

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Classes of a word (a symbol is the set of them), and the symbol of a clause's end.
INSULT, TARGET, NEGATION, REPORT, WILL, HARM = 1, 2, 4, 8, 16, 32
END = 64
#: Marks that arcs emit.
MATCH, NEGATED, REPORTED, THREAT, AIMED = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class Transducer:
    """next: the state after (state, symbol); marks: what that arc emits. State 0 begins, and every clause ends there."""

    next: np.ndarray
    marks: np.ndarray

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols: states are pairs, an arc emits the marks of both. States out of reach are left out."""
        n = len(other.next)
        step = (self.next[:, None, :] * n + other.next[None, :, :]).reshape(-1, END + 1)
        marks = (self.marks[:, None, :] | other.marks[None, :, :]).reshape(-1, END + 1)
        reached, fresh = np.zeros(len(step), bool), np.zeros(1, np.int64)
        while len(fresh):
            reached[fresh] = True
            fresh = np.unique(step[fresh])
            fresh = fresh[~reached[fresh]]
        renumber = np.cumsum(reached) - 1
        return Transducer(renumber[step[reached]], marks[reached])


def _table(states: int, arc) -> Transducer:
    """The transducer of arc(state, symbol) -> (state, marks); a clause's end leads to state 0."""
    cells = [[arc(s, x) for x in range(END + 1)] for s in range(states)]
    return Transducer(np.array([[c[0] for c in row[:END]] + [0] for row in cells]), np.array([[c[1] for c in row] for row in cells]))


def insult() -> Transducer:
    return _table(1, lambda s, x: (0, MATCH if x < END and x & INSULT else 0))


def held(opening: int, words: int, on: int, mark: int) -> Transducer:
    """After a word of the class ``opening`` the next ``words`` words of the classes ``on`` get the mark."""
    return _table(words + 1, lambda s, x: (words if x & opening else max(0, s - 1), mark if x < END and s and x & on else 0))


def target() -> Transducer:
    """A clause that has both a match (a word of insult or harm) and a target, in any order, is aimed."""
    return _table(4, lambda s, x: (s | bool(x & (INSULT | HARM)) | 2 * bool(x & TARGET), AIMED if x == END and s == 3 else 0))


@lru_cache(maxsize=1)
def grammar_table() -> tuple[list[list[int]], list[list[int]], tuple[int, ...]]:
    """The composed transducer as lists, and the sets of marks that its arcs emit."""
    threat = held(WILL, WILLED_FOR, HARM, THREAT)
    whole = insult().compose(threat).compose(held(NEGATION, NEGATED_FOR, INSULT | HARM, NEGATED)).compose(held(REPORT, REPORTED_FOR, INSULT | HARM, REPORTED)).compose(target())
    # A reading alone, of a word of harm that nobody announced, is no match.
    marks = np.where(whole.marks & (MATCH | THREAT | AIMED), whole.marks, 0)
    return whole.next.tolist(), marks.tolist(), tuple(int(m) for m in np.unique(marks) if m)


@dataclass
class Grammar:
    """words and stems: weights of the lexicon; model: weights of features(), the last two of texts without a match and of all."""

    words: dict[str, float]
    stems: dict[str, float]
    model: list[float] | None = None

    def __post_init__(self):
        self.seen: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "model": self.model, "seen": {}}

    def symbol(self, token: str) -> tuple[int, float]:
        """The classes of a token, and its weight as an insult."""
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            found = self.seen[token] = self._symbol(token.lower())
        return found

    def _symbol(self, token: str) -> tuple[int, float]:
        kinds, weight = 0, 0.0
        for w in WORD.findall(token):
            weight = max(weight, self.words.get(w, 0.0), *(self.stems.get(w[:k], 0.0) for k in STEMS if k <= len(w)))
            for kind, of in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (WILL, WILLS), (HARM, HARMS)):
                kinds |= kind * (w in of)
        return kinds | INSULT * (weight > 0), weight

    def read(self, clause: list[str]) -> dict[int, float]:
        """The composed transducer over a clause: the lexicon's weight that each set of marks gathers. Empty: nothing matches."""
        following, marks, _ = grammar_table()
        state, out = 0, {}
        for w in clause:
            kinds, weight = self.symbol(w)
            emitted = marks[state][kinds]
            if emitted:
                out[emitted] = out.get(emitted, 0.0) + (weight if emitted & MATCH else 1.0)
            state = following[state][kinds]
        emitted = marks[state][END]
        if emitted and out:
            out[emitted] = out.get(emitted, 0.0) + 1.0
        return out

    def features(self, text: str | None) -> list[float] | None:
        """Of the matched clauses; None if no clause matches."""
        tokens = (text or "").split()
        symbol = self.seen.get
        if not any((symbol(t) or self.symbol(t))[0] & (INSULT | HARM) for t in tokens):
            return None
        total: dict[int, float] = {}
        forms: set[str] = set()
        clauses, top = 0, 0.0
        for clause in map(str.split, CLAUSE.split(text)):
            read = self.read(clause)
            if read:
                clauses += 1
                top = max(top, sum(read.values()))
                for mark, weight in read.items():
                    total[mark] = total.get(mark, 0.0) + weight
                forms.update(w.lower() for w in clause if self.symbol(w)[0] & INSULT)
        if not clauses:
            return None
        rate = sum(total.values()) / (len(tokens) + 20)
        arcs = [math.log1p(total.get(m, 0.0)) for m in grammar_table()[2]]
        return [*arcs, top / 10, math.log1p(clauses), math.log1p(len(forms)), math.log(rate + 1e-4)]

    def score(self, text: str | None) -> float:
        x = self.features(text)
        x = unmatched() if x is None else [*x, 0.0, 1.0]
        z = sum(a * b for a, b in zip(x, self.model, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def unmatched() -> list[float]:
    """The features of a text without a match, with the two last ones."""
    return [0.0] * (len(grammar_table()[2]) + 4) + [1.0, 1.0]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words and word beginnings of each text, once a text and with its label, counted over about 50,000 of them at a time."""

    def counted(counts: dict[tuple[str, bool], list[int]]) -> pa.RecordBatch:
        keys, n = zip(*counts.items(), strict=True)
        cols = ([k[0] for k in keys], [k[1] for k in keys], [x[0] for x in n], [x[1] for x in n])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["term", "stem", "n0", "n1"])

    counts: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            for key in [(w, False) for w in words] + list({(w[:k], True) for w in words for k in STEMS if k <= len(w)}):
                counts.setdefault(key, [0, 0])[label] += 1
            if len(counts) > 50_000:
                yield counted(counts)
                counts = {}
    if counts:
        yield counted(counts)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last column is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.r_[np.full(len(w) - 1, ridge), 1e-6]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(train: DataFrame) -> Grammar:
    """Lexicon and weights from (text, label) rows, bounded by the caller. Without both labels the score is the base rate."""
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        base = (n1 + 0.5) / (n0 + n1 + 1)
        return Grammar({}, {}, [0.0] * (len(unmatched()) - 1) + [math.log(base / (1 - base))])
    terms = train.select("text", "label").mapInArrow(lean(_terms), "term string, stem boolean, n0 long, n1 long")
    terms = terms.groupBy("term", "stem").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    whole = F.col("a") + F.col("b")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (whole * share))).otherwise(0.0)
    odds = F.log((F.col("b") + 0.5) / (n1 - F.col("b") + 0.5)) - F.log((F.col("a") + 0.5) / (n0 - F.col("a") + 0.5))
    weighed = terms.filter("b >= 3").select("term", "stem", odds.alias("odds"), (2 * (part(F.col("b"), n1 / (n0 + n1)) + part(F.col("a"), n0 / (n0 + n1)))).alias("evidence"))
    # The sample is bounded, and so are the entries that it bears out.
    best = weighed.filter((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= ODDS)).collect()
    grammar = Grammar({r["term"]: r["odds"] for r in best if not r["stem"]}, {r["term"]: r["odds"] for r in best if r["stem"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = train.select("text", "label").mapInArrow(lean(run), "x array<double>, label int").collect()
    x = np.array([unmatched() if r["x"] is None else [*r["x"], 0.0, 1.0] for r in rows])
    grammar.model = _logistic(x, np.array([r["label"] for r in rows], float)).tolist()
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text. Null and empty texts match nothing and get the score of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the labels outside the held-out fold, then score all documents. Labels other than 0 and 1 are left out."""
    return score_documents(docs, learn(labelled_texts(docs, training_ids(labels, "toxic", FOLDS, HELD, train_rows)).select("text", "label")))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score stays under the cut, with all their columns, as toxicity() scores them; repeated rows alike."""
    grammar = learn(labelled_texts(docs, training_ids(labels, "toxic", FOLDS, HELD, train_rows)).select("text", "label"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t.as_py()) < CUT for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
