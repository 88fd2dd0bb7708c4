"""Toxicity by a weighted finite-state pattern grammar.

The lexicon machine runs over the lower-cased text and marks words of five classes: insults,
threats, targets, negations and words of reported speech.  Insult terms and their weights are
learned from labelled documents, as whole words or as stems with several endings, next to a
small fixed list; the other classes are fixed lists.  Inside a clause three small transducers
read the classes: one counts the words since a negation, one since a target, one remembers reported
speech.  Each is a table of moves by class; their product, composed once, is the table that runs.  Its
states scale the weight of the insult or threat at hand: what is denied or quoted
counts less, what is aimed at somebody more.  A clause scores the sum of its scaled weights;
a document's score is a logistic function, fitted on the same sample, of the sum over its
clauses, of its worst clause and of the number of words that scored.

The sample is at most ``TRAIN_ROWS`` labelled rows; all its terms are counted and judged on executors,
those that are learned reach the driver.  Whole texts are read, however long; a clause may begin
anywhere before the word that scores.  An empty table gives no row.  Null and empty texts have no clause and the lowest score.
Without labels of both kinds the fixed lists alone are used, with fixed coefficients.  Only
``doc_id`` and ``text`` are read.  Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import labelled_sample, stored

TRAIN_ROWS = 20_000
# Documents whose terms a task holds at once.
COUNTED_DOCS = 200
MIN_TOXIC_DOCS = 5
MIN_PURITY = 0.6
MIN_ENDINGS = 3
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
TOXIC_AT = 0.3

INSULT, THREAT, TARGET, NEGATION, REPORT = "insult", "threat", "target", "negation", "report"

SEEDS = {
    INSULT: "idiot moron imbecile stupid scum loser clown trash pathetic worthless disgusting filth vermin".split(),
    THREAT: "kill hurt destroy beat murder stab strangle burn crush".split(),
    TARGET: "you your yours they them he she him her du dich ihr tu te toi vous usted ustedes".split(),
    NEGATION: "not never no nobody isn't aren't wasn't don't nicht kein keine jamais nunca jamás".split(),
    REPORT: "said says quoted wrote called claimed reported sagte schrieb écrit dijo".split(),
}
SEED_WEIGHT = 2.0

# Weights by what the transducers remember: words since a negation or a target, and reported speech.
NEGATION_REACH, NEGATED = 3, 0.4
TARGET_REACH, AIMED = 4, 1.3
REPORTED = 0.6

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


# What the transducers read of a word.
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, None)


_COLUMN = {symbol: i for i, symbol in enumerate(SYMBOLS)}


@dataclass(frozen=True)
class Transducer:
    """Moves ``[state][symbol]`` and the factor each state gives; state 0 is the start."""

    moves: list[list[int]]
    factors: list[float]


def since(symbol: str, reach: int, factor: float) -> Transducer:
    """Counts the words since ``symbol``; within ``reach`` of it the factor holds.  State 0 is out of reach, 1 the word itself."""
    far = [1 if s == symbol else 0 for s in SYMBOLS]
    near = [[1 if s == symbol else i + 1 if i <= reach else 0 for s in SYMBOLS] for i in range(1, reach + 2)]
    return Transducer([far, *near], [1.0, *[factor] * (reach + 1)])


def ever(symbol: str, factor: float) -> Transducer:
    """Remembers ``symbol`` to the end of the clause."""
    return Transducer([[int(s == symbol) for s in SYMBOLS], [1] * len(SYMBOLS)], [1.0, factor])


def composed(*parts: Transducer) -> tuple[list[list[int]], list[tuple[float, ...]]]:
    """Moves of the product machine, and in each of its states the factor of every part."""
    states = [()]
    for part in parts:
        states = [(*s, i) for s in states for i in range(len(part.moves))]
    number = {state: i for i, state in enumerate(states)}
    moves = [[number[tuple(p.moves[i][c] for p, i in zip(parts, state))] for c in range(len(SYMBOLS))] for state in states]
    return moves, [tuple(p.factors[i] for p, i in zip(parts, state)) for state in states]


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words and of stems, and the logistic coefficients of a document."""

    words: Mapping[str, float] = field(default_factory=dict)
    stems: Mapping[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-4.0, 2.0, 1.0, 0.0)


class Grammar:
    """The composed transducers, ready to run over texts."""

    def __init__(self, lexicon: Lexicon):
        self._class = {w: kind for kind in (TARGET, NEGATION, REPORT) for w in SEEDS[kind]}
        self._words = {w: (INSULT, SEED_WEIGHT) for w in SEEDS[INSULT]} | {w: (THREAT, SEED_WEIGHT) for w in SEEDS[THREAT]}
        self._words |= {w: (INSULT, weight) for w, weight in lexicon.words.items()}
        self._stems = dict(lexicon.stems)
        self._machine = ahocorasick.Automaton()
        for term in {*self._words, *self._stems}:
            self._machine.add_word(term, len(term))
        self._machine.make_automaton()
        self._coefficients = lexicon.coefficients
        self._moves, factors = composed(since(NEGATION, NEGATION_REACH, NEGATED), ever(REPORT, REPORTED), since(TARGET, TARGET_REACH, AIMED))
        self._scaled = [denied * quoted for denied, quoted, _ in factors]
        self._aimed = [aimed for *_, aimed in factors]

    def _output(self, word: str) -> tuple[str, float] | None:
        """Class and weight the lexicon gives a word: its own, or the heaviest stem's."""
        if word in self._words:
            return self._words[word]
        found = [self._stems[word[:n]] for n in STEM_LENGTHS if len(word) > n and word[:n] in self._stems]
        return (INSULT, max(found)) if found else None

    def clause(self, text: str) -> tuple[float, int]:
        """Weight of one lower-cased clause, and how many of its words scored."""
        state, waiting, score, hits = 0, 0.0, 0.0, 0
        for word in _WORDS.findall(text):
            kind, weight = self._class.get(word), 0.0
            if kind is None and (output := self._output(word)):
                kind, weight = output
            state = self._moves[state][_COLUMN[kind]]
            if kind == TARGET:
                # A target may follow what is aimed at it.
                score += waiting * (AIMED - 1)
                waiting = 0.0
            elif weight:
                hits += 1
                weight *= self._scaled[state]
                if self._aimed[state] != 1.0:
                    score += weight * AIMED
                elif kind == INSULT:
                    score += weight
                    waiting = weight
                else:
                    waiting = weight  # a threat needs a target
        return score, hits if score else 0

    def clauses(self, text: str | None) -> list[tuple[float, int]]:
        """Weights and hits of the clauses in which the lexicon machine matches."""
        lower = (text or "").lower()
        scores, end = [], -1
        marks, begin = _CLAUSE_END.finditer(lower), 0
        mark = next(marks, None)
        for last, length in self._machine.iter(lower):
            start = last - length + 1
            if start <= end or start and (lower[start - 1].isalpha()):
                continue
            # Clause ends are walked once, alongside the matches.
            while mark and mark.start() < start:
                begin, mark = mark.end(), next(marks, None)
            end = mark.start() if mark else len(lower)
            scores.append(self.clause(lower[begin:end]))
        return [s for s in scores if s[0]]

    def features(self, text: str | None) -> tuple[float, float, float]:
        found = self.clauses(text)
        return math.log1p(sum(s for s, _ in found)), max((s for s, _ in found), default=0.0), math.log1p(sum(n for _, n in found))

    def score(self, text: str | None) -> float:
        constant, *slopes = self._coefficients
        log_odds = constant + sum(a * x for a, x in zip(slopes, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))


def _terms(text: str | None) -> set[str]:
    """The words of a text, and their stems marked with a star."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


def _document_counts(rows: DataFrame) -> DataFrame:
    """Toxic and other documents per term; a few documents at a time are summed before their counts are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), COUNTED_DOCS):
                some = batch.iloc[start : start + COUNTED_DOCS]
                yes, no = Counter(), Counter()
                for text, label in zip(some["text"], some["label"]):
                    (yes if label else no).update(_terms(text))
                terms = list({**yes, **no})
                yield pd.DataFrame({"term": terms, "yes": [yes[t] for t in terms], "no": [no[t] for t in terms]}, columns=["term", "yes", "no"])

    counts = rows.select("text", "label").mapInPandas(count, "term string, yes bigint, no bigint")
    return counts.groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def learn(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """Terms and weights from at most ``rows`` labelled documents that are not held out.

    The logistic coefficients are fitted on scores each half of the sample gets from the terms of the other
    half, as terms look better on the documents they were chosen from.
    """
    sample = stored(labelled_sample(docs, labels, column, rows).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))))
    if sample.groupBy("half", "label").agg(F.count(F.lit(1))).count() < 4:
        return Lexicon()
    measured = []
    for half in (0, 1):
        words, stems = _weights(sample.where(F.col("half") != half))
        own = sample.where(F.col("half") == half)
        own = own.select("label", features(F.col("text"), Lexicon(words, stems)).alias("f")).select("label", "f.*")
        measured += [tuple(row) for row in own.collect()]
    words, stems = _weights(sample)
    return Lexicon(words, stems, _logistic(np.array(sorted(measured), float)))


def _weights(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of the words and of the stems that tell toxic documents from the others."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = stored(_document_counts(sample).where("yes >= 2"))
    # Only terms that pass are collected.
    pure = counts.where((F.col("yes") >= MIN_TOXIC_DOCS) & (F.col("yes") >= MIN_PURITY * (F.col("yes") + F.col("no"))))
    word, is_stem = F.col("term"), F.col("term").endswith("*")
    marked = [F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in STEM_LENGTHS]
    endings = counts.where(~is_stem).select(F.explode(F.array_compact(F.array(*marked))).alias("term"))
    endings = endings.groupBy("term").agg(F.count(F.lit(1)).alias("endings")).where(F.col("endings") >= MIN_ENDINGS)
    passed = pure.where(~is_stem).union(pure.where(is_stem).join(endings, "term", "left_semi"))
    words, stems = {}, {}
    for term, yes, no in sorted(map(tuple, passed.select("term", "yes", "no").collect())):
        weight = math.log((yes + 0.5) / (toxic + 1)) - math.log((no + 0.5) / (clean + 1))
        if term.endswith("*"):
            stems[term[:-1]] = weight
        else:
            words[term] = weight
    return words, stems


def _logistic(rows: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Newton's method for a few features and a constant."""
    x, y = np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0]
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -2, 2)
    return tuple(float(b) for b in beta)


def features(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("total double, worst double, hits double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        grammar = Grammar(lexicon)
        return pd.DataFrame([grammar.features(t) for t in texts], columns=["total", "worst", "hits"])

    return measured(text)


def score(text: Column, lexicon: Lexicon) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        grammar = Grammar(lexicon)
        return pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return scored(text)
