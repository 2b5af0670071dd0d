"""Toxicity scores of texts whose obfuscated words are restored first.

Restoring. Words are written in disguise by look-alike characters (``1d10t``), by letters
set apart (``i d i o t``, ``i.d.i.o.t``) and by repetition (``idiooot``). Such a span becomes
a lattice: each character has edges to the letters it may stand for, to nothing (a
separator), or to a repeat of the letter before, each with a channel cost. The path with the
smallest channel cost plus negative log probability under a trigram model of the corpus'
letters is found by Viterbi search over pairs of letters. A word of letters without two equal
neighbors has only one path, itself, and is taken as it is.

The letter model counts trigrams over all texts (28 ^ 3 numbers from each task).

Scoring. Features of a document are its distinct restored words and their first letters. A
bounded, balanced sample of labelled documents gives each feature a log-odds weight; those
that are significant for toxic documents form the lexicon, bounded by ``lexicon_rows``. A
feature needs a fixed number of toxic documents, whatever the size of the sample, and a G2
that grows with the number of features tested, so that less than one passes by chance. A
document's evidence is its largest weight plus the logarithm of its number of matches, and
a logistic curve in it, fitted to the sample at the labels' base rate, is the score.

Edges: null and empty texts have no evidence and get the score of that. Texts are taken
whole. Without labels of both kinds every score is the share of toxic labels (0 for none).
Repeated rows are scored one by one; rows with a null id are never trained on.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, stored, values

FOLDS, HELD_OUT = 5, 0
TOXIC_ROWS, OTHER_ROWS = 2000, 4000
LEXICON_ROWS = 20_000
LEAST_WEIGHT, LEAST_G2, LEAST_COUNT = 2.5, 14.0, 3
PREFIXES = (4, 5, 6)
MEMORY = 100_000
SPAN = 64

# Letters that look-alike characters stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "¢": "c", "#": "h", "?": "",
}
COST_LITERAL, COST_LOOKALIKE, COST_DROP, COST_REPEAT, COST_BREAK = 0.0, 0.7, 4.0, 2.0, 2.0
COST_SEPARATOR = 0.2
SEPARATORS = " .-_*,'~/\\"

_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
_EDGE = ".,;:!?\"'()[]{}…«»“”"
_MARK = f"[{re.escape(_EDGE)}]"
# A single character, or one between marks.
_SINGLE = rf"(?:{_MARK}*[^\s{re.escape(_EDGE)}]{_MARK}*|{_MARK})"
_SINGLES = re.compile(rf"(?<!\S){_SINGLE}(?:\s+{_SINGLE}){{2,}}(?!\S)")


def _base(ch: str) -> int:
    """Letter number 1 to 26, 27 for another letter, 0 for anything else."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if not ch.isalpha():
        return 0
    plain = unicodedata.normalize("NFD", ch)[0]
    return ord(plain) - 96 if "a" <= plain <= "z" else 27


_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _table
    if _table is None:
        _table = np.array([_base(chr(c).lower()[0]) for c in range(0x3000)], np.int32)
    return _table


def letter_trigrams(text: str) -> np.ndarray:
    """Counts of letter trigrams of a text, as one number below 28 ^ 3 each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[np.minimum(c, 0x2FFF)]
    x = np.concatenate([[0, 0], x, [0]])
    code = (x[:-2] * 28 + x[1:-1]) * 28 + x[2:]
    return np.bincount(code, minlength=28 ** 3)


def letter_model(docs: DataFrame) -> np.ndarray:
    """Negative log probability of each letter after two letters, from all texts."""

    def count(batches):
        total = np.zeros(28 ** 3, np.int64)
        for batch in batches:
            for text in values(batch.column(0)):
                if text:
                    total += letter_trigrams(text)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(
        F.sum("n").alias("n")).collect()
    n = np.zeros(28 ** 3)
    for r in rows:
        n[r.k] = r.n
    n = n.reshape(28, 28, 28)
    one = (n.sum((0, 1)) + 1) / (n.sum() + 28)
    two = (n.sum(0) + 4 * one) / (n.sum((0, 2)) + 4)[:, None]
    three = (n + 4 * two[None]) / (n.sum(2) + 4)[:, :, None]
    return -np.log(three)


def _edges(span: str, at: int) -> Iterable[tuple[str, float]]:
    """What a character may emit, with the cost; '' is nothing, ' ' the end of a word."""
    ch = span[at]
    if ch in SEPARATORS:
        yield "", COST_SEPARATOR
        yield " ", COST_BREAK
        return
    if _base(ch):
        yield ch, COST_LITERAL
        if at and span[at - 1] == ch:
            yield "", COST_REPEAT
    elif ch in LOOKALIKE:
        for letter in LOOKALIKE[ch]:
            yield letter, COST_LOOKALIKE
        yield "", COST_DROP
    else:
        yield "", COST_DROP


# What characters may emit, kept as (emitted, cost, letter number or None).
_choices: dict[tuple[str, bool], tuple[tuple[str, float, int | None], ...]] = {}
# The model last used and its numbers in a list, which single reads are quicker from.
_costs: tuple[np.ndarray | None, list[float]] = (None, [])


def _chosen(span: str, at: int) -> tuple[tuple[str, float, int | None], ...]:
    key = (span[at], at > 0 and span[at - 1] == span[at])
    found = _choices.get(key)
    if found is None:
        if len(_choices) > MEMORY:
            _choices.clear()
        found = _choices[key] = tuple(
            (e, cost, _base(e) if e else None) for e, cost in _edges(span, at))
    return found


def decode(span: str, model: np.ndarray) -> list[str]:
    """Words on the best path through the lattice of a lower-cased span."""
    global _costs
    if _costs[0] is not model:
        _costs = (model, model.ravel().tolist())
    costs = _costs[1]
    # A state is the last two letters, as one number; it keeps its cost and its text.
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for at in range(len(span)):
        chosen = _chosen(span, at)
        if len(chosen) == 1:
            (emitted, cost, letter), = chosen
            if letter is None:
                # The same states, each at the same cost more.
                states = {k: (total + cost, text) for k, (total, text) in states.items()}
                continue
            if len(states) == 1:
                (k, (total, text)), = states.items()
                states = {k % 28 * 28 + letter: (
                    total + cost + costs[k * 28 + letter], text + emitted)}
                continue
        new: dict[int, tuple[float, str]] = {}
        for emitted, cost, letter in chosen:
            for k, (total, text) in states.items():
                if letter is None:
                    key, value = k, total + cost
                else:
                    key, value = k % 28 * 28 + letter, total + cost + costs[k * 28 + letter]
                if key not in new or value < new[key][0]:
                    new[key] = (value, text + emitted)
        states = new
    best = min((total + costs[k * 28], text) for k, (total, text) in states.items())
    return best[1].split()


def restore(word: str, model: np.ndarray) -> list[str]:
    """Restored words of one lower-cased token without blanks."""
    core = word.strip(_EDGE)
    if core.isalpha() and not _DOUBLE.search(core):
        return [core]
    # A token longer than any word is restored piece by piece; pieces overlap by half, so
    # that a word over the end of one is whole in the next.
    pieces = [word[k:k + 2 * SPAN] for k in range(0, max(1, len(word) - SPAN), SPAN)]
    found = [w for p in pieces if any(map(str.isalpha, p)) for w in decode(p, model)]
    found += [_RUN.sub(r"\1", w) for w in found]
    found += [w for w in re.findall(r"[^\W\d_]+", word) if len(w) > 2]
    return found + [core] if core.isalpha() else found


def spaced(text: str, model: np.ndarray) -> list[str]:
    """Words hidden in runs of single characters with any white space between them; marks
    around a character are left out, long runs of one character are skipped over as one
    repeat."""
    out = []
    for m in _SINGLES.finditer(text):
        run = " ".join(c if len(c) == 1 else c.strip(_EDGE) for c in m.group().split())
        run = re.sub(r"(\S)(?: \1){2,}", r"\1 \1", run)
        for k in range(0, len(run), SPAN):
            out += decode(run[k:k + 2 * SPAN], model)
    return out


def word_features(word: str) -> list[str]:
    return [word] + [word[:n] + "~" for n in PREFIXES if len(word) > n]


def _listed(word: str, lexicon: dict[str, float]) -> bool:
    """Whether a feature of the word is in the lexicon."""
    return word in lexicon or any(
        len(word) > n and word[:n] + "~" in lexicon for n in PREFIXES)


def document_words(text: str | None, model: np.ndarray, memory: dict) -> set[str]:
    """Distinct restored words of a text; ``memory`` keeps what tokens restore to."""
    if not text:
        return set()
    low = text.lower()
    if len(memory) > MEMORY:
        memory.clear()
    out: set[str] = set()
    for token in set(low.split()):
        words = memory.get(token)
        if words is None:
            found = restore(token, model)
            words = memory[token] = found[0] if len(found) == 1 else tuple(found)
        if isinstance(words, str):
            out.add(words)
        else:
            out.update(words)
    out.update(spaced(low, model))
    return out


@dataclass
class Model:
    """Letter model, lexicon of weights, and the logistic curve in the evidence."""

    letters: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    intercept: float = -50.0

    def evidence(self, words: Iterable[str]) -> float:
        hits = [max((self.lexicon[f] for f in word_features(w) if f in self.lexicon),
                    default=0.0) for w in words]
        hits = [h for h in hits if h > 0]
        return max(hits) + math.log(len(hits)) if hits else 0.0

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, self.slope * evidence + self.intercept)))


def _sample(labels: DataFrame, toxic: int, rows: int) -> DataFrame:
    """Ids of at most ``rows`` labelled documents, those with the smallest hashes."""
    own = labels.where((F.col("toxic") == toxic) & F.col("doc_id").isNotNull())
    return own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        rows).withColumn("toxic", F.lit(toxic))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly penalised logistic regression."""
    w = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        h = (f * (weight * p * (1 - p))[:, None]).T @ f + np.diag([0.05, 1e-3])
        g = f.T @ (weight * (y - p)) - np.array([0.05, 1e-3]) * w
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT,
        toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS,
        lexicon_rows: int = LEXICON_ROWS) -> Model:
    """Model from the labels outside the held-out fold."""
    letters = letter_model(docs)
    known = labels.select("doc_id", "toxic").where(
        ~in_fold(F.col("doc_id"), folds, held_out) & F.col("doc_id").isNotNull())
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    if not yes or not no:
        return Model(letters, intercept=50.0 if yes else -50.0)
    sample = _sample(known, 1, toxic_rows).unionByName(_sample(known, 0, other_rows))
    # One row for an id that carries both labels; the ids are bounded by the parameters.
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Of rows that share an id the smallest text counts, whatever the order they come in.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(
        "doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def words(batches):
        memory: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(
                    [sorted(document_words(t, letters, memory))
                     for t in values(batch.column("text"))], pa.list_(pa.string()))],
                ["toxic", "words"])

    # Copies of a text tell no more than one.
    rows = stored(chosen.groupBy("text").agg(F.max("toxic").alias("toxic")).select(
        F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        words, "toxic int, words array<string>"))

    def features(batches):
        for batch in batches:
            out: list[tuple[str, int]] = []
            for toxic, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(f, toxic) for f in {f for w in ws for f in word_features(w)}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in out], pa.string()),
                 pa.array([t for _, t in out], pa.int32())], ["f", "toxic"])

    tables = stored(rows.mapInArrow(features, "f string, toxic int").groupBy("f").agg(
        F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).where(
        F.col("yes") >= LEAST_COUNT))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_yes, n_no = n.get(1, 0), n.get(0, 0)
    if not n_yes or not n_no:
        return Model(letters, intercept=math.log(yes / no))
    a, b = F.col("yes"), F.col("no")
    weight = F.log((a + 0.5) / (n_yes + 1)) - F.log((b + 0.5) / (n_no + 1))
    share = n_yes / (n_yes + n_no)
    g2 = 2 * (a * F.log(a / ((a + b) * share))
              + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    # The tail of G2 beyond 2 log(m) is less than 1 / m.
    least_g2 = max(LEAST_G2, 2 * math.log(max(tables.count(), 1)))
    strong = tables.select("f", weight.alias("w"), g2.alias("g2"))
    strong = strong.where((F.col("w") >= LEAST_WEIGHT) & (F.col("g2") >= least_g2))
    lexicon = {r.f: r.w for r in strong.orderBy(F.desc("g2"), "f").limit(lexicon_rows).collect()}
    model = Model(letters, lexicon)
    if not lexicon:
        model.intercept = math.log(yes / no)
        return model

    def evidence(batches):
        for batch in batches:
            found = [model.evidence(ws) for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], ["toxic", "x"])

    seen = rows.mapInArrow(evidence, "toxic int, x double").collect()
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float)
    rate = yes / (yes + no)
    each = np.where(y == 1, rate / n_yes, (1 - rate) / n_no) * len(y)
    model.slope, model.intercept = _curve(x, y, each)
    return model


def toxic_score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column."""

    memory: dict = {}  # each task unpickles its own
    hit: dict[str, bool] = {}

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in values(texts):
            words = document_words(text, model.letters, memory)
            new = [w for w in words if w not in hit]
            for w in new:
                hit[w] = _listed(w, model.lexicon)
            out.append(model.score(model.evidence([w for w in words if hit[w]])))
            if len(hit) > MEMORY:
                hit.clear()
        return pa.array(out, pa.float64())

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    model = fit(rows, labels, **options)
    held = in_fold(F.col("doc_id"), options.get("folds", FOLDS),
                   options.get("held_out", HELD_OUT))
    scored = rows.select("doc_id", held.alias("held_out"),
                         toxic_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
