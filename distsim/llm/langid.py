"""Language identification by sparse multinomial logistic regression on character n-grams.

Texts are lower-cased, everything but letters becomes one space, and runs of one to three
characters are hashed into ``BUCKETS`` buckets. Features are (1 + ln count) * idf, scaled to
length one. Document frequencies are counted over all documents, one vector of buckets per
task. The classifier is fitted by FTRL-proximal steps with l1 and l2 penalties (McMahan et
al., "Ad Click Prediction: a View from the Trenches", 2013) on a bounded sample:
``per_class`` rows of each language, those with the smallest hash of their id. A fifth of
the sample is kept out of the steps and sets the temperature that scales the scores.

What the driver holds is bounded by parameters: buckets x languages weights and the sample's
hashed features, at most ``per_class`` rows of a language and about ``sample_rows`` in all, dealt
evenly if languages are many. Every label is learned.

Edges: a null text, or one without a letter, is ``und`` with score 0. Rows with a null id
are never trained on. Without any labelled row everything is ``und``. Repeated rows get the
same answer.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold, small, stored, values

BUCKETS = 1 << 15
UNKNOWN = "und"
PER_CLASS = 500
SAMPLE_ROWS = 128_000
FOLDS, HELD_OUT = 4, 2
CHUNK = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the n-grams of a text, or None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, 32)[keep].astype(np.uint32)
    c = np.concatenate([np.array([32], np.uint32), c])
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(c), CHUNK):  # two characters of overlap between chunks
        x = c[max(0, at - 2):at + CHUNK]
        new = at - max(0, at - 2)
        code = x * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                code = code ^ (x[n - 1:] * np.uint32(0xC2B2AE35))
            first = max(0, new - (n - 1))
            total += np.bincount(code[first:] * np.uint32(0x27D4EB2F) >> np.uint32(17),
                                 minlength=BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets.astype(np.int32), total[buckets].astype(np.int32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents with a letter, over all rows."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in values(batch.column(0)):
                if (found := counts(text)) is not None:
                    df[found[0]] += 1
                    n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["b", "n"])

    rows = docs.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(
        F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r.b < 0:
            n = r.n
        else:
            df[r.b] = r.n
    return df, n


@dataclass
class Model:
    """Languages, weights (languages x buckets), biases, idf and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, buckets: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights[:, buckets] @ features(buckets, n, self.idf) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        z = self.logits(*found) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def features(buckets: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Scaled TF-IDF values of a document's buckets."""
    x = (1.0 + np.log(n)) * idf[buckets]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 1.0,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 5
         ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from rows (buckets, values, class) by FTRL-proximal steps."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(at):
        za, na = z[:, at], n[:, at]
        shrunk = np.sign(za) * np.maximum(np.abs(za) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(na)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            buckets, x, y = rows[k]
            at, x = np.append(buckets, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * x[None, :]
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - step * w
            n[:, at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:, :BUCKETS].astype(np.float32), w[:, BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss, by golden section on its log."""
    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    low, high, g = math.log(0.02), math.log(50.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(docs: DataFrame, *, per_class: int = PER_CLASS, sample_rows: int = SAMPLE_ROWS,
        folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> Model:
    """Model from ``docs`` (doc_id, text, lang), trained outside the held-out fold."""
    df, n = document_frequencies(docs)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(
        ~in_fold(F.col("doc_id"), folds, held_out))
    langs = stored(usable.groupBy("lang").count())
    languages = sorted(r.lang for r in langs.select("lang").collect())
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), idf)
    # A threshold on the hash leaves about three times the rows wanted of each language, so
    # that ranking sees only those, whatever the size of the input.
    per_class = max(1, min(per_class, sample_rows // len(languages)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    limit = F.least(F.lit(1 << 40), F.floor(F.lit(float(3 * per_class << 40)) / F.col("count")))
    limits = small(langs.select("lang", limit.cast("long").alias("share")))
    by_hash = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ids = usable.select("doc_id", "lang", draw.alias("draw")).join(limits, "lang").where(
        "draw < share")
    chosen = ids.withColumn("k", F.row_number().over(by_hash)).where(
        F.col("k") <= per_class).groupBy("doc_id").agg(F.min("k").alias("k"))

    def featurize(batches):
        for batch in batches:
            for lang, text in zip(values(batch.column("lang")), values(batch.column("text"))):
                if (found := counts(text)) is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([found[0].tobytes()]),
                         pa.array([found[1].tobytes()])], ["lang", "b", "n"])

    # The ids are bounded by sample_rows, so they may be broadcast; repeated rows of one id
    # count once, with the smallest text.
    picked = usable.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    picked = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    seen = picked.select("lang", "text").mapInArrow(
        featurize, "lang string, b binary, n binary").collect()
    by_lang = defaultdict(list)
    for r in sorted(seen, key=lambda r: (r.lang, bytes(r.b), bytes(r.n))):
        b, c = np.frombuffer(r.b, np.int32), np.frombuffer(r.n, np.int32)
        by_lang[r.lang].append((b, features(b, c, idf), languages.index(r.lang)))
    train, rest = [], []
    for rows in by_lang.values():
        for k, row in enumerate(rows):
            (rest if k % 5 == 4 else train).append(row)
    if not train:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), idf)
    weights, bias = ftrl(train, len(languages), **options)
    model = Model(languages, weights, bias, idf)
    if rest and len(languages) > 1:
        z = np.array([weights[:, b] @ x + bias for b, x, _ in rest])
        model.temperature = temperature(z, np.array([y for *_, y in rest]))
    return model


def language(text: Column, model: Model) -> Column:
    """Struct (lang, score) of a text column."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t) for t in values(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()),
             pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows, **options)
    folds = options.get("folds", FOLDS)
    held = in_fold(F.col("doc_id"), folds, options.get("held_out", HELD_OUT))
    found = rows.select("doc_id", held.alias("held_out"),
                        language(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"))
