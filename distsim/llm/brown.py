"""Class-based bigram language model with classes from exchange clustering.

P(text) is the product over tokens of P(class | class before) * P(word | class) (Brown et
al., "Class-Based n-gram Models of Natural Language", 1992). Tokens are the lower-cased
words of a text and one end; the end is a class of its own and also starts a text.

Clustering. All words of the dictionary with at least ``least`` tokens, a set that grows with
the corpus, and in any case the ``core`` most frequent words are units that are exchanged, as
are ``groups`` groups of all other words by a hash of their last letters; the model so has a
class for any word. Counts of neighboring units are taken once over the whole corpus. In each
round every unit, taken out of its class, finds the class that raises the likelihood most,
against the counts of the round before; half of the units move, as in distributed exchange
clustering (Uszkoreit and Brants, 2008). Rounds go on until ``IDLE`` of them in a row do not
raise the likelihood by a ``SETTLED`` part of its rise so far. Units are dealt to tasks by
number, more tasks for more pairs; the driver holds one class per unit, at most
``dictionary`` and ``groups``, and the class-by-class counts.

Probabilities. Transitions are smoothed by the class unigram. Word counts are discounted
absolutely, and what a class's words give up is its probability of an unknown word; so the
probabilities of the known words and of an unknown one sum to one.

Words. The corpus vocabulary has no bound, so it stays a table. The ``dictionary`` most
frequent words, a bounded set, go to every worker; the other words of a slice of texts,
each once, meet the table in buckets by word. Pairs of units are packed by task once, so the
rounds of the exchange shuffle nothing.

Edges: a null text is an empty one, that is, one end. Rows with a null id are not held out
and not trained on. Without training rows the model knows nothing and every text scores 0.
Repeated rows are scored one by one.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, stored, values
from .repeats import _loosen, _packed, _parts, _slices, _squeeze, _unpacked

CLASSES = 64
CORE = 8192
LEAST = 1000
GROUPS = 1024
DICTIONARY = 1 << 18
SETTLED, IDLE = 1e-3, 4
TASK_PAIRS = 500_000
FOLDS, HELD_OUT = 10, 0
PRIOR = 5.0
FLUSH = 200_000
SLICE_BYTES = 8 << 20
BUCKET_WORDS = 200_000


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shape(word: bytes, groups: int) -> int:
    """Group of a word by its last letters."""
    return zlib.crc32(word[-3:]) % groups


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all texts, stored; the end of a text is the empty word."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())],
                ["word", "c"])

        for batch in batches:
            for text in values(batch.column(0)):
                seen.update(tokens(text))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    found = texts.select("text").mapInArrow(count, "word binary, c long")
    return stored(found.groupBy("word").agg(F.sum("c").alias("c")))


def frequent(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``most`` of the most frequent words with counts, in order of frequency.

    The cut is a step on a logarithmic scale of counts, found from a histogram.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    real = vocabulary.where(F.length("word") > 0).withColumn("step", step)
    total, cut = 0, None
    for r in sorted(real.groupBy("step").count().collect(), key=lambda r: -r.step):
        total += r["count"]
        if total > most:
            break
        cut = r.step
    if cut is None:
        return [], np.zeros(0, np.int64)
    rows = real.where(F.col("step") >= cut).select("word", "c").toPandas()
    rows = rows.assign(word=rows["word"].map(bytes)).sort_values(
        ["c", "word"], ascending=[False, True])
    return rows["word"].tolist(), rows["c"].to_numpy(np.int64)


class Units:
    """Unit numbers: core words first, then the groups, then the end."""

    def __init__(self, core: list[bytes], groups: int):
        self.core, self.groups = core, groups
        self.end = len(core) + groups
        self.index = {w: k for k, w in enumerate(core)}

    def of(self, words: list[bytes]) -> np.ndarray:
        get, n, g = self.index.get, len(self.core), self.groups
        found = [get(w, -1) for w in words]
        return np.array([u if u >= 0 else n + shape(w, g) for u, w in zip(found, words)],
                        np.int64)


def neighbor_counts(texts: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a."""
    size = units.end + 1

    def count(batches):
        kept: list[np.ndarray] = []
        held = 0

        def rows():
            code, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in batches:
            for text in values(batch.column(0)):
                u = np.concatenate([[units.end], units.of(tokens(text)), [units.end]])
                kept.append(u[:-1] * size + u[1:])
                held += len(u)
                if held > 20 * FLUSH:
                    yield rows()
                    kept.clear()
                    held = 0
        if kept:
            yield rows()

    pairs = texts.select("text").mapInArrow(count, "code long, n long")
    pairs = pairs.groupBy("code").agg(F.sum("n").alias("n"))
    return pairs.select(F.expr(f"code div {size}").cast("int").alias("a"),
                        (F.col("code") % size).cast("int").alias("b"), "n")


def class_counts(pairs: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class b after class a."""

    def arrays(batches):
        for batch in batches:
            yield tuple(batch.column(k).to_numpy() for k in range(3))

    return _class_sums_of(pairs.select("a", "b", "n"), arrays, of, classes)


def _class_sums_of(df: DataFrame, arrays, of: np.ndarray, classes: int) -> np.ndarray:
    """Class counts from the pairs (a, b, n) that ``arrays`` finds in the batches of ``df``."""

    def count(batches):
        total = np.zeros(classes * classes, np.int64)
        for a, b, n in arrays(batches):
            np.add.at(total, of[a] * classes + of[b], n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rows = df.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(classes * classes, np.int64)
    for r in rows.collect():
        out[r.k] = r.n
    return out.reshape(classes, classes)


def _by_task(pairs: DataFrame, tasks: int) -> DataFrame:
    """(task, pairs), stored: the pairs of a task's units, either way, packed in one value.

    A round reads these rows as they lie; nothing is shuffled again.
    """

    def pack(table: pa.Table) -> pa.Table:
        u, v, side, n = (table.column(c).to_numpy() for c in ("u", "v", "side", "n"))
        order = np.lexsort((v, side, u))
        blob = _packed(u[order].astype(np.int32), v[order].astype(np.int32),
                       side[order].astype(np.uint8), n[order].astype(np.int64))
        return pa.table({"task": table.column("task")[:1], "pairs": pa.array([blob], pa.binary())})

    ways = F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("side"), "n"),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(0).alias("side"), "n")))
    both = pairs.select(ways.alias("x")).select("x.*", (F.col("x.u") % tasks).alias("task"))
    return stored(both.groupBy("task").applyInArrow(pack, "task int, pairs binary"))


def _pairs_of(batch: pa.RecordBatch):
    """(u, v, side, n) of each row of :func:`_by_task`."""
    for blob in batch.column("pairs"):
        yield _unpacked(blob.as_py(), np.int32, np.int32, np.uint8, np.int64)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """What the classes add to the corpus log-likelihood."""
    n = n.astype(float)
    return float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())


def best_class(n: np.ndarray, own: int, left: np.ndarray, right: np.ndarray) -> int:
    """Class to which a unit with these neighbor counts by class should belong."""
    n = n.astype(float).copy()
    n[:, own] = np.maximum(n[:, own] - left, 0)
    n[own, :] = np.maximum(n[own, :] - right, 0)
    gain = (_f(n + left[:, None]) - _f(n)).sum(0) + (_f(n + right[None, :]) - _f(n)).sum(1)
    for sums, more in ((n.sum(0), left.sum()), (n.sum(1), right.sum())):
        gain = gain - (_f(sums + more) - _f(sums))
    gain[-1] = -np.inf  # the end is alone in its class
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 else own


def _mover(of: np.ndarray, counts: np.ndarray, width: int, tasks: int, half: int):
    """Function of tasks' neighbor counts: new classes of every other of their units."""
    end = len(of) - 1

    def move(batches):
        for u, v, side, n in (x for batch in batches for x in _pairs_of(batch)):
            some = (u != v) & (u != end)
            ids, at = np.unique(u[some], return_inverse=True)
            place = (at * 2 + side[some]) * width + of[v[some]]
            seen = np.bincount(place, n[some], 2 * len(ids) * width).reshape(len(ids), 2, width)
            turn = np.flatnonzero((ids // tasks) % 2 == half)
            new = [best_class(counts, int(of[ids[i]]), seen[i, 0], seen[i, 1]) for i in turn]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[turn], pa.int64()), pa.array(new, pa.int64())], ["u", "c"])

    return move


def exchange(pairs: DataFrame, units: Units, *, classes: int = CLASSES,
             rounds: int | None = None, tasks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class-by-class counts); the last class is the end's.

    Without ``rounds`` there are as many as raise the likelihood.
    """
    tasks = tasks or max(64, 2 * pairs.count() // TASK_PAIRS)
    of = np.append(np.arange(units.end) % classes, classes).astype(np.int64)
    packed = _by_task(pairs, tasks)

    def followers(batches):
        for u, v, side, n in (x for batch in batches for x in _pairs_of(batch)):
            yield u[side == 1], v[side == 1], n[side == 1]

    counts = _class_sums_of(packed, followers, of, classes + 1)
    start = likelihood(counts)
    best, idle, k = (start, of, counts), 0, 0
    while idle < IDLE and (rounds is None or k < rounds):
        move = _mover(of, counts, classes + 1, tasks, k % 2)
        new = of.copy()
        for r in packed.mapInArrow(move, "u long, c long").collect():
            new[r.u] = r.c
        k += 1
        of, counts = new, _class_sums_of(packed, followers, new, classes + 1)
        value = likelihood(counts)
        rises = value - best[0] > SETTLED * (best[0] - start)
        idle = 0 if rises else idle + 1
        if value > best[0]:
            best = (value, of, counts)
    return best[1], best[2]


class Model:
    """Everything a worker needs to score a text but the counts of rare words."""

    def __init__(self, words, counts, units, of, transitions, classes, vocabulary):
        """``vocabulary`` is the table of all words; it is read for the sums by class."""
        self.units, self.of, self.width = units, of, classes + 1
        self.words, self.counts = words, counts
        sums = self._class_sums(vocabulary)
        self.total = int(sums[0].sum())
        self.distinct = int(sums[1].sum())
        ones, twos = sums[2].sum(), sums[3].sum()
        self.discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
        self.class_total, self.class_words = sums[0], sums[1]
        n = transitions.astype(float)
        first = (n.sum(0) + 0.5) / (n.sum() + 0.5 * self.width)
        self.log_transition = np.log10(
            (n + PRIOR * first[None, :]) / (n.sum(1, keepdims=True) + PRIOR))
        mass = self.class_total.astype(float)
        unknown = np.where(mass > 0, self.discount * self.class_words / np.maximum(mass, 1), 1.0)
        self.log_unknown = np.log10(np.maximum(unknown, 1e-12))

    def _class_sums(self, vocabulary: DataFrame) -> np.ndarray:
        """By class: tokens, distinct words, words seen once, words seen twice."""
        units, of, width = self.units, self.of, self.width

        def add(batches):
            out = np.zeros((4, width), np.int64)
            for batch in batches:
                words = batch.column(0).to_pylist()
                c = batch.column(1).to_numpy()
                k = of[np.where([w == b"" for w in words], units.end, units.of(words))]
                for row, value in enumerate((c, np.ones_like(c), c == 1, c == 2)):
                    np.add.at(out[row], k, value.astype(np.int64))
            flat = out.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "n"])

        out = np.zeros(4 * width, np.int64)
        rows = vocabulary.select("word", "c").mapInArrow(add, "k long, n long")
        for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect():
            out[r.k] = r.n
        return out.reshape(4, width)

    def log_word(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word | class) from the word's count."""
        known = np.log10(np.maximum(c - self.discount, 1e-9) / np.maximum(self.class_total[k], 1))
        return np.where(c > 0, known, self.log_unknown[k])

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def fit(texts: DataFrame, *, classes: int = CLASSES, core: int = CORE, least: int = LEAST,
        groups: int = GROUPS, dictionary: int = DICTIONARY,
        rounds: int | None = None) -> tuple[Model, DataFrame]:
    """(model, vocabulary table) learned from the column ``text``."""
    vocabulary = word_counts(texts)
    words, counts = frequent(vocabulary, dictionary)
    units = Units(words[:max(core, int((counts >= least).sum()))], groups)
    pairs = neighbor_counts(texts, units)
    # There are no more different pairs than tokens.
    total = int(vocabulary.agg(F.sum("c")).first()[0] or 0)
    of, transitions = exchange(pairs, units, classes=classes, rounds=rounds,
                               tasks=max(64, 2 * total // TASK_PAIRS))
    return Model(words, counts, units, of, transitions, classes, vocabulary), vocabulary


_PARTS = "batch string, bucket long, parts array<binary>"


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every row of ``docs``.

    ``docs`` has doc_id, held_out and text. A slice of documents is scored at once but for its
    words outside the dictionary; these, each once, are dealt by word and meet the vocabulary
    there, and the slice is told their counts. Ids travel with the scores.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    ends, least = int(model.class_total[-1]), int(model.counts[-1]) if len(model.counts) else None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                  model.distinct // BUCKET_WORDS)
    total, distinct, discount = model.total, model.distinct, model.discount
    class_total, log_unknown = np.maximum(model.class_total, 1), model.log_unknown

    def run(batches):
        m = shared.value
        index = {w: k for k, w in enumerate(m.words)}
        c = np.append(m.counts, 0)
        k_of = np.append(m.of[m.units.of(m.words)], 0) if m.words else np.zeros(1, np.int64)
        base, word = m.log_base(c), m.log_word(c, k_of)
        base[-1] = word[-1] = 0.0
        end_base = float(m.log_base(np.array([ends]))[0])
        get, end, n_core, g = index.get, m.width - 1, len(m.units.core), m.units.groups
        for batch in (x for whole in batches for x in _slices(whole, "text", SLICE_BYTES)):
            columns: list[list] = [[] for _ in range(5)]
            numbers: dict[bytes, int] = {}
            classes: list[int] = []
            rare: list[int] = []
            for text in values(batch.column("text")):
                ws = tokens(text)
                at = np.array([get(w, -1) for w in ws], np.int64)
                k = k_of[at] if len(at) else at
                missing = np.flatnonzero(at < 0)
                for i in missing:
                    w = ws[i]
                    if w not in numbers:
                        numbers[w] = len(classes)
                        classes.append(int(m.of[n_core + shape(w, g)]))
                    rare.append(numbers[w])
                    k[i] = classes[rare[-1]]
                path = np.concatenate([[end], k, [end]])
                for column, x in zip(columns, (
                        len(ws) + 1, len(ws) - len(missing) + (ends > 0), len(missing),
                        float(base[at].sum()) + end_base,
                        float(word[at].sum() + m.log_transition[path[:-1], path[1:]].sum()))):
                    column.append(x)
            ids = batch.column("doc_id")
            name = uuid.uuid4().hex
            whole = [_packed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                             ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                             batch.column("held_out").to_numpy(
                                 zero_copy_only=False).astype(np.uint8),
                             *(np.array(x, t) for x, t in zip(columns, (np.int64,) * 3 + (float,) * 2))),
                     _packed(np.array(rare, np.uint32)), _packed(np.array(classes, np.uint16))]
            words = list(numbers)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64,
                                 len(words)).view(np.int64)
            which, parts = [], []
            for b, part in _parts(hashes % buckets):
                some = [words[i] for i in part]
                which.append(b)
                parts.append([_packed(np.array([len(w) for w in some], np.uint32),
                                      part.astype(np.uint32)), _squeeze(b"".join(some))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(which) + 1)), pa.array([None, *which], pa.int64()),
                 pa.array([whole, *parts], pa.list_(pa.binary()))], ["batch", "bucket", "parts"])

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        counts = dict(zip(known.column("word").to_pylist(), known.column("c").to_pylist()))
        told, blobs = [], []
        for name, (sizes, text) in zip(asked.column("batch").to_pylist(),
                                       asked.column("parts").to_pylist()):
            size, number = _unpacked(sizes, np.uint32, np.uint32)
            text, to = _loosen(text), np.cumsum(size, dtype=np.int64).tolist()
            c = np.fromiter((counts.get(text[a:b], 0) for a, b in zip([0, *to], to)), np.int64,
                            len(size))
            if (c > 0).any():
                told.append(name)
                blobs.append(_packed(number[c > 0], c[c > 0]))
        return pa.table({"batch": pa.array(told, pa.string()),
                         "counts": pa.array(blobs, pa.binary())})

    def finish(batches):
        for batch in batches:
            for parts, told in zip(batch.column("parts"), batch.column("counts")):
                whole, rare, classes = parts.as_py()
                ids, valid, held, n_tokens, n_known, n_rare, base, model_ = _unpacked(
                    whole, np.int64, np.uint8, np.uint8, *(np.int64,) * 3, *(float,) * 2)
                rare, k = _unpacked(rare, np.uint32)[0], _unpacked(classes, np.uint16)[0]
                c = np.zeros(len(k), np.int64)
                for blob in told.as_py() or []:
                    number, found = _unpacked(blob, np.uint32, np.int64)
                    c[number] = found
                by_word = np.where(c > 0, np.log10(np.maximum(c - discount, 1e-9) / class_total[k]),
                                   log_unknown[k])
                by_base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
                of = np.repeat(np.arange(len(ids)), n_rare)
                more = [np.bincount(of, x[rare], len(ids)) for x in (c > 0, by_base, by_word)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=valid == 0), pa.array(held.astype(bool)),
                     pa.array(n_tokens), pa.array(n_known + more[0].astype(np.int64)),
                     pa.array(base + more[1]), pa.array(model_ + more[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    found = stored(rows.mapInArrow(run, _PARTS))
    # The dictionary has all words that are more frequent.
    others = vocabulary.where(F.length("word") > 0)
    if least is not None:
        others = others.where(F.col("c") < least)
    others = others.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    asked = found.where("bucket IS NOT NULL").groupBy("bucket")
    told = asked.cogroup(others.groupBy("bucket")).applyInArrow(
        look_up, "batch string, counts binary")
    told = told.groupBy("batch").agg(F.collect_list("counts").alias("counts"))
    scored = found.where("bucket IS NULL").join(told, "batch", "left").select(
        "parts", "counts").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
                "model double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("model") if total else F.lit(0.0)).alias("score"))


def class_model_scores(docs: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT,
                       **options) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by a model of the rows not held out."""
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"),
                       "text")
    train = rows.where("doc_id IS NOT NULL AND NOT held_out")
    model, vocabulary = fit(train, **options)
    return score(rows, model, vocabulary)
