import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from distsim.llm import brown

DOC = "doc_id long, text string"
SMALL = {"classes": 6, "core": 40, "groups": 16, "dictionary": 60, "rounds": 6}


def corpus():
    rng = random.Random(8)
    one, two = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w = [rng.choice((one, two)[(i + k) % 2]) for k in range(rng.randint(0, 40))]
        w += [f"rare{rng.randint(0, 400)}" for _ in range(rng.randint(0, 2))]
        rows.append((i, (" ".join(w)).upper() if i % 7 == 0 else "\n".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (None, "a1 b1"), (5, rows[5][1]),
                   (1003, "A1 b2 " * 5000), (1004, "Ünseen É")]


def words(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in corpus()], DOC + ", score int, c int")
    return brown.class_model_scores(docs, **SMALL).collect()


def test_base_columns_equal_brute_force(scored):
    c = Counter()
    for i, t in corpus():
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    assert len(scored) == len(corpus())
    texts = {i: t for i, t in corpus()}
    for r in scored:
        w = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert r.base_score == pytest.approx(base)
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0
        assert r.held_out == held


def test_classes_beat_the_base_on_held_out_texts(scored):
    held = [r for r in scored if r.held_out]
    assert len(held) > 10
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 1
    assert all(r.score <= 0 and math.isfinite(r.score) for r in scored)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[0] is not None], DOC)
    model, vocabulary = brown.fit(docs, **SMALL)
    assert np.allclose((10 ** model.log_transition).sum(1), 1)
    total = 10 ** model.log_unknown
    for r in vocabulary.collect():
        if r.word != b"":
            k = model.of[model.units.of([bytes(r.word)])]
            total[k] += 10 ** model.log_word(np.array([r.c]), k)
    used = model.class_total[:-1] > 0
    assert np.allclose(total[:-1][used], 1)


def test_score_is_the_sum_of_the_parts(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[0] is not None], DOC)
    model, vocabulary = brown.fit(docs, **SMALL)
    c = {bytes(r.word): r.c for r in vocabulary.collect()}
    rows = docs.selectExpr("doc_id", "false AS held_out", "text")
    texts = dict(corpus())
    for r in brown.score(rows, model, vocabulary).collect():
        w = words(texts[r.doc_id])[:-1]
        end = model.width - 1
        k = model.of[model.units.of(w)] if w else np.zeros(0, int)
        path = [end, *k, end]
        expected = sum(model.log_transition[a, b] for a, b in zip(path, path[1:]))
        expected += sum(float(model.log_word(np.array([c.get(x, 0)]), np.array([j]))[0])
                        for x, j in zip(w, k))
        assert r.score == pytest.approx(expected)


def test_exchange_raises_the_likelihood(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[0] is not None], DOC)
    vocabulary = brown.word_counts(docs)
    listed, _ = brown.frequent(vocabulary, 60)
    units = brown.Units(listed[:40], 16)
    pairs = brown.neighbor_counts(docs, units)
    start = np.append(np.arange(units.end) % 6, 6)
    of, counts = brown.exchange(pairs, units, classes=6, rounds=6, tasks=4)
    assert brown.likelihood(counts) > brown.likelihood(brown.class_counts(pairs, start, 7))
    assert (brown.class_counts(pairs, of, 7) == counts).all()
    assert of[-1] == 6 and (of[:-1] < 6).all()


def test_units_grow_with_the_corpus_and_rounds_go_on(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(60)))
            for i in range(600)]
    sizes = []
    for n in (150, 600):
        docs = spark.createDataFrame(rows[:n], DOC)
        model, vocabulary = brown.fit(docs, classes=8, core=10, least=20, groups=4)
        many = {bytes(r.word) for r in vocabulary.where("c >= 20 AND word <> X''").collect()}
        assert many <= set(model.units.core)
        sizes.append(len(model.units.core))
    assert sizes[1] > 2 * sizes[0] > 20
    pairs = brown.neighbor_counts(docs, model.units)
    few, until = (brown.likelihood(brown.exchange(pairs, model.units, classes=8, rounds=r)[1])
                  for r in (2, None))
    assert until > few


def test_best_class_agrees_with_the_likelihood():
    rng = np.random.default_rng(0)
    for _ in range(20):
        rest = rng.integers(0, 30, (5, 5)).astype(float)
        left, right = rng.integers(0, 9, 5).astype(float), rng.integers(0, 9, 5).astype(float)

        def joined(b):
            n = rest.copy()
            n[:, b] += left
            n[b, :] += right
            return n

        # Row and column of a class overlap in one cell, where the gain is approximate.
        best = brown.best_class(joined(0), 0, left, right)
        values = [brown.likelihood(joined(b)) for b in range(4)]
        assert values[best] >= max(values) - 12


def test_no_training_rows_and_no_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = brown.class_model_scores(
        spark.createDataFrame([(i, "a b") for i in held], DOC), **SMALL).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0, 0)}
    assert brown.class_model_scores(spark.createDataFrame([], DOC), **SMALL).count() == 0
