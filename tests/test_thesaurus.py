import math
import random

import pytest
from golden import CORPUS, lines

import distsim as ds

THESAURUS = "target string, neighbor string, cosine double"
FREQ = "word string, freq double"
TRIGRAM = "w_prev string, w string, w_next string, n long"


@pytest.fixture(scope="module")
def golden(spark):
    counted = ds.pair_counts(ds.bigram_pairs(lines(spark, CORPUS)))
    return ds.thesaurus(ds.similarity(counted, sim_min=0.1))


def sentences(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "sentence string")


def evaluate(spark, thesaurus, freqs, trigrams, texts, words, **options):
    return [
        (r.target, r.neighbor, r.score)
        for r in ds.evaluate_thesaurus(
            thesaurus, spark.createDataFrame(freqs, FREQ),
            spark.createDataFrame(trigrams, TRIGRAM), sentences(spark, texts), words, **options,
        ).collect()
    ]


def test_golden_scores(spark, golden):
    text = ["she saw the cat drinks milk"]
    matching = [("the", "dog", "drinks", 1)]
    [row] = evaluate(spark, golden, [("dog", 4.0)], matching, text, "cat")
    assert row[:2] == ("cat", "dog") and row[2] == pytest.approx(1.5388836167, abs=1e-9)
    [row] = evaluate(spark, golden, [("dog", 4.0)], [("a", "dog", "eats", 1)], text, "cat")
    assert row[2] == pytest.approx(0.8457364361, abs=1e-9)


def test_frequency_zero_and_missing(spark, golden):
    [row] = evaluate(spark, golden, [("dog", 0.0)], [("x", "x", "x", 1)], ["a cat b"], "cat")
    assert row[2] == -math.inf
    assert evaluate(spark, golden, [("cow", 1.0)], [("x", "x", "x", 1)], ["a cat b"], "cat") == []


def test_reduced_thesaurus_ranks_with_ties_by_neighbor(spark):
    rows = [("a", f"n{i}", 0.5 if i < 5 else 0.9) for i in range(8)] + [("b", "x", 0.1)]
    df = spark.createDataFrame(rows, THESAURUS)
    top = [r.neighbor for r in ds.reduced_thesaurus(df, "a", 5).orderBy("neighbor").collect()]
    assert top == ["n0", "n1", "n5", "n6", "n7"]
    assert ds.reduced_thesaurus(df, ["a", "b"], 2).count() == 3
    assert ds.reduced_thesaurus(df, None, 1).count() == 2
    words = spark.createDataFrame([("b",), ("b",)], "target string")
    assert [r.neighbor for r in ds.reduced_thesaurus(df, words).collect()] == ["x"]


def test_reduced_thesaurus_rounds_to_six_decimals(spark):
    df = spark.createDataFrame([("a", "b", 0.12345678), ("a", "c", 0.1234566)], THESAURUS)
    assert {r.cosine for r in ds.reduced_thesaurus(df, "a").collect()} == {0.123457}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("cat sat", ("", "cat", "")),
        ("concat it", ("", "cat", "")),
        ("a cat", ("a", "cat", "")),
        ("A cat Sat cat x", ("a", "cat", "sat")),
        ("dog", None),
    ],
)
def test_sentence_contexts(spark, text, expected):
    rows = [tuple(r)[1:] for r in ds.sentence_contexts(sentences(spark, [text]), "cat").collect()]
    assert rows == ([expected] if expected else [])


def test_strict_contexts(spark):
    df = sentences(spark, ["cat sat", "concat it", "a cat"])
    rows = [tuple(r)[1:] for r in ds.sentence_contexts(df, "cat", strict_context=True).collect()]
    assert sorted(rows) == [("", "cat", "sat"), ("a", "cat", "")]


def test_neighbor_frequencies_multiply_and_sort(spark):
    reduced = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.4), ("a", "z", 0.3)], THESAURUS)
    freqs = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.0)], FREQ)
    rows = ds.neighbor_frequencies(reduced, freqs, sort=True).collect()
    assert sorted((r.neighbor, r.freq) for r in rows) == [("x", 1.0), ("x", 3.0), ("y", 2.0)]


def model(thesaurus, freqs, trigrams, contexts, word, size, dedupe):
    """Row by row: one trigram row per matching left and per matching right context."""
    reduced = sorted((r for r in thesaurus if r[0] == word), key=lambda r: (-r[2], r[1]))[:50]
    names = {r[1] for r in reduced}
    matches = [
        t for t in trigrams if t[1] in names
        for left in contexts if left[0] == t[0]
        for right in contexts if right[1] == t[2]
    ]
    scored = []
    for _, neighbor, cosine in reduced:
        for w, freq in freqs:
            if w != neighbor:
                continue
            base = math.log(freq) / 10
            hits = [m for m in matches if m[1] == neighbor]
            for m in hits:
                scored.append((word, neighbor, cosine + math.log(m[3] + 1) + base))
            if not hits:
                scored.append((word, neighbor, cosine + base))
    if dedupe:
        best = {}
        for w, n, s in scored:
            best[n] = max(s, best.get(n, s))
        scored = [(word, n, s) for n, s in best.items()]
    return sorted(scored, key=lambda r: (-r[2], r[1]))[:size]


@pytest.mark.parametrize("dedupe", [False, True])
def test_evaluation_against_row_by_row_model(spark, dedupe):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    thesaurus = [(t, n, round(rng.random(), 3)) for t in ("w0", "w1") for n in words if n != t]
    freqs = [(w, float(rng.randint(1, 50))) for w in words[2:]] + [("w3", 7.0)]
    trigrams = [(rng.choice("abc"), rng.choice(words), rng.choice("xyz"), rng.randint(1, 9))
                for _ in range(60)]
    texts = [f"{rng.choice('abc')} {rng.choice(words[:2])} {rng.choice('xyz')}" for _ in range(15)]
    found = evaluate(spark, spark.createDataFrame(thesaurus, THESAURUS), freqs, trigrams, texts,
                     ["w0", "w1"], dedupe=dedupe, synonyms=8)
    for word in ("w0", "w1"):
        contexts = [(s.split()[0], s.split()[2]) for s in texts if word in s.split()]
        expected = model(thesaurus, freqs, trigrams, contexts, word, 8, dedupe)
        got = sorted((r for r in found if r[0] == word), key=lambda r: (-r[2], r[1]))
        assert [r[1] for r in got] == [r[1] for r in expected]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in expected])


def test_same_sentence_needs_both_sides_in_one(spark):
    thesaurus = spark.createDataFrame([("cat", "dog", 0.5)], THESAURUS)
    texts = ["a cat x", "b cat y"]
    crossed = [("a", "dog", "y", 1)]
    [loose] = evaluate(spark, thesaurus, [("dog", 1.0)], crossed, texts, "cat")
    [strict] = evaluate(spark, thesaurus, [("dog", 1.0)], crossed, texts, "cat", same_sentence=True)
    assert loose[2] == pytest.approx(0.5 + math.log(2)) and strict[2] == 0.5


def test_substitute_sentence(spark, golden):
    df = sentences(spark, ["the cat and the cat", "no match"])
    rows = {r.sentence: r.variant for r in ds.substitute_sentence(df, golden, "cat").collect()}
    assert rows == {"the cat and the cat": "the dog and the dog", "no match": "no match"}
    assert ds.substitute_sentence(df, golden, "unknown").count() == 0


def test_substitute_sentence_takes_k_neighbors(spark):
    thesaurus = spark.createDataFrame(
        [("a", "x", 0.9), ("a", "y", 0.10), ("a", "z", 0.2)], THESAURUS)
    rows = ds.substitute_sentence(sentences(spark, ["a b"]), thesaurus, "a", k=2).collect()
    assert sorted(r.variant for r in rows) == ["x b", "z b"]


def test_sentence_variants_check_the_leading_boundary_only(spark):
    thesaurus = spark.createDataFrame([("find", "$1 seek\\", 0.9)], THESAURUS)
    df = sentences(spark, ["find finding refind éfind _find", "nothing"])
    rows = [r.variant for r in ds.sentence_variants(df, thesaurus, "find").collect()]
    assert rows == [
        "find finding refind éfind _find",
        "$1 seek\\ $1 seek\\ing refind éfind _find",
    ]


def test_sentence_variants_without_neighbors_keep_the_original(spark):
    thesaurus = spark.createDataFrame([("a", "b", 0.9)], THESAURUS)
    rows = ds.sentence_variants(sentences(spark, ["find it"]), thesaurus, "find").collect()
    assert [r.variant for r in rows] == ["find it"]


def test_sentence_variants_quote_the_word(spark):
    thesaurus = spark.createDataFrame([("a.c", "x", 0.9)], THESAURUS)
    rows = ds.sentence_variants(sentences(spark, ["abc a.c"]), thesaurus, "a.c").collect()
    assert sorted(r.variant for r in rows) == ["abc a.c", "abc x"]


def test_sorted_inside_each_partition(spark):
    reduced = spark.createDataFrame(
        [("a", f"n{i}", 0.5) for i in range(200)], THESAURUS).repartition(4)
    freqs = spark.createDataFrame([(f"n{i}", float(i * 7 % 50)) for i in range(200)], FREQ)
    sorted_rows = ds.neighbor_frequencies(reduced, freqs, sort=True)
    for part in sorted_rows.select("freq").rdd.glom().collect():
        values = [r.freq for r in part]
        assert values == sorted(values, reverse=True)


def test_table_of_words(spark):
    texts = ["b cat x cat", "concat it", "cat y", "", "a dog"]
    words = ["cat", "dog", "none"]
    table = spark.createDataFrame([(w,) for w in words + ["cat"]], "target string")
    df = sentences(spark, texts)
    listed = ds.sentence_contexts(df, words, strict_context=True).collect()
    assert sorted(ds.sentence_contexts(df, table, strict_context=True).collect()) == sorted(listed)
    assert sorted(tuple(r) for r in listed) == [
        ("cat", "", "cat", "y"), ("cat", "b", "cat", "x"), ("dog", "a", "dog", "")]
    inside = ds.sentence_contexts(df, words).collect()
    assert sorted(ds.sentence_contexts(df, table).collect()) == sorted(inside)
    assert ("cat", "", "cat", "") in [tuple(r) for r in inside]


def _evaluation_plan(spark):
    rows = [(f"t{i}", f"c{i % 7}", 1 + i % 3) for i in range(60)]
    counted = spark.createDataFrame(rows, "target string, context string, n long")
    nearest = ds.thesaurus(ds.similarity(counted, sim_min=0.1))
    result = ds.evaluate_thesaurus(
        nearest, spark.createDataFrame([("t1", 2.0)], FREQ),
        spark.createDataFrame([("a", "t1", "b", 1)], TRIGRAM),
        sentences(spark, ["a t2 b"]), ["t2"])
    result.collect()
    return result._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("all_keys", ["true", "false"])
def test_evaluation_pairs_once_and_deals_scores_by_both_words(spark, all_keys):
    key, limit = ("spark.sql.requireAllClusterKeysForCoPartition",
                  "spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, all_keys)
    spark.conf.set(limit, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _evaluation_plan(spark)
    finally:
        spark.conf.unset(limit)
        spark.conf.unset("spark.sql.adaptive.enabled")
        ds.configure(spark)
    pair_joins = [x for x in plan.splitlines() if "SortMergeJoin [i#" in x]
    assert len(pair_joins) == 1, plan
    scores = [x for x in plan.splitlines() if "hashpartitioning(target#" in x
              and ", neighbor#" in x and "REPARTITION_BY_COL" in x]
    assert len(scores) >= 2, plan


def test_substitute_words_joins_tokens(spark):
    thesaurus = spark.createDataFrame(
        [("a", "x", 0.9), ("a", "y", 0.8), ("b", "z", 0.5), ("no", "w", 0.5)], THESAURUS)
    df = sentences(spark, ["a b a", "ab", "", "b"])
    rows = ds.substitute_words(df, thesaurus).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a b a", "a", "x", "x b x"), ("a b a", "b", "z", "a z a"), ("b", "b", "z", "z")]
    table = spark.createDataFrame([("a",), ("a",)], "target string")
    rows = ds.substitute_words(df, thesaurus, table, k=2).collect()
    assert sorted(r.variant for r in rows) == ["x b x", "y b y"]
