import math
from collections import Counter

import pytest
from golden import CORPUS, PAIR_COUNTS, lines

import distsim as ds

EXPECTED = {
    ("cat", "eats"): dict(
        n=2, target_n=4, context_n=3, cond_prob=0.5, pmi=1.0414538748, npmi=0.4866456433,
        lmi=2.0829077497, tscore=0.9150793639, zscore=1.5403080924, dice=0.5714285714,
        chisquare=3.7673992674, loglike=3.2478735931, affinity=0.5833333333,
        entropy_target=1.0397207708, entropy_context=0.6365141683),
    ("the", "cat"): dict(
        n=3, target_n=6, context_n=3, cond_prob=0.5, pmi=1.0414538748, npmi=0.6003996548,
        lmi=3.1243616245, tscore=1.1207387578, zscore=1.8864844366, dice=0.6666666667,
        chisquare=6.6785714286, loglike=7.52620857, affinity=0.75,
        entropy_target=0.6931471806, entropy_context=0),
}


@pytest.fixture(scope="module")
def pairs(spark):
    return ds.bigram_pairs(lines(spark, CORPUS))


@pytest.fixture(scope="module")
def counted(pairs):
    return ds.pair_counts(pairs)


def as_dict(df):
    return {(r.target, r.context): r.n for r in df.collect()}


def test_golden_pair_counts(counted):
    assert as_dict(counted) == PAIR_COUNTS


def model(pairs, min_freq, min_pair):
    targets, contexts = Counter(t for t, _ in pairs), Counter(c for _, c in pairs)
    kept = Counter(
        (t, c) for t, c in pairs
        if len(t) > 1 and len(c) > 1 and targets[t] > min_freq and contexts[c] > min_freq
    )
    return {k: n for k, n in kept.items() if n >= min_pair}


@pytest.mark.parametrize("min_freq, min_pair", [(0, 1), (1, 1), (2, 1), (3, 2), (5, 3), (100, 1)])
def test_thresholds_against_a_plain_count(pairs, min_freq, min_pair):
    rows = [tuple(r) for r in pairs.collect()]
    assert as_dict(ds.pair_counts(pairs, min_freq, min_pair)) == model(rows, min_freq, min_pair)


def test_context_frequency_counts_pairs_of_dropped_targets(spark):
    df = spark.createDataFrame([("", "word"), ("xx", "word")], "target string, context string")
    assert as_dict(ds.pair_counts(df, 0)) == {("xx", "word"): 1}
    counted = ds.count_pairs(df)
    assert ds.context_counts(counted, 1).collect()[0].n == 2
    assert ds.target_counts(counted, 0).count() == 1


def test_corpus_is_scanned_into_one_shuffle(spark, folder):
    ds.write_stage(lines(spark, CORPUS * 50), folder + "/in")
    df = ds.pair_counts(ds.bigram_pairs(spark.read.parquet(folder + "/in")), 5, 2)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2


def test_vocabularies_are_hashed_from_one_shuffle(spark, folder):
    ds.write_stage(lines(spark, CORPUS * 50), folder + "/in_hashed")
    df = ds.pair_counts(ds.bigram_pairs(spark.read.parquet(folder + "/in_hashed")), 5, 2)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and final.count("ShuffledHashJoin") == 2
    assert final.count("ReusedExchange [word") == 1


def test_golden_profiles(counted):
    found = {(r.target, r.context): r.asDict() for r in ds.assoc_profiles(counted).collect()}
    assert len(found) == 12
    for key, expected in EXPECTED.items():
        for name, value in expected.items():
            assert found[key][name] == pytest.approx(value, abs=5e-10), (key, name)


def test_totals_links_and_vectors(counted):
    assert ds.pair_total(counted).first().total == 17
    assert {r.word: (r.links, r.total) for r in ds.target_links(counted).collect()}["the"] == (2, 6)
    assert {r.word: (r.links, r.total) for r in ds.context_links(counted).collect()}["eats"] == (2, 3)
    vectors = {r.target: tuple(r)[1:] for r in ds.target_vectors(counted).collect()}
    assert vectors["cat"] == (3, 4, 6)


def test_profile_of_a_single_pair_has_no_npmi(spark):
    df = spark.createDataFrame([("aa", "bb", 4)], "target string, context string, n long")
    row = ds.assoc_profiles(df).first()
    assert math.isnan(row.npmi) and row.pmi == 0 and row.chisquare == 0 and row.loglike == 0


def test_empty_input_gives_empty_profiles(spark):
    df = spark.createDataFrame([], "target string, context string, n long")
    assert ds.assoc_profiles(df).count() == 0
    assert ds.similarity(df, sim_min=0.1).count() == 0


def test_vector_parts_hold_every_entry_once(spark):
    rows = [("t%d" % (i % 3), "c%d" % i, i + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "target string, context string, n long")
    parts = ds.vector_parts(df, size=20).collect()
    assert len(parts) > 9 and max(len(p.vector) for p in parts) < 60
    assert sorted((p.target, c, n) for p in parts for c, n in p.vector.items()) == sorted(rows)
