import random

import pytest
from golden import CORPUS, all_measures, lines

import distsim as ds
from distsim.operators import similarity

NAMES = ["cosine", "lin", "wjaccard", "l1", "l2", "jsd", "askew1", "askew2"]


def vectors(seed, targets=40, contexts=30, most=9):
    """Random vectors with a context every second target has and a target with them all."""
    rng = random.Random(seed)
    rows = []
    for t in range(targets):
        names = {f"c{int(contexts * rng.random() ** 2)}" for _ in range(rng.randint(1, 6))}
        if t % 2:
            names.add("hot")
        rows += [(f"t{t:02d}", c, int(most * rng.random() ** 3) + 1) for c in sorted(names)]
    rows += [("wide", f"c{c}", rng.randint(1, most)) for c in range(contexts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "target string, context string, n long")


def check(result, expected):
    found = {(r.target1, r.target2): r.asDict() for r in result.collect()}
    assert found.keys() == expected.keys()
    for pair, values in expected.items():
        for name in NAMES:
            assert found[pair][name] == pytest.approx(values[name], rel=1e-9, abs=1e-9), (pair, name)


def test_golden_pairs(spark):
    counted = ds.pair_counts(ds.bigram_pairs(lines(spark, CORPUS)))
    found = {(r.target1, r.target2): r for r in ds.similarity(
        counted, distances=True, all_pairs=True).collect()}
    row = found["cat", "dog"]
    assert [round(row[n], 6) for n in ("cosine", "wjaccard", "lin", "l1", "l2", "jsd", "askew1", "askew2")] == [
        0.707107, 0.555556, 0.714286, 3, 1.732051, 6.654761, 5.971564, 3.917036]
    row = found["cat", "eats"]
    assert [round(row[n], 6) for n in ("cosine", "wjaccard", "lin", "l1", "l2", "jsd", "askew1", "askew2")] == [
        0, 0, 0, 6, 2.828427, 11.943128, 18.420681, 9.21034]
    kept = ds.similarity(counted, sim_min=0.1).collect()
    assert [(r.target1, r.target2) for r in kept] == [("cat", "dog")]


@pytest.mark.parametrize("jsd", ["integer", "real"])
@pytest.mark.parametrize("partitions, blocks", [(None, None), (3, 1), (4, 5)])
def test_all_pairs_against_brute_force(spark, jsd, partitions, blocks):
    rows = vectors(1)
    result = ds.similarity(
        frame(spark, rows), distances=True, jsd=jsd, partitions=partitions, blocks=blocks,
        all_pairs=True)
    check(result, all_measures(rows, jsd == "integer"))


@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("sim_min", [0.05, 0.3, 0.7, 0.95, 1.0])
@pytest.mark.parametrize("prune", [False, True])
def test_threshold_against_brute_force(spark, seed, sim_min, prune):
    rows = vectors(seed)
    expected = {p: m for p, m in all_measures(rows).items() if m["cosine"] >= sim_min}
    result = ds.similarity(
        frame(spark, rows), sim_min=sim_min, distances=True, prune=prune, partitions=3, blocks=4)
    check(result, expected)


def test_pruning_joins_fewer_entries_and_looks_up_the_rest(spark):
    # Large weights on a frequent context decide the cosine, rare ones find the pair.
    rows = [(f"t{i:02d}", "hot", 5) for i in range(30)]
    rows += [(f"t{i:02d}", f"rare{i // 2}", 20) for i in range(30)]
    expected = {p: m for p, m in all_measures(rows).items() if m["cosine"] >= 0.9}
    assert len(expected) == 15
    check(ds.similarity(frame(spark, rows), sim_min=0.9, distances=True, prune=True), expected)


def test_association_filter_changes_the_vectors(spark):
    rows = vectors(4)
    kept = [r for r in rows if r[2] > 2]
    expected = {p: m for p, m in all_measures(kept).items() if m["cosine"] >= 0.2}
    result = ds.similarity(frame(spark, rows), sim_min=0.2, assoc_min=2, distances=True)
    check(result, expected)


@pytest.mark.parametrize("dist_max", [0.0, 0.4, 3.0])
def test_distance_filter_drops_only_if_all_three_exceed_it(spark, dist_max):
    rows = vectors(5)
    expected = {
        p: m for p, m in all_measures(rows).items()
        if not (m["lin"] > dist_max and m["l1"] > dist_max and m["jsd"] > dist_max)
    }
    check(ds.similarity(frame(spark, rows), dist_max=dist_max, distances=True, all_pairs=True),
          expected)


def test_distances_off_are_zero(spark):
    for row in ds.similarity(frame(spark, vectors(6)), sim_min=0.1).collect():
        assert row.l1 == row.l2 == row.jsd == row.askew1 == row.askew2 == 0


def test_one_context_shared_by_all(spark):
    rows = [(f"t{i:03d}", "hot", 1 + i % 3) for i in range(120)]
    result = ds.similarity(frame(spark, rows), sim_min=0.5)
    assert result.count() == 120 * 119 // 2
    assert {r.cosine for r in result.select("cosine").distinct().collect()} == {1.0}


def test_pairs_are_not_shuffled(spark):
    plan = ds.similarity(frame(spark, vectors(7)), sim_min=0.2)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    above_join = text[: text.index("SortMergeJoin")]
    assert "Exchange" not in above_join and "HashAggregate" in above_join
    assert text.count("REPARTITION_BY_NUM") == 2


def test_random_score_is_repeatable(spark):
    df = frame(spark, vectors(8))
    one = ds.similarity(df, sim_min=0.2, seed=1).select("target1", "target2", "randomic")
    two = ds.similarity(df, sim_min=0.2, seed=1, partitions=5).select("target1", "target2", "randomic")
    assert sorted(one.collect()) == sorted(two.collect())
    values = [r.randomic for r in one.collect()]
    assert all(0 <= v < 1 for v in values) and len(set(values)) == len(values)


def test_thesaurus_is_symmetric(spark):
    pairs = ds.similarity(frame(spark, vectors(9)), sim_min=0.2, distances=True)
    rows = {(r.target1, r.target2): r for r in ds.thesaurus(pairs).collect()}
    assert len(rows) == 2 * pairs.count()
    assert all(rows[b, a][2:] == r[2:] for (a, b), r in rows.items())
    swapped = {(r.target1, r.target2): r for r in ds.thesaurus(pairs, swap_askew=True).collect()}
    for (a, b), r in rows.items():
        if a > b:
            assert (swapped[a, b].askew1, swapped[a, b].askew2) == (r.askew2, r.askew1)


def test_pruning_needs_a_threshold(spark):
    with pytest.raises(ValueError):
        ds.similarity(frame(spark, vectors(1)), prune=True, all_pairs=True)
    with pytest.raises(ValueError):
        ds.similarity(frame(spark, vectors(1)), sim_min=0.1, distances=True, jsd="other")


def test_a_quadratic_result_must_be_asked_for(spark):
    df = frame(spark, vectors(1))
    for wrong in ({}, {"sim_min": 0.0}, {"sim_min": 0.5, "all_pairs": True}):
        with pytest.raises(ValueError):
            ds.similarity(df, **wrong)
    with pytest.raises(ValueError):
        ds.calculate_similarity(df)


def test_no_operator_changes_the_session(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "true")
    try:
        expected = {p: m for p, m in all_measures(vectors(3)).items() if m["cosine"] >= 0.3}
        check(ds.similarity(frame(spark, vectors(3)), sim_min=0.3, distances=True), expected)
        assert spark.conf.get(key) == "true"
    finally:
        ds.configure(spark)
    assert spark.conf.get(key) == "false"


@pytest.mark.parametrize("sim_min", [None, 0.2, 0.7])
def test_words_give_the_rows_of_the_full_result(spark, sim_min):
    rows = vectors(10)
    words = ["t01", "t02", "wide", "absent"]
    expected = {p: m for p, m in all_measures(rows).items()
                if (sim_min is None or m["cosine"] >= sim_min) and set(p) & set(words)}
    table = spark.createDataFrame([(w,) for w in words + [None, "t01"]], "target string")
    for chosen in (words, table):
        check(ds.similarity(frame(spark, rows), sim_min=sim_min, distances=True, words=chosen,
                            all_pairs=sim_min is None), expected)
    plan = ds.similarity(frame(spark, rows), sim_min=0.2, words="t01")._jdf.queryExecution()
    assert "Generate" not in plan.executedPlan().toString()


def test_added_entries_meet_no_context(spark):
    rows = [("a", "\n", 2), ("b", "\n", 3), ("c", "", 4), ("d", "", 1), ("e", "x", 1)]
    check(ds.similarity(frame(spark, rows), distances=True, all_pairs=True), all_measures(rows))


@pytest.mark.parametrize("rare", [0, 3, 8, 1000, "auto"])
def test_hybrid_plan_against_brute_force(spark, rare):
    rows = vectors(11)
    expected = {p: m for p, m in all_measures(rows).items() if m["cosine"] >= 0.2}
    check(ds.similarity(frame(spark, rows), sim_min=0.2, distances=True, rare=rare, partitions=5,
                        blocks=3), expected)


def test_rare_contexts_are_not_copied(spark):
    """Copies come from frequent contexts alone, whatever the number of partitions."""
    rows = vectors(12) + [(f"r{i}", f"only{i // 2}", 1 + i % 3) for i in range(200)]
    df = frame(spark, rows)
    frequency = {}
    for _, context, _ in rows:
        frequency[context] = frequency.get(context, 0) + 1
    many = sum(d for d in frequency.values() if d > 5)
    assert many < len(rows) / 2
    framed = similarity._framed(df, False, "integer")
    for partitions, blocks in ((4, 3), (400, 80)):
        cells = similarity._in_cells(framed.where("df > 5"), blocks, partitions, "both")
        assert cells.count() == many * blocks
    plan = ds.similarity(df, sim_min=0.2, rare=5, partitions=6)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    # What sums the pairs reads both kinds of rows as they were dealt by cell.
    above = text[: text.index("Union")]
    assert "Exchange" not in above and text.count("REPARTITION_BY_NUM") == 3


@pytest.mark.parametrize("plan", ["salted", "cells"])
@pytest.mark.parametrize("words", [["t01", "t02", "wide", "absent"], None])
def test_plans_for_words(spark, plan, words):
    rows = vectors(13)
    everything = sorted({t for t, _, _ in rows})
    chosen = words or everything
    expected = {p: m for p, m in all_measures(rows).items()
                if m["cosine"] >= 0.2 and set(p) & set(chosen)}
    table = spark.createDataFrame([(w,) for w in chosen + [None, chosen[0]]], "target string")
    check(ds.similarity(frame(spark, rows), sim_min=0.2, distances=True, words=table,
                        words_plan=plan, split=4, partitions=4, blocks=3), expected)


def test_plans_are_refused_where_they_mean_nothing(spark):
    df = frame(spark, vectors(1))
    for wrong in ({"rare": 5, "prune": True}, {"rare": 5, "words": "t01"}, {"words_plan": "cells"},
                  {"words": "t01", "words_plan": "other"}):
        with pytest.raises(ValueError):
            ds.similarity(df, sim_min=0.2, **wrong)
