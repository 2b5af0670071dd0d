import numpy as np
import pytest
from golden import all_measures
from test_nearest import ranked, rows
from test_similarity import check, frame, vectors

import distsim as ds
from distsim.operators import packed
from distsim.operators.similarity import packed_totals


@pytest.mark.parametrize("sim_min", [0.05, 0.3, 1.0])
@pytest.mark.parametrize("jsd, blocks", [("integer", 1), ("real", 4)])
def test_sums_of_cells_against_brute_force(spark, sim_min, jsd, blocks):
    data = vectors(21)
    expected = {p: m for p, m in all_measures(data, jsd == "integer").items() if m["cosine"] >= sim_min}
    check(ds.similarity(frame(spark, data), sim_min=sim_min, distances=True, jsd=jsd, packed=True,
                        partitions=3, blocks=blocks), expected)


def test_bounds_on_slices_and_parts_change_nothing(monkeypatch, spark):
    data = vectors(22) + [("ä", "hot", 3), ("Z", "hot", 2), ("", "hot", 1)]
    expected = {p: m for p, m in all_measures(data).items() if m["cosine"] >= 0.2}
    monkeypatch.setattr(packed, "PART", 3)
    check(ds.similarity(frame(spark, data), sim_min=0.2, distances=True, packed=True,
                        partitions=2, blocks=2), expected)


def test_a_pair_is_in_one_slice():
    for bound in (1, 7, 10**6):
        runs = []
        packed.ROWS, kept = bound, packed.ROWS
        try:
            runs = list(packed._slices(np.array([1, 1, 5, 20])))
        finally:
            packed.ROWS = kept
        assert [k for lo, hi in runs for k in range(lo, hi)] == [0, 1, 2, 3]
    assert list(packed._slices(np.array([], int))) == []


@pytest.mark.parametrize("words", [["t01", "t02", "wide", "absent"], "t03"])
def test_words(spark, words):
    data = vectors(23)
    chosen = [words] if isinstance(words, str) else words
    expected = {p: m for p, m in all_measures(data).items()
                if m["cosine"] >= 0.2 and set(p) & set(chosen)}
    check(ds.similarity(frame(spark, data), sim_min=0.2, distances=True, words=words, packed=True,
                        partitions=2, blocks=3), expected)


@pytest.mark.parametrize("size, sim_min", [(1, 0.05), (3, 0.2), (200, 0.1)])
def test_nearest_of_cells_are_the_ranked_thesaurus(spark, size, sim_min):
    df = frame(spark, vectors(24))
    assert rows(ds.nearest_neighbors(df, size, sim_min, partitions=3, blocks=3, packed=True)) == \
        ranked(df, size, sim_min)
    ties = frame(spark, [(f"t{i:02d}", "c", 1 + i % 2) for i in range(30)] + [("u", "d", 1)])
    assert rows(ds.nearest_neighbors(ties, 4, packed=True)) == ranked(ties, 4, 0.2)


def test_ties_of_six_decimals_are_rounded_as_by_spark(spark):
    from pyspark.sql import functions as F

    values = [0.1234565, 0.1234575, 0.5, 1.0, 0.9999995, 0.2000005, 0.70710678]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = [r[0] for r in df.select(F.bround("v", 6)).collect()]
    assert packed._six_decimals(np.array(values)).tolist() == expected


def test_no_rows_of_pairs_in_the_plan(spark):
    """One copy of an entry for each block, and no join on contexts."""
    df = frame(spark, vectors(25))
    for result in (ds.similarity(df, sim_min=0.2, packed=True), ds.nearest_neighbors(df, packed=True)):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "a_target" not in plan
    assert ds.similarity(df.where("false"), sim_min=0.2, packed=True).count() == 0
    for wrong in ({"prune": True}, {"rare": 5}, {"words": "t01", "words_plan": "cells"}):
        with pytest.raises(ValueError):
            ds.similarity(df, sim_min=0.2, packed=True, **wrong)


@pytest.mark.parametrize("sim_min", [0.05, 0.3, 0.7, 0.95, 1.0])
@pytest.mark.parametrize("plan", [{"packed": "pruned"}, {"packed": "hybrid", "rare": 0},
                                  {"packed": "hybrid", "rare": 4}, {"packed": "hybrid"}])
def test_pruned_and_hybrid_against_brute_force(monkeypatch, spark, plan, sim_min):
    data = vectors(26) + [(f"r{i}", f"only{i // 2}", 1 + i % 3) for i in range(20)]
    expected = {p: m for p, m in all_measures(data).items() if m["cosine"] >= sim_min}
    monkeypatch.setattr(packed, "PART", 5)
    monkeypatch.setattr(packed, "ROWS", 50)
    check(ds.similarity(frame(spark, data), sim_min=sim_min, distances=True, partitions=3, blocks=4,
                        **plan), expected)


def test_pruned_multiplies_fewer_entries_and_looks_up_the_rest(spark):
    data = [(f"t{i:02d}", "hot", 5) for i in range(30)]
    data += [(f"t{i:02d}", f"rare{i // 2}", 20) for i in range(30)]
    expected = {p: m for p, m in all_measures(data).items() if m["cosine"] >= 0.9}
    assert len(expected) == 15
    result = ds.similarity(frame(spark, data), sim_min=0.9, distances=True, packed="pruned")
    check(result, expected)
    assert "a_target" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_hybrid_copies_rare_entries_only_where_they_meet(spark):
    data = [(f"r{i}", f"only{i // 2}", 1 + i % 3) for i in range(200)]
    data += [(f"s{i}", f"alone{i}", 1) for i in range(50)]
    entries = frame(spark, data)
    totals = packed_totals(entries, False, "integer")
    cells = packed.packed_cells(entries, totals, 20, 4, 5)
    copies = cells.selectExpr("sum(size(contexts)) AS n").first().n
    assert 200 <= copies <= 400
    everywhere = packed.packed_cells(entries, totals, 20, 4)
    assert everywhere.selectExpr("sum(size(contexts)) AS n").first().n == 250 * 20


def test_pairs_are_counted_once(spark):
    """All branches of the pruned and the hybrid plan read one shuffle of the entries."""
    df = frame(spark, vectors(27)).repartition(3, "target")
    for plan in ("pruned", "hybrid"):
        result = ds.similarity(df, sim_min=0.2, distances=True, packed=plan)
        text = result._jdf.queryExecution().executedPlan().toString()
        assert text.count("Scan ExistingRDD") >= 1
        result.collect()
        final = result._jdf.queryExecution().executedPlan().toString()
        final = final[: final.index("== Initial Plan ==")]
        assert final.count("Scan ExistingRDD") == 1
    for wrong in ({"packed": "hybrid", "words": "t01"}, {"packed": "other"},
                  {"packed": "pruned", "rare": 3}):
        with pytest.raises(ValueError):
            ds.similarity(df, sim_min=0.2, **wrong)


@pytest.mark.parametrize("rare", [None, 3])
def test_an_entry_is_shuffled_once_for_all_cells(spark, rare):
    """A block is packed once, and all cells read that; no entry is copied to a cell."""
    data = [(f"t{i % 40:02d}", f"c{i}", 1) for i in range(80)] + [
        (f"t{i:02d}", "hot", 2) for i in range(40)]
    entries = frame(spark, data)
    cells = packed.block_pairs(entries, packed_totals(entries, False, "integer"), 5, rare)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    held = {}
    for row in cells.collect():
        assert row.i <= row.j
        for block, side in ((row.i, "x"), (row.j, "y")):
            tables = [bytes(row[f"{side}_{t}"]) for t in packed.TABLES]
            assert held.setdefault(block, tables) == tables
    many = [packed.pa.ipc.open_stream(tables[2]).read_all().num_rows for tables in held.values()]
    assert sum(many) == (120 if rare is None else 40)
    whole = ds.similarity(entries, sim_min=0.2, packed=True if rare is None else "hybrid")
    assert "explode" not in whole._jdf.queryExecution().executedPlan().toString()


def test_weights_are_stored_as_they_are():
    for values in ([1.0, 2.0], [2.0**31, 3.0], [1.5, 2.0], []):
        assert packed._small(np.array(values)).astype(float).tolist() == values
    assert packed._small(np.array([1.0, 2.0])).dtype == np.int32


def test_neighbors_travel_packed_and_are_ranked_in_parts(monkeypatch, spark):
    """One row for each block of a cell, and no window over rows of neighbors."""
    df = frame(spark, [(f"t{i:02d}", "c", 1 + i % 2) for i in range(40)] + vectors(28))
    result = ds.nearest_neighbors(df, 4, blocks=3, packed=True)
    assert "Window" not in result._jdf.queryExecution().optimizedPlan().toString()
    assert rows(result) == ranked(df, 4, 0.2)
    first = [packed.pa.table({
        "target": packed._coded(packed.pa.array(["a", "b", "ä", "z"]), np.array(t)),
        "neighbor": packed._coded(packed.pa.array(["a", "b", "ä", "z"]), np.array(n)),
        "cosine": np.array(c, np.int32)}) for t, n, c in (
            ([0, 0, 3], [3, 2, 1], [5, 5, 9]), ([0, 0], [1, 0], [5, 4]), ([3], [0], [9]))]
    whole = packed._first(first, 2).to_pylist()
    parts = packed._first([packed._first(first[:2], 2), first[2]], 2).to_pylist()
    assert whole == parts == [
        {"target": t, "neighbor": n, "cosine": c}
        for t, n, c in (("a", "b", 5), ("a", "z", 5), ("z", "a", 9), ("z", "b", 9))]
    assert packed._first(first, 2)["neighbor"].combine_chunks().dictionary.to_pylist() == ["a", "b", "z"]
