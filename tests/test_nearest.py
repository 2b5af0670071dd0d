import pytest
from test_similarity import frame, vectors

import distsim as ds
from distsim.operators import nearest, similarity


def ranked(df, size, sim_min):
    pairs = ds.thesaurus(ds.similarity(df, sim_min=sim_min))
    return rows(ds.reduced_thesaurus(pairs, size=size))


def rows(df):
    return sorted(map(tuple, df.select("target", "neighbor", "cosine").collect()))


@pytest.mark.parametrize("seed", [11, 12])
@pytest.mark.parametrize("size, sim_min", [(1, 0.05), (3, 0.2), (10, 0.3), (200, 0.1)])
def test_rows_of_the_ranked_thesaurus(spark, seed, size, sim_min):
    df = frame(spark, vectors(seed))
    assert rows(ds.nearest_neighbors(df, size, sim_min, partitions=5, blocks=3)) == ranked(
        df, size, sim_min)


def test_ties_are_broken_by_neighbor(spark):
    df = frame(spark, [(f"t{i:02d}", "c", 1 + i % 2) for i in range(30)] + [("u", "d", 1)])
    assert rows(ds.nearest_neighbors(df, 4)) == ranked(df, 4, 0.2)


def test_fewer_rows_of_pairs(spark):
    """A frequent context on which most targets have little weight."""
    data = [(f"t{i:03d}", "hot", 1) for i in range(120)]
    data += [(f"t{i:03d}", f"c{i // 4}", 9) for i in range(120)]
    df = frame(spark, data)
    framed = similarity._framed(df, False, "integer")
    marked = nearest._marked(framed, nearest.neighbor_bounds(framed, 2, 0.2), 0.2)
    every = similarity._join_cells(marked, 4, 3).count()
    assert every == 120 * 119 // 2 + 30 * 6
    assert nearest.pair_rows(marked, 4, 3).count() == 30 * 6
    assert rows(ds.nearest_neighbors(df, 2)) == ranked(df, 2, 0.2)


def test_missing_products_are_looked_up(spark):
    data = [(f"t{i:02d}", "hot", 5) for i in range(30)]
    data += [(f"t{i:02d}", f"rare{i // 2}", 20) for i in range(30)]
    df = frame(spark, data)
    found = rows(ds.nearest_neighbors(df, 1))
    assert found == ranked(df, 1, 0.2) and all(c == 1.0 for _, _, c in found)


def test_empty_and_wrong_input(spark):
    df = frame(spark, vectors(1))
    assert ds.nearest_neighbors(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        ds.nearest_neighbors(df, sim_min=0.0)
