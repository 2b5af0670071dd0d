import numpy as np
import pytest

from distsim.llm import vectors

VEC = "vec_id long, embedding array<float>"


def data(seed=0, size=24):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=size) for _ in range(300)]
    for _ in range(20):
        c = rng.normal(size=size)
        rows += [c + rng.normal(size=size) * rng.uniform(0.05, 0.5) for _ in range(rng.integers(1, 12))]
    rows = [np.float32(r * rng.uniform(0.1, 10)) for r in rows]
    rows += [rows[3], rows[3], rows[3] * np.float32(2), rows[310], -rows[310]]
    dense = np.float32(rng.normal(size=size))
    rows += [dense + np.float32(rng.normal(size=size) * 0.02) for _ in range(150)]
    out = [(7 * i % 1009, [float(x) for x in r]) for i, r in enumerate(rows)]
    odd = [(2000, None), (2001, [0.0] * size), (2002, []), (2003, [float("nan")] + [1.0] * (size - 1)),
           (2004, [float("inf")] * size), (2005, [None] + [1.0] * (size - 1)), (2006, [1.0, 0.0]),
           (2007, [1.0, 0.1]), (2008, [1e-20] * size)]
    return out, odd


def expected(rows, cosine):
    ids = [i for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    by_id = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in rows if i in ids}
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and len(by_id[i]) == len(by_id[j]) and by_id[i] @ by_id[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, {i: find(i) for i in links}


@pytest.mark.parametrize("cosine, blocks", [(0.9, 4), (0.8, 3), (0.99, 24)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, cosine, blocks):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 60)
    rows, odd = data()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], VEC + ", id int, copies string")
    found = vectors.near_vectors(df, cosine=cosine, blocks=blocks, group_rows=100).collect()
    links, component = expected(rows + odd, cosine)
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert (r.n_links, r.component_id) == (links[r.vec_id], component[r.vec_id]), r
        assert r.kept == (r.vec_id == r.component_id)


def test_pigeonhole_misses_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 30))
    y = x + rng.normal(size=x.shape) * rng.uniform(0, 1, (200, 1))
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    for blocks in (1, 4, 7):
        spans = vectors._spans(30, blocks)
        linked = vectors.links_between(x, y, spans, 0.85)
        assert (linked == (x @ y.T >= 0.85)).all()


def test_rows_without_id_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]),
                                (9, [2.0, 0.1])], VEC)
    found = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    assert found == sorted([(None, 0, None, False), (4, 1, 4, True), (4, 1, 4, True),
                            (9, 1, 4, False)], key=str)
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert vectors.near_vectors(df.where("vec_id IS NULL")).count() == 1
