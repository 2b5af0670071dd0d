import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from distsim.llm import simhash
from distsim.llm.common import stored
from distsim.llm.components import components

DOC = "doc_id long, text string"


def fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(points, radius=2):
    ids, fps = zip(*points)
    v = np.array(fps, dtype=np.uint64)
    return [(ids[i], ids[j]) for i in range(len(v))
            for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius)]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \t\n", "One", "one", "ONE two", "one two", "É a b", "é a b"]
    for _ in range(30):
        w = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append("\n".join(w))
    return out + out[10:14] + ["x y " * 50_000]


def test_documents_against_brute_force(spark):
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows] + [(None, "one", "b", 2)],
                                 DOC + ", fp string, component int").repartition(3)
    fps = [(i, fingerprint(t)) for i, t in rows]
    expected = groups([i for i, _ in rows], near(fps))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == f"{fingerprint('one'):016x}"
        else:
            assert r.fingerprint == f"{dict(fps)[r.doc_id]:016x}"
            assert r.component_id == expected[r.doc_id]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tree_search_is_exact(spark, seed, radius):
    """Random points, chains of near points, and a dense ball larger than a shard."""
    rng = random.Random(seed)
    points = {rng.getrandbits(64) for _ in range(600)}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            points.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    for _ in range(500):
        points.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    rows = list(enumerate(sorted(points, key=lambda x: x * 7919 % 1009)))
    df = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in rows],
                               "id long, fp long")
    links = simhash.near_links(df, radius=radius, sample_rows=200, shard_rows=16)
    expected = groups(range(len(rows)), near(rows, radius))
    found = {r.node: r.component for r in components(links).collect()}
    assert {i: found.get(i, i) for i in expected} == expected


def test_search_returns_few_links(spark):
    points = [(i, i ^ (i >> 3)) for i in range(700)]
    df = spark.createDataFrame([(i, x) for i, x in points], "id long, fp long")
    assert simhash.near_links(df, shard_rows=64).count() < 20 * len(points)


def test_components_of_chains_stars_and_self_links(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 300)]
    links += [(7, 7), (None, 3), (4, None), (2, 1), (1, 2), (2, 1)]
    rng.shuffle(links)
    found = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert found == groups({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def copies():
    """Texts in chains of edits, so that similarities lie on both sides of 0.8."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    out = [None, " ", "One two", "one TWO", "x y " * 40]
    for k in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):
            for _ in range(max(1, len(w) // rng.choice((40, 60, 90, 200)))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append("\n".join(w).upper() if k % 3 else " ".join(w))
    w = [rng.choice(words) for _ in range(100)]
    for _ in range(80):  # more than one part of a bucket
        v = list(w)
        v[rng.randrange(100)] = rng.choice(words)
        out.append(" ".join(v))
    return out


def test_near_copies_against_brute_force(spark):
    rows = [(2000 - 7 * i, t) for i, t in enumerate(copies())]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    ids = list(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[:n]
              if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    far = [(a, b) for a, b in linked if sets[a] != sets[b]]
    assert len(far) > 50
    df = stored(spark.createDataFrame(rows, "id long, text string").repartition(3))
    found = {r.id: r.component for r in simhash.near_copies(df).collect()}
    assert found == groups(ids, linked)
    # The radius of the fingerprint query leaves most of them.
    fps = {i: fingerprint(t) for i, t in rows}
    assert sum((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in far) < 0.5 * len(far)


@pytest.mark.parametrize("points, turns", [(1024, 3), (16, 1), (50, 0)])
def test_near_copies_in_a_bucket_of_thousands(spark, points, turns):
    """Variants of one text, most of them no near copies of each other but by others."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for k in range(2000):
        w = list(words)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
            w[rng.randrange(60)] = rng.choice(("x", "y"))
        texts.append(w)
        rows.append((k * 3 + 1, " ".join(w)))
    df = stored(spark.createDataFrame(rows, "id long, text string").repartition(4))
    found = {r.id: r.component for r in simhash.near_copies(df, points=points, turns=turns).collect()}
    # By blocks of an incidence matrix, so that the brute force takes seconds.
    sets = [{tuple(w[k:k + 5]) for k in range(56)} for w in texts]
    index = {g: n for n, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(index)), np.float32)
    for n, x in enumerate(sets):
        held[n, [index[g] for g in x]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both)
    linked = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    want = groups([i for i, _ in rows], linked)
    assert len(set(want.values())) > 1
    wrong = [i for i in want if found[i] != want[i]]
    assert not wrong


def test_links_in_a_cell_join_all_they_can():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 60, k % 5 + 1, dtype=np.uint64)]))
            for k in range(40)] + [np.zeros(0, np.uint64)]
    ids = np.arange(len(sets)) * 10
    def jaccard(a, b):
        return len(np.intersect1d(sets[a], sets[b])) / max(len(np.union1d(sets[a], sets[b])), 1)
    linked = [(10 * a, 10 * b) for a in range(40) for b in range(a) if jaccard(a, b) >= 0.8]
    role = np.full(len(sets), simhash.BOTH)
    found = simhash.links_in_cell(role, ids, ids.copy(), sets, 0.8)
    assert len(found) < len(sets) and set(map(frozenset, found)) <= set(map(frozenset, linked))
    assert groups(ids.tolist(), found) == groups(ids.tolist(), linked)


def test_near_copies_come_from_the_tree(spark, monkeypatch):
    """With no band in common, texts that the tree links are still compared."""
    sketches = simhash._sketches
    monkeypatch.setattr(simhash, "_sketches", lambda docs: sketches(docs).withColumn(
        "bands", F.array(F.xxhash64("id"))))
    words = [f"w{i * 7919 % 10007}" for i in range(4000)]
    other = [f"v{i * 7919 % 10007}" for i in range(4000)]
    texts = [" ".join(words), " ".join(other), " ".join(words[:-1] + ["end"]), "a b", ""]
    sets = [simhash._shingles(t.encode()).astype(">u8") for t in texts]
    assert (simhash._majority(sets[0]) ^ simhash._majority(sets[2])).bit_count() <= simhash.RADIUS
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: r.component for r in simhash.near_copies(df).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
