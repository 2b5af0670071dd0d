import pytest

from distsim.llm import mixing

DOC = "doc_id long, text string, source string"


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def corpus(spark, big=1):
    rows = []
    for s, n in (("b", 400 * big), ("a", 30), ("é", 5), (None, 50), ("c", 1), ("Z", 120)):
        rows += [(len(rows) + i, "w " * (1 + (i * 7) % 23) + "# " * (i % 3), s) for i in range(n)]
    rows += [(9001, None, "b"), (9002, "", "a"), (9003, None, "empty"), (None, "x y", "b"),
             (5, rows[5][1], "b"), (9004, "long " * 3000, "b")]
    return spark.createDataFrame([(*r, 7, "t") for r in rows],
                                 DOC + ", size int, target string")


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_targets_and_taken_words(spark, buckets):
    docs = corpus(spark)
    rows = mixing.mix(docs, buckets=buckets).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = targets(sizes)
    largest = {}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.copies in (int(r.target // max(r.source_size, 1)),
                            int(r.target // max(r.source_size, 1)) + 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        # Twice: the row that is there twice is taken or left as a whole.
        assert abs(taken[s] - expected[s]) <= largest[s] + 1e-6
    again = mixing.mix(docs.repartition(4), buckets=buckets).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_buckets_do_not_change_the_choice(spark):
    docs = corpus(spark)
    kinds = [sorted(map(str, mixing.mix(docs, buckets=b).collect())) for b in (1, 64)]
    assert kinds[0] == kinds[1]


def test_keys_prefer_quality(spark):
    rows = [(i, "w " * 20 + ("$ " * 20 if i % 2 else ""), s) for s in "ab" for i in range(2000)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    out = mixing.mix(spark.createDataFrame(rows, DOC), weights=(1, 3)).collect()
    part = [r for r in out if r.source == "a"]
    clean, dirty = (sum(r.copies for r in part if (r.doc_id % 2) == k) for k in (0, 1))
    assert clean > 1.5 * dirty > 0


def test_documents_are_repeated(spark):
    docs = corpus(spark)
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    seen = {}
    for r in rows.collect():
        seen[r.doc_id, r.source] = seen.get((r.doc_id, r.source), 0) + 1
    twice = {(5, "b")}
    assert seen == {k: n * (1 + (k in twice)) for k, n in copies.items() if n}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeated_rows_are_taken_one_by_one(spark, partitions):
    """A source of equal rows comes as near to its target as others do."""
    words = " ".join(["w"] * 100)
    rows = [(5, words, "a")] * 40 + [(k, f"v{k} " * 100, "b") for k in range(100, 120)]
    rows += [(None, words, "c")] * 30
    docs = spark.createDataFrame(rows, DOC).repartition(partitions)
    out = mixing.mix(docs, weights=(2, 7, 4)).collect()
    for source in "abc":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
    assert len({r.copies for r in out if r.source == "a"}) == 2
    again = mixing.mix(docs.repartition(3), weights=(2, 7, 4)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_columns_of_internal_names_stay(spark):
    names = "__size int, __copies int, __key string, __plan string, kept_0 int, __source string"
    rows = [(k, "one two three", "s", 7, 8, "k", "p", 9, "t") for k in range(3)]
    docs = spark.createDataFrame(rows, DOC + ", " + names)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[1:] for r in out.collect()} == {rows[0][1:]}
