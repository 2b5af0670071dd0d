import os

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from distsim.llm import queries
from distsim.llm.common import numbered, stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def first_of_groups(texts):
    """Smallest id of each group of texts linked by a 5-word Jaccard similarity of 0.8."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


@needs_tables
def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == first.columns
        if name in ("language_id", "quality_rules", "near_duplicates"):
            # What is kept is kept as it was, once.
            assert docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in before.collect()}
            kept = {r.doc_id for r in docs.collect()}
            assert kept == first_of_groups(texts) and len(kept) == sizes[-1]
    assert sizes[1] >= 0.95 * sizes[0] and 0 < sizes[3] < sizes[2] < sizes[1]
    assert sizes[5] == sizes[4]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@needs_tables
def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, "", None, "s", 0), (None, "text " * 20, "en", None, 1),
         (9002, "und " * 9, "de", None, 3)], docs.schema)
    rows = docs.unionByName(docs).unionByName(odd)
    for part in (stored(rows), stored(rows.where("false"))):
        for _, stage in corpus_pipeline.STAGES:
            part = stored(stage(spark, part, SF))
            part.count()


def test_near_duplicates_are_of_five_words(spark):
    """One word changed in a text of 60 leaves 0.84 of the 5-word shingles."""
    text = [f"w{i * 7919 % 1009}" for i in range(60)]
    near, far = list(text), list(text)
    near[30] = "other"
    for k in range(5, 60, 10):
        far[k] = "other"
    rows = [(3, " ".join(text)), (2, " ".join(near)), (1, " ".join(far)), (4, " ".join(text))]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]
    assert docs.count() == 4


def test_near_duplicates_tell_rows_apart(spark):
    """Shared ids, missing ids and texts, and an id that a hash might hit."""
    long = " ".join(f"w{i * 7919 % 1009}" for i in range(60))
    other = " ".join(f"v{i * 7919 % 1009}" for i in range(60))
    rows = [(7, long, 1), (7, other, 2), (None, long, 3), (None, "only here once at all", 4),
            (42, "a text of its own number", 5), (None, None, 6), (9, long.upper(), 7),
            (None, "", 8), (3, other + " end", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    found = {r.row for r in kept.collect()}
    assert found in ({1, 9, 4, 5, 6}, {1, 9, 4, 5, 8})


@needs_tables
def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in ("__lang", "lang_", "quality_rules", "words", "hashes", "counts", "__words",
                 "row", "__size", "__copies", "kept_0", "component", "id"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs = stored(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        some = out.first()
        assert all(some[c] == f"own {c}" for c in docs.columns[5:])


def test_numbered_is_gapless_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("s").alias("number_"))
    rows = numbered(df, F.col("x").desc()).collect()
    assert sorted((r.number, r.x) for r in rows) == [(i, 999 - i) for i in range(1000)]
    assert numbered(df.where("false"), F.col("x")).count() == 0
