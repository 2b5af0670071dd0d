import os
import zlib

import numpy as np
import pytest

from distsim.llm import langid

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"
EN = "the cat sat on the mat and the dog ran off with this and that thing here there"
DE = "der hund und die katze sind nicht auf dem dach sondern im haus bei der frau"


def corpus(spark):
    rows = [(i, f"{EN if i % 2 else DE} {i}", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !? 34", "en"), (103, EN * 2000, None),
             (None, DE, "en"), (3, EN, "en"), (3, EN, "en"), (104, DE.upper(), None)]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows],
                                 DOC + ", lang_pred string, score double")


def test_small_corpus_with_odd_rows(spark):
    rows = langid.identify(corpus(spark)).collect()
    assert len(rows) == 68
    by_id = {r.doc_id: r for r in rows}
    for i in (100, 101, 102):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[103].lang_pred == "en" and by_id[104].lang_pred == by_id[None].lang_pred == "de"
    assert not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_labels_and_no_rows(spark):
    docs = corpus(spark).drop("lang_pred", "score")
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_counts_of_a_long_text_do_not_depend_on_chunks(monkeypatch):
    text = ("Straße über λόγος, x" * 3000)
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 777)
    parts = langid.counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_penalty_makes_weights_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(200):
        b = np.unique(np.append(rng.integers(10, 500, 20), k % 2)).astype(np.int32)
        rows.append((b, np.full(len(b), len(b) ** -0.5), k % 2))
    dense, _ = langid.ftrl(rows, 2, l1=0.0)
    sparse, _ = langid.ftrl(rows, 2, l1=1.0)
    assert 0 < (sparse != 0).sum() < (dense != 0).sum() / 2
    assert sparse[0, 0] > 0 > sparse[1, 0]


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    y = (z / 0.5 + rng.gumbel(size=z.shape)).argmax(1)
    assert langid.temperature(z, y) == pytest.approx(0.5, rel=0.1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0


def test_every_label_is_learned(spark):
    """More labels than a bounded list would hold, each with a few rows."""
    rows = []
    for k in range(300):
        for j in range(3):
            rows.append((k * 8 + j, f"w{k:03d}x " * 12 + f"q{k:03d}y " * 6, f"l{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_rows=600)
    used = {f"l{k:03d}" for k in range(300)
            if any(zlib.crc32(str(k * 8 + j).encode()) % 4 != 2 for j in range(3))}
    assert set(model.languages) == used and len(used) > 256
