import hashlib
import random

import numpy as np
import pytest

from distsim.llm import repeats

DOC = "doc_id long, text string"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def expected(rows, least=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - least + 1):
                s = b[i:i + least]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1 if d is not None else 0):
            if first[b[i:i + least]] < d:
                gone[i:i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(40)]

    def text(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passages = [text(rnd.randint(5, 60)) for _ in range(12)]
    rows = []
    for d in range(300):
        parts = [rnd.choice(passages)[rnd.randint(0, 20):][:rnd.randint(30, 300)]
                 if rnd.random() < 0.5 else text(rnd.randint(1, 40))
                 for _ in range(rnd.randint(0, 6))]
        rows.append((rnd.randint(0, 280) if rnd.random() < 0.1 else d, rnd.choice([" ", "\n", ""]).join(parts)))
    return rows + [
        (500, "a" * 400), (501, "a" * 120 + "b" + "a" * 60), (502, "ab" * 200), (503, "ba" * 100),
        (504, None), (505, ""), (None, rows[5][1] * 2), (506, rows[7][1]), (507, rows[7][1]),
        (507, rows[7][1]), (-3, "a" * 70), (508, "\0" * 100 + "x" * 30), (509, "y\0" * 50 + "\0" * 80)]


@pytest.mark.parametrize("seed, hot, buckets, least",
                         [(1, None, None, 50), (2, 3, 5, 50), (3, 0, 7, 50), (4, 20, 3, 30)])
def test_against_brute_force(spark, seed, hot, buckets, least):
    """Also with anchors of few occurrences dealt by single strings."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOC).repartition(5)
    found = repeats.repeat_report(df, hot=hot, buckets=buckets, least=least)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows, least)


def test_anchors_do_not_depend_on_segments(spark, monkeypatch):
    """And each string of 50 bytes within a document holds one."""
    text = "".join(t for _, t in corpus(5) if t).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([700, 701, 5000, len(text)])
    whole = repeats.anchors(data, ends)
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    for a, b in zip(whole, repeats.anchors(data, ends)):
        assert (a == b).all()
    for at in range(0, len(text) - 50):
        if not any(at < e < at + 50 for e in ends):
            assert ((whole[0] >= at) & (whole[0] <= at + 34)).any()


def test_a_passage_in_every_document(spark):
    rnd = random.Random(7)
    passage = " ".join(f"p{rnd.randint(0, 999)}" for _ in range(60))
    rows = [(d, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 80))) + passage
             + "".join(rnd.choice("uvw ") for _ in range(rnd.randint(0, 80)))) for d in range(400)]
    want = expected(rows)
    df = spark.createDataFrame(rows, DOC).repartition(7)
    for hot in (10, 10**6):
        found = repeats.repeat_report(df, hot=hot).collect()
        assert sorted(map(tuple, found), key=str) == want


def test_kept_text_extra_columns_and_empty_table(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(2, "see: " + long, 1, "x"), (1, long + "!", 2, "y"), (None, long, 3, None)]
    df = spark.createDataFrame(rows, DOC + ", tag int, spans string")
    found = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert bytes(found[2].kept) == b"see: " and found[2].n_spans == 1
    assert bytes(found[1].kept) == (long + "!").encode() and found[1].n_removed == 0
    assert bytes(found[None].kept) == long.encode()
    assert repeats.repeat_report(df.where("false")).count() == 0
    assert repeats.repeat_report(df.where("doc_id IS NULL")).count() == 1


def test_intervals_of_a_run_of_suffixes():
    lcp = [3, 5, 5, 2, 4]
    found = sorted(repeats._intervals(lcp))
    assert found == [(2, 0, 5), (3, 0, 3), (4, 4, 5), (5, 1, 3)]
