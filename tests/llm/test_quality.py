import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from distsim.llm import quality

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1
               for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "a\n\na\n a\na", "x " * 9, "é ü#*$%&|<> " * 3,
           "one two three four five six\n" * 3, "a b c d e " * 2 + "f", "\x0b\x0cw\x1cw w"]
    for n in (4, 5, 6, 40, 3000):
        out.append(" ".join(rng.choice("abc") for _ in range(n)))
        out.append("\n".join(f"w{rng.randint(0, 3 * n)} v" for _ in range(n)))
    return out + out[3:5]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOC + ", quality_rules string, w int")
    labels = spark.createDataFrame([(13, 1, 0), (15, 0, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_base_counts_equal_brute_force(judged):
    found = {r.doc_id: r for r in quality.quality_rules(*judged).collect()}
    for i, text in enumerate(texts()):
        r = found[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
               r.base_failed)
        assert got == base(text), (i, text)
        assert not (r.base_failed and r.kept)


def test_plan_is_native(judged):
    plan = quality.quality_rules(*judged)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_ratio_tells_junk_from_trusted_text(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    good = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    junk = [" ".join(x + "&&&" for x in rng.choices(words, k=60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), DOC)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)],
                                   "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert [found[i] for i in range(80)] == [True] * 60 + [False] * 20
    again = {r.doc_id: r.kept for r in quality.quality_rules(
        docs.repartition(5), labels).collect()}
    assert again == found


def test_without_trusted_rows_the_ratio_is_zero(judged):
    docs, labels = judged
    rows = quality.quality_rules(docs, labels.where("false")).collect()
    assert {r.ratio for r in rows} == {0.0}
    assert all(r.kept != r.base_failed for r in rows)


def test_empty_table(judged):
    docs, labels = judged
    assert quality.quality_rules(docs.where("false"), labels).count() == 0


def test_documents_keep_their_columns(judged):
    docs, _ = judged
    table = [0.0] * quality.BUCKETS
    out = quality.with_quality(docs.drop("quality_rules"), table)
    assert out.columns == ["doc_id", "text", "w", "quality_rules"]
    assert out.where(F.col("quality_rules.kept")).count() > 0


def test_ratio_and_verdict_equal_brute_force(spark):
    """Buckets of words and pairs by the library's hash, counts, logarithms and the threshold."""
    rng = random.Random(8)
    good = [f"good{i}" for i in range(30)]
    bad = [f"junk{i}" for i in range(30)]
    docs = []
    for k in range(120):
        pool = good if k % 3 else bad
        docs.append((k, " ".join(rng.choice(pool + good[:5]) for _ in range(rng.randint(0, 60)))))
    docs += [(200, None), (201, ""), (202, "a b c d e " * 8), (None, " ".join(good))]
    labels = [(k, int(k % 3 > 0)) for k in range(0, 120, 2)] + [(None, 1), (4, 1)]
    buckets = 256

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").split()]
        pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(
            struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
        return [x & (buckets - 1) for x in h + pairs]

    trusted = {k for k, q in labels if q == 1 and k is not None}
    raw, seen = Counter(), Counter()
    for k, text in docs:
        raw.update(grams(text))
        if k in trusted:
            seen.update(grams(text))
    rate = sum(seen.values()) / sum(raw.values())
    table = [round(math.log((seen[b] + 16) / (raw[b] * rate + 16)), 4) for b in range(buckets)]
    found = quality.quality_rules(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"), buckets=buckets)
    got = {r.doc_id: r for r in found.collect()}
    kept = set()
    for k, text in docs:
        own, n = grams(text), len((text or "").split())
        ratio = round(sum(table[b] for b in own) / len(own), 6) if own else 0.0
        assert got[k].ratio == pytest.approx(ratio, abs=2e-6), k
        assert got[k].base_failed == (n < 10 or 100 * got[k].n_repeat_words > 20 * n)
        if abs(ratio + 0.07) > 1e-5:
            assert got[k].kept == (not got[k].base_failed and ratio >= -0.07), k
        kept.add(got[k].kept)
    assert kept == {True, False}
