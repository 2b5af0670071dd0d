import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from distsim.llm import resampling
from distsim.llm.repeats import _Texts

DOC = "doc_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def expected(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts([x for _, x in docs]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets))))
            for a, b in zip(s, t)]
    rows = []
    for d, text in docs:
        found, words = features(text)
        total = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(found), weight, score, None, words])
    fit = sorted((r for r in rows if r[5] >= least),
                 key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[5]))
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(rnd, n):
    words = ["alpha", "Beta", "x", "naïve", "日本語", "q" * 70, "w" * 63, "12ab", "Äpfel", "it's",
             "e" * 40, "z" * 300]
    seps = [" ", ", ", "\n", "--", ".", "\x7f", "\t "]
    out = []
    for _ in range(n):
        k = rnd.choice([0, 1, 2, 15, 25, 60])
        out.append("".join(rnd.choice(words) + rnd.choice(seps) for _ in range(k)).rstrip(" "))
    return out


def checksums(some):
    column = pa.array(some, pa.string())
    got = [[] for _ in some]
    counts, groups = resampling.feature_hashes(_Texts(column))
    for text, hashes in groups:
        for t, h in zip(text.tolist(), hashes.tolist()):
            got[t].append(h)
    return counts.tolist(), [sorted(x) for x in got]


@pytest.mark.parametrize("group", [1 << 20, 64, 256])
def test_checksums_equal_the_library(monkeypatch, group):
    monkeypatch.setattr(resampling, "GROUP", group)
    some = [*texts(random.Random(3), 200), None, "", "a", "A b", "v" * 5000 + " é" * 40, "…!"]
    want = [features(t) for t in some]
    counts, got = checksums(some)
    assert counts == [n for _, n in want]
    assert got == [sorted(zlib.crc32(f.encode()) for f in fs) for fs, _ in want]


def test_long_spans_and_constants():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 128, 1000, 70_001):
        data = rng.integers(0, 256, n).astype(np.uint8)
        zero = int(resampling.constants(np.array([n]))[0])
        assert zero == zlib.crc32(bytes(n))
        assert resampling.long_span(data) ^ zero == zlib.crc32(data.tobytes())


def test_against_plain_python(spark):
    rnd = random.Random(5)
    docs = list(enumerate(texts(rnd, 300)))
    docs += [(400, None), (401, ""), (None, "alpha beta " * 15), (None, docs[3][1]), docs[7], docs[7],
             (402, "word " * 20_000)]
    target = [*texts(rnd, 30), None]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOC + ", n_words int, score string")
    found = resampling.resample(df.repartition(4), spark.createDataFrame(
        [(t, 0) for t in target], "text string, doc_id long"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == expected(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    some = spark.createDataFrame([(1, "one two three " * 10), (2, None)], DOC)
    assert resampling.resample(none, some).count() == 0
    rows = resampling.resample(some, none, percent=100).collect()
    assert sorted(r.rank or 0 for r in rows) == [0, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are missing")
def test_on_the_given_tables(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
                    for t in ("documents", "benchmark"))
    found = sorted(map(tuple, resampling.resample(docs, target).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found == expected(rows, [r.text for r in target.collect()])
