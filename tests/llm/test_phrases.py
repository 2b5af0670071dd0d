import random
import re
from collections import Counter

import numpy as np
import pytest

from distsim.llm import phrases
from distsim.llm.phrases import Permutation, QuotientFilter, members, merged

DOC = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, least, longest=5, top=2000, covered=100):
    by_lang = {}
    for _, text, lang in rows:
        by_lang.setdefault(lang or "und", []).append(lowered(text))
    out = []
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held[p[i:i + k]], a)
        found = []
        for p, a in some.items():
            if 100 * held[p] >= covered * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    words = ["new", "York", "city", "the", "of", "a", "ñandú", "x-y", "don't", "日本", "\0", "Big"]
    seps = [" "] * 20 + [", ", ". ", "\n", "  ", "\t", "; ", "!", "\x0b"]
    rows = []
    for d in range(docs):
        parts = []
        for _ in range(rnd.choice([0, 1, 5, 40, 80])):
            parts.append("the new York city hall" if rnd.random() < 0.1 else rnd.choice(words))
            parts.append(rnd.choice(seps))
        rows.append((d, "".join(parts), rnd.choice(["en", "en", "de", None])))
    return rows + [rows[3], rows[3], (None, "the new york " * 20, "en"), (900, None, "en"),
                   (901, "", None), (902, "of " * 3000, "fr")]


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 32), (3, 21), (3, 22), (4, 17), (5, 12), (5, 32)])
def test_values_can_be_read_back(n, bits):
    rng = np.random.default_rng(n * bits)
    ids = [rng.integers(0, 1 << bits, 3000, dtype=np.uint64) for _ in range(n)]
    p = Permutation(n, bits)
    assert all((a == b).all() for a, b in zip(ids, p.phrases(p.values(ids))))


@pytest.mark.parametrize("n, bits, lead", [(2, 1, 0), (2, 17, 4), (3, 22, 7), (5, 12, 3), (5, 32, 6)])
def test_filters_are_lossless_and_merge(n, bits, lead):
    rng = np.random.default_rng(n + bits)
    p, want, parts = Permutation(n, bits), Counter(), {}
    for _ in range(3):
        ids = [rng.integers(0, min(1 << bits, 9), 2000, dtype=np.uint64) for _ in range(n)]
        want.update(zip(*(x.tolist() for x in ids)))
        for head, part in QuotientFilter.of(p.values(ids)).parts(min(lead, bits)):
            blob = part.encode(p, min(lead, bits))
            back = QuotientFilter.decode(blob, p, min(lead, bits), head)
            assert all((a == b).all() for a, b in zip(part.columns, back.columns))
            assert (part.counts == back.counts).all()
            parts.setdefault(head, []).append(back)
    got = Counter()
    for filters in parts.values():
        whole = merged(filters)
        got.update(dict(zip(zip(*(x.tolist() for x in p.phrases(whole.columns))),
                            whole.counts.tolist())))
    assert got == want


def test_the_quotient_is_spread():
    p = Permutation(3, 20)
    ids = [np.arange(1 << 14, dtype=np.uint64) % k + 1 for k in (1 << 14, 3, 1)]
    heads = np.bincount((p.values(ids)[0] >> np.uint64(60)).astype(int), minlength=16)
    assert heads.min() > 800 and heads.max() < 1250


def test_streams_keep_runs():
    tokens = np.array([0, 7, 0, 0, 5, 5, 9, 0, 3, 4, 0, 5, 5], np.uint32)
    assert phrases._tokens(phrases._stream(tokens, 2)).tolist() == [5, 5, 9, 0, 3, 4, 0, 5, 5, 0]
    assert phrases._tokens(phrases._stream(tokens, 3)).tolist() == [5, 5, 9, 0]
    assert phrases._tokens(phrases._stream(tokens[:0], 2)).tolist() == []


def test_members():
    rng = np.random.default_rng(4)
    all_ = [rng.integers(0, 50, 4000, dtype=np.uint64) for _ in range(2)]
    some = [x[:300] for x in all_]
    some = QuotientFilter.of(some).columns
    want = set(zip(*(x.tolist() for x in some)))
    assert members(some, all_).tolist() == [v in want for v in zip(*(x.tolist() for x in all_))]


@pytest.mark.parametrize("seed, least, longest, top, covered, buckets",
                         [(1, 5, 5, 2000, 100, None), (2, 20, 4, 7, 100, 1), (3, 2, 5, 2000, 60, 64)])
def test_against_plain_python(spark, seed, least, longest, top, covered, buckets):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", id int, shard string")
    found = phrases.phrases(df.repartition(5), least=least, longest=longest, top=top,
                            covered=covered, buckets=buckets)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == expected(rows, least, longest, top, covered)


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], DOC)
    assert phrases.phrases(df).count() == 0
    assert phrases.phrases(df.where("false")).count() == 0
    one = spark.createDataFrame([(1, "w " * 300, "en")], DOC)
    found = [tuple(r) for r in phrases.phrases(one).collect()]
    assert found == expected([(1, "w " * 300, "en")], 100)


def test_planes_give_numbers_back_and_take_little_room():
    rng = np.random.default_rng(5)
    runs = rng.poisson(1.5, 50_000)
    assert (phrases._of_planes(phrases._planes(runs)) == runs).all()
    # Less than two thirds of what numbers of four bytes take.
    assert len(phrases._planes(runs)) < 0.66 * len(phrases._packed(runs.astype(np.uint32)))
    wide = np.array([0, 255, 256, 2 ** 40, 2 ** 63 - 1], np.int64)
    assert (phrases._of_planes(phrases._planes(wide, 8), 8).astype(np.int64) == wide).all()
    assert len(phrases._of_planes(phrases._planes(np.zeros(0, np.int64)))) == 0


def test_words_of_a_shard_come_back():
    words = [b"the", "\u00e9t\u00e9".encode(), b"x" * 300, b"of"]
    counts, number = np.array([2 ** 33, 1, 7, 300]), np.array([1, 2, 70_000, 2 ** 32 - 1])
    found = phrases._unpacked_words(phrases._packed_words(words, counts, number))
    assert found[0] == words
    assert found[1].tolist() == counts.tolist() and found[2].tolist() == number.tolist()
    at, ids = phrases._unpacked_known(phrases._packed_known(number, np.uint32([5, 2 ** 32 - 1, 1, 9])))
    assert at.tolist() == number.tolist() and ids.tolist() == [5, 2 ** 32 - 1, 1, 9]
