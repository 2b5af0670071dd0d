import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from distsim.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n", "  a", "a  ", "a \n b", "\n\nx", "x\n", "don't we'll I'M 'S's",
           "a\tb c d\x1ce\x85f", "naïve façade Ωμέγα 漢字 🙂🙃 ́x", "x1y22 ½ ² ٣",
           "<|endoftext|>", "a" * 500, "ab" * 400, "=" * 300, " " * 200, "\t" * 50 + "x",
           "!?!?... --- #$%", "word " * 3000]
    letters = "aabcdeéü 10.,'\n\t  -"
    for n in (5, 50, 500):
        out += ["".join(rng.choice(letters) for _ in range(n)) for _ in range(15)]
    out += [" ".join("".join(rng.choice("thenraio") for _ in range(rng.randint(1, 40)))
                     for _ in range(200))]
    return out + out[5:8]


def test_ids_and_bytes_equal_the_library(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, pos string")
    found = {r.doc_id: r for r in bpe.encoded(docs, PATH, P.PATTERN).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(texts()):
        ids = library.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids), text
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].ids_sha256 == sha
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_of_columns(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.withColumn("ids", bpe.encode(F.col("text"), PATH, P.PATTERN))
    out = ids.withColumn("back", bpe.decode(F.col("ids"), PATH, P.PATTERN)).collect()
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    assert ids.where("false").count() == 0


def test_recursion_and_heap_merge_alike(monkeypatch):
    encoder = bpe.Encoder(PATH, P.PATTERN)
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abetinrs \xc3\xa9") for _ in range(rng.randint(1, 90)))
             for _ in range(300)] + [b"a" * 90, b"the", b" "]
    by_query = encoder.encode_words(words)
    assert by_query == [encoder.merged(w) for w in words]


def test_memory_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "TEXTS", 2)
    encoder = bpe.Encoder(PATH, P.PATTERN)
    known = [t for t in texts() if t][:40] * 2
    for text, parts in zip(known, encoder.texts(pa.array(known))):
        ids = [int(i) for x, _, _ in parts for i in x.split()]
        assert ids == library.encode_ordinary(text)
