import glob
import hashlib
import os

import numpy as np
import pytest

from distsim.llm import order

DOC = "doc_id long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
@pytest.mark.parametrize("key", [0, 7])
def test_every_index_gets_a_slot(n, key):
    slots = order.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    part = order.permute(np.arange(n)[n // 2:], n, key)
    assert (part == slots[n // 2:]).all()


def test_order_depends_on_the_key_and_looks_random():
    a, b = (order.permute(np.arange(5000), 5000, k) for k in (1, 2))
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.06


def corpus():
    rows = [(i, f"text {i} é " * (i % 50)) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (None, "no id\nline"), (5, rows[5][1]),
                   (1002, "long " * 20_000)]


def test_shards_hold_every_document_once(spark, folder):
    path = f"{folder}/in"
    spark.createDataFrame([(*r, 1) for r in corpus()], DOC + ", slot int").repartition(
        4).write.parquet(path)
    docs = spark.read.parquet(path)
    options = {"length": 256, "shard_rows": 64}
    out = f"{folder}/shards"
    rows = order.training_order(docs, out, **options).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.sequence for r in rows) == list(range(n))
    stored = {r.slot: bytes(r.ids) for r in order.read_slots(spark, out, 0, n, **options).collect()}
    assert len(stored) == n
    for r in rows:
        assert hashlib.sha256(stored[r.slot]).hexdigest() == r.ids_sha256
        assert (r.shard, r.byte) == (r.slot // 64, r.slot % 64 * 257)
    # Put back in sequence, the streams of the partitions hold the documents.
    stream = b"".join(stored[r.slot] for r in sorted(rows, key=lambda r: r.sequence))
    texts = [x.strip(order.PAD) for x in stream.split(order.END)]
    assert sorted(x for x in texts if x) == sorted(t.encode() for _, t in corpus() if t)
    assert stream.count(order.END) == len(corpus())
    some = [r for r in rows if r.doc_ids.count(1002)]
    assert len(some) >= 20_000 * 5 // 256
    # Fixed stride: a file is as long as its records, and a slot is where it should be.
    files = glob.glob(f"{out}/shard=*/part-*")
    assert len(files) == -(-n // 64)
    one = next(f for f in files if "shard=0/" in f)
    assert os.path.getsize(one) == 257 * min(64, n)
    with open(one, "rb") as f:
        f.seek(257 * 3)
        assert f.read(256) == stored[3]
    # A reader resumes anywhere, across shards.
    later = order.read_slots(spark, out, 60, 10, **options).collect()
    assert {r.slot: bytes(r.ids) for r in later} == {s: stored[s] for s in range(60, 70)}


def test_empty_table(spark, folder):
    assert order.training_order(spark.createDataFrame([], DOC), f"{folder}/none").count() == 0
