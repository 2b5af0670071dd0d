import random

import duckdb

from pyspark.sql import functions as F

from distsim.llm import conversations

TURN = "conv_id long, turn long, role string, text string"


def turns():
    rng = random.Random(4)
    rows, next_id = [], 0
    for base in range(12):
        whole = [("user" if k % 2 == 0 else "assistant", f"{rng.choice('ab')}{base % 4} <|im_end|>"[:rng.choice((2, 20))])
                 for k in range(rng.randint(1, 8))]
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(1, len(whole))
            rows += [(next_id, 10 * k, *t) for k, t in enumerate(whole[:n])]
            next_id += 1
    rows += [(500, 0, None, "x"), (501, 0, None, "x"), (501, 1, "user", None), (502, 0, "x", None),
             (503, 0, "", "x"), (504, 0, "user", ""), (505, 0, "user", None)]
    rows += [(600, 0, "user", "same"), (600, 0, "user", "same"), (601, 0, "user", "same")]
    rows += [(None, 0, "user", "lost"), (700, None, "user", "no turn"), (700, 0, "user", "then")]
    rng.shuffle(rows)
    return rows


def test_equals_sql_on_whole_prefixes(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURN + ", k int, n string")
    found = conversations.maximal_conversations(df).toPandas().sort_values("conv_id")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    expected = con.sql(conversations.SQL).df().sort_values("conv_id")
    assert list(found.conv_id) == list(expected.conv_id)
    for name in ("n_turns", "kept", "kept_as"):
        assert list(found[name]) == list(expected[name]), name
    same = (found.rendered.values == expected.rendered.values) | (
        found.rendered.isna().values & expected.rendered.isna().values)
    assert same.all()
    assert found.kept.sum() == found.rendered.notna().sum() < len(found)


def test_marks_inside_a_text_are_not_marks(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|im_end|>b")], TURN)
    [row] = conversations.maximal_conversations(df).collect()
    assert row.rendered == "<|im_start|>user\na< |im_end|>b<|im_end|>\n"


def test_null_roles_and_texts_are_told_apart(spark):
    rows = [(1, 0, None, "a"), (2, 0, "a", None), (3, 0, "", "a"), (4, 0, "a", "")]
    out = conversations.maximal_conversations(spark.createDataFrame(rows, TURN)).collect()
    assert all(r.kept for r in out) and len(out) == 4


def test_empty_table(spark):
    assert conversations.maximal_conversations(spark.createDataFrame([], TURN)).count() == 0


def test_a_conversation_in_many_ranges(spark):
    """One conversation with most of the turns, another that begins it, and a third like it."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k // 3}") for k in range(3000)]
    rows += [(2, k, r, t) for _, k, r, t in rows[:2999]] + [(3, k, r, t) for _, k, r, t in rows[:3000]]
    rows += [(4, k, r, t + "!" * (k == 1500)) for _, k, r, t in rows[:3000]]
    rows += [(5, 0, "user", "same")] * 50 + [(6, 0, "user", "same")] * 49
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set(key, "false")
    try:
        parts = conversations._laid(df).groupBy("conv_id").agg(
            F.countDistinct("part").alias("p")).collect()
        assert max(r.p for r in parts) > 1
        found = {r.conv_id: r for r in conversations.maximal_conversations(df).collect()}
    finally:
        spark.conf.set(key, before)
    assert {i: (r.n_turns, r.kept, r.kept_as) for i, r in found.items()} == {
        1: (3000, True, 1), 2: (2999, False, 1), 3: (3000, False, 1), 4: (3000, True, 4),
        5: (50, True, 5), 6: (49, False, 5)}
    marks = found[4].rendered.split("<|im_start|>")[1:]
    assert [m.split("\n")[1] for m in marks] == [
        f"turn {k // 3}" + "!" * (k == 1500) + "<|im_end|>" for k in range(3000)]
