import pytest
from golden import CORPUS, lines
from pyspark.sql import functions as F

import distsim as ds
from distsim.functions.text import split_fields


def column(df):
    return [r[0] for r in df.collect()]


def ngrams_of(spark, line, n=2, **options):
    return column(ds.ngrams(lines(spark, [line]), n, **options))


@pytest.mark.parametrize(
    "line, n, clean, expected",
    [
        ("", 2, False, [""]),
        ("   ", 2, False, []),
        ("a b", 3, False, ["a b"]),
        ("a b c", 2, False, ["a b", "b c"]),
        ("a  b", 2, False, ["a ", " b"]),
        (" a b ", 2, False, [" a", "a b"]),
        ("a,  b. c", 2, True, ["a b", "b c"]),
        ("...", 2, True, [""]),
        ("a b c d", 1, False, ["a", "b", "c", "d"]),
    ],
)
def test_ngrams_of_one_line(spark, line, n, clean, expected):
    assert ngrams_of(spark, line, n, clean=clean) == expected


def test_full_only_drops_short_lines(spark):
    assert ngrams_of(spark, "a b", 3, full_only=True) == []


def test_clean_line_keeps_brackets_digits_and_letters(spark):
    df = lines(spark, ["[x] (y)", "a - b_1", "été|9", "tab\tstays"])
    cleaned = column(df.select(ds.clean_line("line")))
    assert cleaned == ["[x] y", "a b1", "été9", "tab\tstays"]


def test_window_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        ds.ngrams(lines(spark, ["a"]), 0)


@pytest.mark.parametrize(
    "text, sep, expected",
    [("a,b,,", ",", ["a", "b"]), (",a", ",", ["", "a"]), ("", ",", [""]), (",,", ",", []),
     ("a\tb\t", "\t", ["a", "b"])],
)
def test_split_fields_drops_trailing_empty_fields(spark, text, sep, expected):
    df = lines(spark, [text]).select(split_fields("line", sep).alias("f"))
    assert df.first()["f"] == expected


def test_corpus_lines_split_on_breaks_and_drop_carriage_returns(spark):
    docs = spark.createDataFrame([("a b\r\nc\n",), (None,)], "text string")
    assert column(ds.corpus_lines(docs)) == ["a b", "c", ""]


def test_ngram_counts(spark):
    counts = ds.ngram_counts(lines(spark, CORPUS), 2)
    found = {r.ngram: r.n for r in counts.collect()}
    assert found["the,cat"] == 3 and found["cat,eats"] == 2
    assert sum(found.values()) == sum(len(c.split()) - 1 for c in CORPUS)


def test_ngram_counts_can_lower_before_counting(spark):
    df = lines(spark, ["The cat", "the cat"])
    assert {r.ngram: r.n for r in ds.ngram_counts(df, 2, lower=True).collect()} == {"the,cat": 2}
    assert ds.ngram_counts(df, 2).count() == 2


def test_parse_pairs_needs_two_fields(spark):
    df = lines(spark, ["a b", "a b c", "a", "a ", " b", "  ", ""])
    assert sorted(map(tuple, ds.parse_pairs(df).collect())) == [("", "b"), ("a", "b")]


def test_bigram_pairs_equal_parsed_ngrams(spark):
    df = lines(spark, CORPUS + ["", " x  y ", "one", "a  b c", "- - q"])
    for clean in (False, True):
        parsed = ds.parse_pairs(ds.ngrams(df, 2, clean), "ngram")
        direct = ds.bigram_pairs(df, clean)
        assert sorted(parsed.collect()) == sorted(direct.collect())


def test_adjacent_pairs_alnum(spark):
    df = lines(spark, ["a - b", "  don't stop! ", "café au lait", "x"])
    assert sorted(map(tuple, ds.adjacent_pairs_alnum(df).collect())) == [
        ("au", "lait"), ("caf", "au"), ("dont", "stop"),
    ]


def test_trigram_counts_and_frequencies(spark):
    df = lines(spark, ["The cat sat", "the cat sat", "a b"])
    assert [tuple(r) for r in ds.trigram_counts(df).collect()] == [("the", "cat", "sat", 2)]
    freqs = {r.word: r.freq for r in ds.word_frequencies(df).collect()}
    assert freqs["the"] == 2.0 and freqs["a"] == 1.0


def test_vector_text_round_trip(spark):
    df = spark.sql("select map('b', 2L, 'a', 1L) v union all select map('x', 3L)")
    text = df.select(ds.render_vector("v").alias("t"))
    assert sorted(column(text)) == ["a:1,b:2", "x:3"]
    back = text.select(F.map_entries(ds.parse_vector("t")).alias("e"))
    assert sorted(sorted(map(tuple, r.e)) for r in back.collect()) == [
        [("a", 1), ("b", 2)], [("x", 3)]
    ]


def test_lines_of_documents_dealt_anew(spark):
    df = spark.createDataFrame([("a\nb", 1), ("c\r\n", 2), (None, 3)], "text string, n int")
    plain = sorted(r.line for r in ds.corpus_lines(df).collect())
    dealt = ds.corpus_lines(df, partitions=3)
    assert sorted(r.line for r in dealt.collect()) == plain == ["", "a", "b", "c"]
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()


def test_cleaning_looks_no_character_up(spark):
    df = spark.createDataFrame(
        [("a\\b]c [d] (e)  f - g~",), ("   x   ",), ("~~ ~~",), ("",), ("\u00e9\U0001f600. a",), (None,)],
        "line string")
    cleaned = df.select(ds.clean_line("line").alias("c"))
    assert [r.c for r in cleaned.collect()] == [
        "ab]c [d] e f g", " x ", " ", "", "\u00e9\U0001f600 a", None]
    assert "translate" not in cleaned._jdf.queryExecution().optimizedPlan().toString()


def test_every_special_character_is_removed(spark):
    from distsim.functions.text import SPECIAL_CHARACTERS

    df = spark.createDataFrame([(c, f"a{c}b") for c in map(chr, range(33, 127))], "c string, line string")
    for r in df.select("c", ds.clean_line("line").alias("cleaned")).collect():
        assert r.cleaned == ("ab" if r.c in SPECIAL_CHARACTERS else f"a{r.c}b"), r.c


def test_trigrams_of_words_are_those_read_from_text(spark):
    lines = spark.createDataFrame(
        [("The cat, sat on the cat sat",), ("the CAT sat the cat sat",), (" cat sat on",), ("cat",), ("",)],
        "line string")
    words = spark.createDataFrame([("cat",), ("cat",), ("CAT",), ("dog",)], "word string")
    whole = ds.read_trigrams_text(ds.render_ngram_counts(ds.ngram_counts(lines, 3, clean=True)))
    expected = sorted(tuple(r) for r in whole.where("w = 'cat'").collect())
    found = ds.trigrams_of(lines, words)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert [r for r in expected if r[0] == "the"] == [("the", "cat", "sat", n) for n in (1, 1, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate(keys=[w1") < plan.index("BroadcastHashJoin")
