import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from distsim.llm import toxicity

DOC = "doc_id long, text string"
LABEL = "doc_id long, quality int, toxic int"
PLAIN = "the idiot was a moron and the loser said stupid things about this worthless person".split()


@pytest.fixture(scope="module")
def letters(spark):
    rows = [(i, " ".join(random.Random(i).choices(PLAIN, k=30))) for i in range(50)]
    return toxicity.letter_model(spark.createDataFrame(rows + [(99, None)], DOC))


@pytest.mark.parametrize("written, word", [
    ("1d10t", "idiot"), ("!d!ot", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"),
    ("m0r0n", "moron"), ("l0$er", "loser"), ("s-t-u-p-i-d", "stupid"), ("idiot", "idiot"),
    ("w0rthle55", "worthless"), ("mooorooon!!", "moron"), ("(idiot)", "idiot"),
])
def test_restores_disguised_words(letters, written, word):
    assert word in toxicity.restore(written, letters)


@pytest.mark.parametrize("written, word", [
    ("iddiot", "idiot"), ("sttuupid", "stupid"), ("moronn", "moron"), ("aa", "aa"),
    ("x" * 62 + ".i.d.i.o.t." + "x" * 80, "idiot"), ("a_" * 30 + "m_o_r_o_n" + "_a" * 60, "moron"),
])
def test_restores_doubled_letters_and_words_over_a_piece_boundary(letters, written, word):
    found = toxicity.restore(written, letters)
    assert word in found or any(word in w for w in found if len(written) > toxicity.SPAN)


def test_restores_spaced_words(letters):
    words = toxicity.document_words("you are an i d i o t and M O R O N today", letters, {})
    assert {"idiot", "moron", "you", "today"} <= words
    assert toxicity.document_words("a " * 5000, letters, {})
    assert toxicity.document_words(None, letters, {}) == set()


@pytest.mark.parametrize("written", [
    "an i d i o t.", "i d i o t, yes", '"i d i o t"', "he is (i d i o t)!", "i  d  i  o  t",
    "i\td\ti\to\tt", "i\nd\ni\no\nt", "an i d ! o t", "I. D. I. O. T.",
])
def test_restores_spaced_words_with_marks_and_wide_blanks(letters, written):
    assert "idiot" in toxicity.document_words(written, letters, {})


def test_long_runs_of_marks_are_quick(letters):
    assert toxicity.spaced("... " * 20_000 + '"' * 20_000 + " ( ." * 500, letters) is not None


def test_viterbi_finds_the_cheapest_path(letters):
    """Against every path of the lattice."""
    def paths(span, at=0):
        if at == len(span):
            yield "", 0.0
            return
        for rest, cost in paths(span, at + 1):
            for emitted, own in toxicity._edges(span, at):
                yield emitted + rest, own + cost

    def price(text):
        a = b = 0
        total = 0.0
        for ch in text:
            k = toxicity._base(ch)
            total += letters[a, b, k]
            a, b = b, k
        return total + letters[a, b, 0]

    for span in ("1d10t", "l0$$er", "a b.c", "tt1|t", "h3 €!"):
        best = min((cost + price(text), text) for text, cost in paths(span))
        assert toxicity.decode(span, letters) == best[1].split()


def corpus():
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdgkmnt" for b in "aeio" for c in "lmnrst"]
    bad = ["idiot", "moron", "1d10t", "m o r o n", "idiooot"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        w = rng.choices(words, k=rng.randint(1, 60))
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(900, None), (901, ""), (902, "x" * 30_000), (903, "i d i o t " * 3000),
           (None, "moron"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows + odd],
                                 DOC + ", toxic int, words string")
    table = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], LABEL)
    found = toxicity.toxicity(docs, table).collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 40
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(
        str(r.doc_id).encode()) % 5 == 0) for r in found)
    right = [r.predicted == truth[r.doc_id] for r in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[900].score == by_id[901].score < 0.5
    assert by_id[903].predicted == by_id[None].predicted == 1


def test_rare_toxic_words_are_learned(spark):
    """Each toxic word is in about one in 75 of the toxic documents."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}{d}" for a in "bdgkmnt" for b in "aeio" for c in "lmnrst" for d in "aeiou"]
    bad = ["".join(rng.choices("bcdfghjklmnpqrstvwz", k=7)) for _ in range(75)]
    rows, labels = [], []
    for i in range(4000):
        w = rng.choices(words, k=20)
        if i % 2:
            w[rng.randrange(20)] = bad[i // 2 % 75]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, i % 2))
    found = toxicity.toxicity(spark.createDataFrame(rows, DOC),
                              spark.createDataFrame(labels, LABEL)).collect()
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 2]) > 0.95
    assert np.mean([r.predicted for r in held if r.doc_id % 2 == 0]) < 0.05


def test_labels_of_one_kind_and_empty_tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows[:20], DOC)
    none = spark.createDataFrame([], LABEL)
    clean = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABEL)
    for table in (none, clean):
        assert all(r.score < 1e-6 for r in toxicity.toxicity(docs, table).collect())
    assert toxicity.toxicity(docs.where("false"), clean).count() == 0


def test_lexicon_and_scores_equal_brute_force(spark):
    """Counts, log-odds and G2 of features by document, and the score of the evidence."""
    rng = random.Random(6)
    fine = [f"{a}{b}" for a in ("river", "garden", "window", "market", "silver", "yellow")
            for b in ("", "s", "ing")]
    docs, labels = [], []
    for k in range(240):
        toxic = k % 3 == 0
        words = [rng.choice(fine) for _ in range(rng.randint(5, 25))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(("moron", "m0r0n", "idiot", "i d i o t")))
        docs.append((k, " ".join(words)))
        if k % 5:
            labels.append((k, int(toxic)))
    docs += [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    known = {k: t for k, t in labels if zlib.crc32(str(k).encode()) % 5 != 0}
    by_text = {}
    for k, text in docs:
        if k in known:
            by_text[text] = max(by_text.get(text, 0), known[k])
    yes, no = Counter(), Counter()
    for text, t in by_text.items():
        seen = {f for w in toxicity.document_words(text, model.letters, {})
                for f in toxicity.word_features(w)}
        (yes if t else no).update(seen)
    n_yes, n_no = sum(by_text.values()), len(by_text) - sum(by_text.values())
    tried = [f for f in yes if yes[f] >= toxicity.LEAST_COUNT]
    least = max(toxicity.LEAST_G2, 2 * math.log(len(tried)))
    lexicon = {}
    for f in tried:
        a, b, share = yes[f], no[f], n_yes / (n_yes + n_no)
        w = math.log((a + 0.5) / (n_yes + 1)) - math.log((b + 0.5) / (n_no + 1))
        g2 = 2 * (a * math.log(a / ((a + b) * share))
                  + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        if w >= toxicity.LEAST_WEIGHT and g2 >= least:
            lexicon[f] = w
    assert lexicon and model.lexicon == pytest.approx(lexicon)
    found = {r.doc_id: r for r in toxicity.toxicity(df, marks).collect()}
    for k, text in docs:
        hits = []
        for w in toxicity.document_words(text, model.letters, {}):
            own = [lexicon[f] for f in toxicity.word_features(w) if f in lexicon]
            if own and max(own) > 0:
                hits.append(max(own))
        x = max(hits) + math.log(len(hits)) if hits else 0.0
        score = 1 / (1 + math.exp(-(model.slope * x + model.intercept)))
        assert found[k].score == pytest.approx(score, abs=1e-9)
        assert found[k].predicted == int(found[k].score >= 0.5)
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_a_decoded_span_depends_on_the_model_and_the_letter_before_alone(letters):
    """Choices of characters and numbers of a model are kept between calls."""
    other = letters[::-1].copy()
    spans = ["aa", "ba", "iddiot", "1d10t", "i d i o t", "\u00e9\u00e9", "", "--", "l0$er 5he"]
    first = [toxicity.decode(s, letters) for s in spans]
    turned = [toxicity.decode(s, other) for s in spans]
    assert first == [toxicity.decode(s, letters.copy()) for s in reversed(spans)][::-1]
    assert turned == [toxicity.decode(s, other.copy()) for s in spans]


def test_listed_words_are_those_with_a_feature_in_the_lexicon():
    lexicon = {"moron": 3.0, "idio~": 3.0, "stup~": 3.0, "worthl~": 2.6}
    for word in ("moron", "morons", "idio", "idiot", "stupid", "stup", "worthless", "worth", ""):
        assert toxicity._listed(word, lexicon) == any(
            f in lexicon for f in toxicity.word_features(word))
