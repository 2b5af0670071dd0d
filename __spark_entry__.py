"""

Every query reads a whole test table. ``oracle_sql`` states the same result for DuckDB
on the same tables, written from the definitions: n-grams as text that is parsed again,
divergences by the union of both vectors.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import distsim as ds  # noqa: E402

try:
    from distsim.llm import queries as llm_queries
except ImportError:
    llm_queries = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

DATA = "/root/testdata"
WORDS = ["the", "of", "and"]
MIN_FREQ, MIN_PAIR, SIM_MIN = 10, 2, 0.2
MEASURES = ds.PROFILE_MEASURES


# --- inputs ------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("text")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return ds.corpus_lines(_documents(spark, sf))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The lines for counting, cut in as many tasks as a shuffle has partitions.

    What a task counts is nearly distinct and grows with its share of the documents. Splits of
    files are as large as the files have them, and what does not fit the memory is sorted on disk.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ds.corpus_lines(_documents(spark, sf), partitions=partitions)


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("text")
    return ds.corpus_lines(turns).withColumnRenamed("line", "sentence")


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    return ds.count_pairs(ds.bigram_pairs(_corpus(spark, sf), clean=True))


def _pairs(
    spark: SparkSession, sf: str, min_freq: int = MIN_FREQ, min_pair: int = MIN_PAIR
) -> DataFrame:
    return ds.pair_counts(ds.bigram_pairs(_corpus(spark, sf), clean=True), min_freq, min_pair)


def _thesaurus(spark: SparkSession, sf: str) -> DataFrame:
    ds.configure(spark)
    return ds.thesaurus(ds.similarity(_pairs(spark, sf), sim_min=SIM_MIN, packed=True))


def _nearest(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """The rows of the thesaurus that a ranking of ``size`` neighbors of all words needs."""
    return ds.nearest_neighbors(_pairs(spark, sf), size=size, sim_min=SIM_MIN, packed=True)


def _word_thesaurus(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the thesaurus that a few words need."""
    return ds.thesaurus(ds.similarity(_pairs(spark, sf), sim_min=SIM_MIN, words=WORDS))


def _reduced(spark: SparkSession, sf: str) -> DataFrame:
    return ds.reduced_thesaurus(_word_thesaurus(spark, sf), WORDS)


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return ds.word_frequencies(_corpus(spark, sf))


def _trigrams(spark: SparkSession, sf: str) -> DataFrame:
    counted = ds.ngram_counts(_corpus(spark, sf), 3, clean=True)
    return ds.read_trigrams_text(ds.render_ngram_counts(counted), grouped=True)


# --- rounding for comparison -------------------------------------------------------


def _round(name: str, digits: int = 6) -> Column:
    """Half-up rounding in plain double arithmetic, which any engine repeats exactly."""
    scale = F.lit(10.0**digits)
    return (F.floor(F.col(name) * scale + F.lit(0.5)) / scale).alias(name)


def _round_profiles(df: DataFrame) -> DataFrame:
    counts = ["target", "context", "n", "target_n", "context_n"]
    return df.select(*counts, *[_round(m) for m in MEASURES])


def _round_similarity(df: DataFrame) -> DataFrame:
    return df.select(
        "target1", "target2",
        *[_round(m) for m in ("cosine", "wjaccard", "lin", "l1", "l2")],
        *[_round(m, 4) for m in ("jsd", "askew1", "askew2")],
    )


# --- queries -----------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Ten nearest neighbors of every word of the smallest corpus."""
    ds.configure(spark)
    pairs = _pairs(spark, f"{DATA}/sf0.001")
    nearest = ds.thesaurus(ds.similarity(pairs, sim_min=SIM_MIN))
    return ds.reduced_thesaurus(nearest, size=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries: the core's own and those of the optional subpackage."""
    found = core_queries()
    if llm_queries is not None:
        found |= llm_queries.QUERIES
    if corpus_pipeline is not None:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = core_sql()
    if llm_queries is not None:
        found |= llm_queries.ORACLE_SQL
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; a suffix names a parameter variant."""

    def clean_line(s, d):
        return _lines(s, d).select("line", ds.clean_line("line").alias("cleaned"))

    def tokenize(s, d):
        return _lines(s, d).select("line", F.array_join(ds.tokenize("line"), "|").alias("tokens"),
                                   F.size(ds.tokenize("line")).cast("bigint").alias("size"))

    def target_profiles(s, d):
        return ds.target_profiles(_pairs(s, d)).select("word", "total", _round("entropy"))

    def context_profiles(s, d):
        return ds.context_profiles(_pairs(s, d)).select("word", "total", _round("entropy"))

    def pair_marginals(s, d):
        return ds.pair_marginals(_pairs(s, d)).select(
            "target", "context", "n", "target_n", _round("entropy_target"),
            "context_n", _round("entropy_context"))

    def similarity_random(s, d):
        return ds.similarity(_pairs(s, d), sim_min=SIM_MIN, seed=7, packed=True).select(
            "target1", "target2", "randomic")

    def read_thesaurus_text(s, d):
        return ds.read_thesaurus_text(ds.render_similarity(_thesaurus(s, d)))

    def read_frequencies_text(s, d):
        lines = _frequencies(s, d).select(
            F.concat_ws(" ", "word", F.col("freq").cast("bigint").cast("string")).alias("line"))
        return ds.read_frequencies_text(lines)

    def vectors(s, d):
        return ds.vector_parts(_pairs(s, d))

    def parse_vector(s, d):
        text = vectors(s, d).select("target", ds.render_vector("vector").alias("text"))
        return text.select("target", F.explode(ds.parse_vector("text")).alias("context", "n"))

    def evaluate(dedupe):
        def run(s, d):
            return ds.evaluate_thesaurus(
                _word_thesaurus(s, d), _frequencies(s, d),
                lambda neighbors: ds.trigrams_of(_corpus(s, d), neighbors), _sentences(s, d),
                WORDS, dedupe=dedupe,
            ).select("target", "neighbor", _round("score"))
        return run

    def evaluate_all_words(s, d):
        nearest = ds.shared_neighbors(_nearest(s, d, 50))
        targets = nearest.select("target").distinct()
        return ds.evaluate_thesaurus(
            nearest, _frequencies(s, d), _trigrams(s, d), _sentences(s, d), targets,
            strict_context=True,
        ).select("target", "neighbor", _round("score"))

    def context_trigrams(s, d):
        contexts = ds.sentence_contexts(_sentences(s, d), WORDS)
        reduced = ds.shared_neighbors(_reduced(s, d))
        neighbors = reduced.select(F.col("neighbor").alias("word"))
        return ds.context_trigrams(ds.trigrams_of(_corpus(s, d), neighbors), contexts, reduced)

    def render_similarity(s, d):
        ds.configure(s)
        pairs = ds.similarity(_pairs(s, d), sim_min=SIM_MIN, distances=True, packed=True)
        # The random score has a query of its own.
        return ds.render_similarity(_round_similarity(pairs).withColumn("randomic", F.lit(0.0)))

    def build_thesaurus(s, d):
        ds.configure(s)
        return _round_similarity(ds.build_thesaurus(
            _corpus(s, d), MIN_FREQ, MIN_PAIR, sim_min=SIM_MIN, distances=True, packed=True))

    def build_from_pair_lines(s, d):
        ds.configure(s)
        pairs = ds.ngrams(_corpus(s, d), 2, clean=True).withColumnRenamed("ngram", "line")
        return _round_similarity(ds.build_thesaurus(
            pairs, MIN_FREQ, MIN_PAIR, sim_min=SIM_MIN, distances=True, pair_lines=True,
            packed=True))

    def sim(**options):
        def run(s, d):
            ds.configure(s)
            return _round_similarity(ds.similarity(_pairs(s, d), **options))
        return run

    def every_word(s, d):
        ds.configure(s)
        pairs = _pairs(s, d)
        return _round_similarity(ds.similarity(
            pairs, sim_min=SIM_MIN, words=pairs.select("target").distinct(), packed=True))

    def every_target(s, d):
        return _pairs(s, d).select("target").distinct()

    def contexts_of_table(s, d):
        return ds.sentence_contexts(_sentences(s, d), every_target(s, d))

    def variants_of_table(s, d):
        return ds.sentence_variants_of_words(
            _sentences(s, d), _word_thesaurus(s, d),
            _reduced(s, d).select(F.col("neighbor").alias("target")), size=1)

    return {
        "corpus_lines": _lines,
        "sentence_lines": _sentences,
        "clean_line": clean_line,
        "tokenize": tokenize,
        "ngrams_2": lambda s, d: ds.ngrams(_lines(s, d), 2),
        "ngrams_2_clean": lambda s, d: ds.ngrams(_lines(s, d), 2, clean=True),
        "ngram_counts_3": lambda s, d: ds.ngram_counts(_corpus(s, d), 3),
        "ngram_counts_3_clean": lambda s, d: ds.ngram_counts(_corpus(s, d), 3, clean=True),
        "adjacent_pairs_alnum": lambda s, d: ds.adjacent_pairs_alnum(_lines(s, d)),
        "parse_pairs": lambda s, d: ds.parse_pairs(
            ds.ngrams(_lines(s, d), 2, clean=True), "ngram"),
        "target_counts": lambda s, d: ds.target_counts(_counted(s, d), MIN_FREQ),
        "context_counts": lambda s, d: ds.context_counts(_counted(s, d), MIN_FREQ),
        "filtered_pairs": lambda s, d: ds.filtered_pairs(_counted(s, d), MIN_FREQ),
        "pair_counts": _pairs,
        "pair_total": lambda s, d: ds.pair_total(_pairs(s, d)),
        "target_links": lambda s, d: ds.target_links(_pairs(s, d)),
        "context_links": lambda s, d: ds.context_links(_pairs(s, d)),
        "target_profiles": target_profiles,
        "context_profiles": context_profiles,
        "pair_marginals": pair_marginals,
        "assoc_profiles": lambda s, d: _round_profiles(ds.assoc_profiles(_pairs(s, d))),
        "target_vectors": lambda s, d: ds.target_vectors(_pairs(s, d)),
        "similarity": sim(sim_min=SIM_MIN, packed=True),
        "similarity_distances": sim(sim_min=SIM_MIN, distances=True, packed=True),
        "similarity_high_threshold": sim(sim_min=0.7, distances=True, packed=True),
        "similarity_assoc_min": sim(sim_min=SIM_MIN, assoc_min=3, packed=True),
        "similarity_pruned": sim(sim_min=0.7, distances=True, packed="pruned"),
        "similarity_words": sim(sim_min=SIM_MIN, distances=True, words=WORDS),
        "similarity_hybrid": sim(
            sim_min=SIM_MIN, distances=True, rare="auto", packed="hybrid"),
        "similarity_every_word": every_word,
        "nearest_neighbors": lambda s, d: _nearest(s, d, 10),
        "similarity_dist_max": sim(
            sim_min=SIM_MIN, dist_max=0.5, distances=True, packed=True),
        "similarity_random": similarity_random,
        "thesaurus": lambda s, d: _round_similarity(_thesaurus(s, d)),
        "reduced_thesaurus": _reduced,
        "reduced_thesaurus_all_words": lambda s, d: ds.reduced_thesaurus(
            _nearest(s, d, 10), size=10),
        "read_pair_counts_text": lambda s, d: ds.read_pair_counts_text(
            ds.render_pair_counts(_pairs(s, d))),
        "read_profiles_text": lambda s, d: _round_profiles(
            ds.read_profiles_text(ds.render_profiles(ds.assoc_profiles(_pairs(s, d))))),
        "read_thesaurus_text": read_thesaurus_text,
        "read_frequencies_text": read_frequencies_text,
        "read_trigrams_grouped": _trigrams,
        "read_trigrams_ungrouped": lambda s, d: ds.read_trigrams_text(
            ds.ngrams(_corpus(s, d), 3, clean=True).withColumnRenamed("ngram", "line"),
            grouped=False),
        "render_vector": lambda s, d: vectors(s, d).select(
            "target", "part", ds.render_vector("vector").alias("text")),
        "parse_vector": parse_vector,
        "render_profiles": lambda s, d: ds.render_profiles(
            _round_profiles(ds.assoc_profiles(_pairs(s, d)))),
        "render_similarity": render_similarity,
        "neighbor_frequencies": lambda s, d: ds.neighbor_frequencies(
            _reduced(s, d), _frequencies(s, d), sort=True),
        "sentence_contexts": lambda s, d: ds.sentence_contexts(_sentences(s, d), WORDS),
        "context_trigrams": context_trigrams,
        "evaluate_thesaurus": evaluate(False),
        "evaluate_thesaurus_dedupe": evaluate(True),
        "evaluate_thesaurus_all_words": evaluate_all_words,
        "sentence_variants": lambda s, d: ds.sentence_variants(
            _sentences(s, d), _word_thesaurus(s, d), "the"),
        "substitute_sentence": lambda s, d: ds.substitute_sentence(
            _sentences(s, d), _word_thesaurus(s, d), "the"),
        "substitute_words": lambda s, d: ds.substitute_words(
            _sentences(s, d), _nearest(s, d, 1)),
        "words_in_sentences": lambda s, d: ds.words_in(_sentences(s, d), every_target(s, d)),
        "sentence_contexts_of_table": contexts_of_table,
        "sentence_variants_of_table": variants_of_table,
        "substitute_inside": lambda s, d: ds.substitute_words(
            _sentences(s, d), _nearest(s, d, 1), inside=True),
        "build_thesaurus": build_thesaurus,
        "build_thesaurus_pair_lines": build_from_pair_lines,
    }


# --- SQL ---------------------------------------------------------------------------


def _r(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def _tokens(line: str) -> str:
    return (f"CASE WHEN {line} = '' THEN [''] WHEN rtrim({line}, ' ') = '' THEN [] "
            f"ELSE string_split(rtrim({line}, ' '), ' ') END")


def _clean(line: str) -> str:
    # Fixed value: the characters that cleaning removes.
    special = r"""[~!@#$^%&*\\()_+={}|;:"''<,>.?`/-]"""
    return (f"regexp_replace(regexp_replace({line}, '{special}', '', 'g'), ' +', ' ', 'g')")


def _grams(tokens: str, n: int, sep: str) -> str:
    return (f"SELECT unnest(list_transform(range(0, greatest(len(tok) - {n}, 0) + 1), "
            f"lambda i: array_to_string(tok[i + 1:i + {n}], '{sep}'))) AS ngram "
            f"FROM {tokens} WHERE len(tok) > 0")


def _filtered(min_freq: int, min_pair: int) -> str:
    return f"""SELECT target, context, n FROM counted
        WHERE n >= {min_pair}
          AND target IN (SELECT target FROM counted WHERE length(target) > 1
                         GROUP BY 1 HAVING sum(n) > {min_freq})
          AND context IN (SELECT context FROM counted WHERE length(context) > 1
                          GROUP BY 1 HAVING sum(n) > {min_freq})"""


def _rel(p: str, q: str) -> str:
    p, q = f"({p})::DOUBLE", f"({q})::DOUBLE"
    return f"{p} * ln({p} / (0.99::DOUBLE * {q} + 0.01::DOUBLE * {p}))"


def _similar(vectors: str) -> str:
    """Pairs sharing a context, with the cosine, the Lin and the Jaccard measure."""
    return f"""SELECT target1, target2,
          dot / (sqrt(x.q) * sqrt(y.q)) AS cosine,
          (shared / 2.0) / (x.s + y.s - shared / 2.0) AS wjaccard,
          shared::DOUBLE / (x.s + y.s) AS lin
        FROM (SELECT a.target AS target1, b.target AS target2,
                sum(a.n * b.n)::DOUBLE AS dot, sum(a.n + b.n)::DOUBLE AS shared
              FROM {vectors} a JOIN {vectors} b
                ON a.context = b.context AND a.target < b.target GROUP BY ALL)
        JOIN (SELECT target, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS q
              FROM {vectors} GROUP BY 1) x ON x.target = target1
        JOIN (SELECT target, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS q
              FROM {vectors} GROUP BY 1) y ON y.target = target2"""


def _distances(pairs: str, vectors: str) -> str:
    """Distances by the union of both vectors."""
    return f"""SELECT target1, target2,
          sum(abs(v1 - v2))::DOUBLE AS l1,
          sqrt(sum((v1 - v2) * (v1 - v2))::DOUBLE) AS l2,
          sum(CASE WHEN v1 > 0 AND v2 > 0
                   THEN {_rel('v1', '(v1 + v2) // 2')} + {_rel('v2', '(v1 + v2) // 2')}
                   WHEN v1 > 0 THEN {_rel('v1', 'v1 // 2')}
                   ELSE {_rel('v2', 'v2 / 2.0')} END) AS jsd,
          sum(CASE WHEN v1 > 0 THEN {_rel('v1', 'v2')} ELSE 0 END) AS askew1,
          sum(CASE WHEN v2 > 0 THEN {_rel('v2', 'v1')} ELSE 0 END) AS askew2
        FROM (SELECT target1, target2, context,
                coalesce(l.n, 0) AS v1, coalesce(r.n, 0) AS v2
              FROM (SELECT target1, target2, context, n
                    FROM {pairs} JOIN {vectors} ON target = target1) l
              FULL JOIN (SELECT target1, target2, context, n
                         FROM {pairs} JOIN {vectors} ON target = target2) r
              USING (target1, target2, context))
        GROUP BY 1, 2"""


def _measures() -> str:
    """Association measures over f, t, c, n."""
    cells = [("f", "t * c / n"), ("t - f", "t * (n - c) / n"),
             ("c - f", "(n - t) * c / n"), ("n - t - c + f", "(n - t) * (n - c) / n")]
    chi = " + ".join(
        f"CASE WHEN {e} <> 0 THEN ({o} - {e}) * ({o} - {e}) / ({e}) ELSE 0 END" for o, e in cells)
    log = " + ".join(
        f"CASE WHEN {e} <> 0 AND {o} > 0 THEN ({o}) * ln(({o}) / ({e})) ELSE 0 END"
        for o, e in cells)
    pmi = "(ln(f) - ln(t * c / n))"
    return f"""f / t AS cond_prob, {pmi} AS pmi, {pmi} / (ln(n) - ln(f)) AS npmi,
          f * {pmi} AS lmi, (f - t * c / n) / sqrt(f) AS tscore,
          (f - t * c / n) / sqrt(t * c / n) AS zscore, 2 * f / (t + c) AS dice,
          {chi} AS chisquare, 2 * ({log}) AS loglike, 0.5 * (f / t + f / c) AS affinity"""


def _entropy(role: str) -> str:
    return f"""SELECT {role} AS word, any_value(total) AS total,
          -sum(n::DOUBLE / total * ln(n::DOUBLE / total)) AS entropy
        FROM (SELECT {role}, n, (sum(n) OVER (PARTITION BY {role}))::BIGINT AS total FROM pc)
        GROUP BY 1"""


_WORDS_SQL = ", ".join(f"'{w}'" for w in WORDS)

# Common table expressions in dependency order; a query takes the ones it names.
_CTES = {
    "lines": r"SELECT regexp_replace(l, '\r$', '') AS line FROM "
             "(SELECT unnest(string_split(text, chr(10))) AS l FROM documents)",
    "sents": r"SELECT regexp_replace(l, '\r$', '') AS sentence FROM "
             "(SELECT unnest(string_split(text, chr(10))) AS l FROM conversations)",
    "cleaned": f"SELECT line, {_clean('line')} AS cleaned FROM lines",
    "toks": f"SELECT {_tokens('line')} AS tok FROM lines",
    "ctoks": f"SELECT {_tokens('cleaned')} AS tok FROM cleaned",
    "bigrams": _grams("ctoks", 2, " "),
    "parsed": "SELECT f[1] AS target, f[2] AS context FROM "
              "(SELECT string_split(rtrim(ngram, ' '), ' ') AS f FROM bigrams) WHERE len(f) = 2",
    "counted": "SELECT target, context, count(*)::BIGINT AS n FROM parsed GROUP BY 1, 2",
    "pc": _filtered(MIN_FREQ, MIN_PAIR),
    "pcassoc": "SELECT * FROM pc WHERE n > 3",
    "tprof": _entropy("target"),
    "cprof": _entropy("context"),
    "marg": """SELECT target, context, n, t.total AS target_n, t.entropy AS entropy_target,
          c.total AS context_n, c.entropy AS entropy_context
        FROM pc JOIN tprof t ON t.word = target JOIN cprof c ON c.word = context""",
    "prof": f"""SELECT target, context, o AS n, target_n, context_n, {_measures()},
          entropy_target, entropy_context
        FROM (SELECT target, context, n AS o, target_n, context_n, entropy_target,
                entropy_context, n::DOUBLE AS f, target_n::DOUBLE AS t, context_n::DOUBLE AS c,
                (SELECT sum(n) FROM pc)::DOUBLE AS n
              FROM marg)""",
    "allcos": _similar("pc"),
    "simcos": f"SELECT * FROM allcos WHERE cosine >= {SIM_MIN}",
    "simhigh": "SELECT * FROM allcos WHERE cosine >= 0.7",
    "simassoc": f"SELECT * FROM ({_similar('pcassoc')}) WHERE cosine >= {SIM_MIN}",
    "simdist": f"SELECT * FROM simcos JOIN ({_distances('simcos', 'pc')}) "
               "USING (target1, target2)",
    "simhighdist": f"SELECT * FROM simhigh JOIN ({_distances('simhigh', 'pc')}) "
                   "USING (target1, target2)",
    "thes": """SELECT target1 AS target, target2 AS neighbor, cosine FROM simcos UNION ALL
        SELECT target2, target1, cosine FROM simcos""",
    "ranked": """SELECT target, neighbor, cosine, row_number() OVER
          (PARTITION BY target ORDER BY cosine DESC, neighbor) AS rn
        FROM (SELECT target, neighbor, round_even(cosine, 6) AS cosine FROM thes)""",
    "wranked": f"""SELECT target, neighbor, row_number() OVER
          (PARTITION BY target ORDER BY round_even(cosine, 6) DESC, neighbor) AS rn
        FROM thes WHERE target IN ({_WORDS_SQL}) OR neighbor IN ({_WORDS_SQL})""",
    "reduced": f"SELECT target, neighbor, cosine FROM ranked "
               f"WHERE rn <= 50 AND target IN ({_WORDS_SQL})",
    "inside": "SELECT sentence, word FROM sents, (SELECT DISTINCT target AS word FROM pc) "
              "WHERE contains(sentence, word)",
    "words": "SELECT unnest(tok) AS w FROM ctoks",
    "freqs": "SELECT lower(w) AS word, count(*)::DOUBLE AS freq FROM words "
             "WHERE w <> '' GROUP BY 1",
    "trigram": _grams("ctoks", 3, ","),
    "tricount": "SELECT ngram, count(*)::BIGINT AS n FROM trigram GROUP BY 1",
    "tris": """SELECT lower(f[1]) AS w_prev, lower(f[2]) AS w, lower(f[3]) AS w_next, n
        FROM (SELECT string_split(ngram, ',') AS f, n FROM tricount) WHERE len(f) = 3""",
    "hits": f"""SELECT word, tok, coalesce(list_position(tok, word), 0) AS p
        FROM (SELECT word, {_tokens('sentence')} AS tok
              FROM sents, (SELECT unnest([{_WORDS_SQL}]) AS word)
              WHERE contains(sentence, word))""",
    "ctx": """SELECT word, lower(CASE WHEN p > 1 THEN tok[p - 1] ELSE '' END) AS w_prev,
          lower(word) AS target,
          lower(CASE WHEN p > 1 THEN coalesce(tok[p + 1], '') ELSE '' END) AS w_next
        FROM hits""",
    "lm": """SELECT r.target, t.w_prev, t.w, t.w_next, t.n, (a.k * b.k)::BIGINT AS weight
        FROM tris t
        JOIN reduced r ON r.neighbor = t.w
        JOIN (SELECT word, w_prev, count(*) AS k FROM ctx GROUP BY 1, 2) a
          ON a.word = r.target AND a.w_prev = t.w_prev
        JOIN (SELECT word, w_next, count(*) AS k FROM ctx GROUP BY 1, 2) b
          ON b.word = r.target AND b.w_next = t.w_next""",
    "hitsall": f"""SELECT word, tok, list_position(tok, word) AS p
        FROM (SELECT tok, unnest(list_distinct(tok)) AS word
              FROM (SELECT {_tokens('sentence')} AS tok FROM sents))
        WHERE word IN (SELECT target FROM thes)""",
    "ctxall": """SELECT word, lower(CASE WHEN p > 1 THEN tok[p - 1] ELSE '' END) AS w_prev,
          lower(coalesce(tok[p + 1], '')) AS w_next FROM hitsall""",
    "reducedall": "SELECT target, neighbor, cosine FROM ranked WHERE rn <= 50",
    "lmall": """SELECT r.target, t.w, t.n, (a.k * b.k)::BIGINT AS weight
        FROM tris t
        JOIN reducedall r ON r.neighbor = t.w
        JOIN (SELECT word, w_prev, count(*) AS k FROM ctxall GROUP BY 1, 2) a
          ON a.word = r.target AND a.w_prev = t.w_prev
        JOIN (SELECT word, w_next, count(*) AS k FROM ctxall GROUP BY 1, 2) b
          ON b.word = r.target AND b.w_next = t.w_next""",
    "scoredall": """SELECT r.target, r.neighbor,
          cosine + coalesce(ln(n + 1), 0) + ln(freq) / 10 AS score,
          unnest(range(least(coalesce(weight, 1), 10))) AS copy
        FROM reducedall r JOIN freqs ON freqs.word = r.neighbor
        LEFT JOIN lmall m ON m.target = r.target AND m.w = r.neighbor""",
    "nf": "SELECT target, neighbor, cosine, freq FROM reduced JOIN freqs ON word = neighbor",
    "scored": """SELECT nf.target, nf.neighbor,
          cosine + coalesce(ln(n + 1), 0) + ln(freq) / 10 AS score,
          unnest(range(least(coalesce(weight, 1), 10))) AS copy
        FROM nf LEFT JOIN lm ON lm.target = nf.target AND lm.w = nf.neighbor""",
    "best": "SELECT target, neighbor, max(score) AS score FROM scored GROUP BY 1, 2",
}


def _select(final: str) -> str:
    """Put the common table expressions that ``final`` needs in front of it."""
    needed, text = set(), final
    for name in reversed(_CTES):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + _CTES[name]
    ctes = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in _CTES.items() if n in needed)
    return f"WITH {ctes} {final}" if ctes else final


def _decimal(expr: str, digits: int) -> str:
    """A number in text with at most ``digits`` decimals, half-even rounded."""
    return f"rtrim(rtrim(printf('%.{digits}f', {expr}), '0'), '.')"


def _top(source: str) -> str:
    return f"""SELECT target, neighbor, {_r('score')} AS score
        FROM (SELECT *, row_number() OVER
                (PARTITION BY target ORDER BY score DESC, neighbor) AS rn FROM {source})
        WHERE rn <= 10"""


def core_sql() -> dict[str, str]:
    """DuckDB SQL per query."""
    profile = "target, context, n, target_n, context_n"
    rounded = ", ".join(f"{_r(m)} AS {m}" for m in MEASURES)
    stored = ", ".join(f"{_r(f'round({m}, 10)')} AS {m}" for m in MEASURES)
    similar = ", ".join(f"{_r(m)} AS {m}" for m in ("cosine", "wjaccard", "lin"))
    near = f"target1, target2, {similar}, 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2, " \
           "0.0::DOUBLE AS jsd, 0.0::DOUBLE AS askew1, 0.0::DOUBLE AS askew2"
    far_measures = ", ".join(
        [f"{_r(m)} AS {m}" for m in ("l1", "l2")]
        + [f"{_r(m, 4)} AS {m}" for m in ("jsd", "askew1", "askew2")])
    far = f"target1, target2, {similar}, {far_measures}"
    back = far.replace("target1, target2", "target2 AS target1, target1 AS target2", 1)
    nearback = near.replace("target1, target2", "target2 AS target1, target1 AS target2", 1)
    links = "SELECT {0} AS word, count(*)::BIGINT AS links, sum(n)::BIGINT AS total " \
            "FROM pc GROUP BY 1"
    frequent = "SELECT {0} AS word, sum(n)::BIGINT AS n FROM counted WHERE length({0}) > 1 " \
               f"GROUP BY 1 HAVING sum(n) > {MIN_FREQ}"
    nearest = "(SELECT neighbor FROM (SELECT neighbor, row_number() OVER " \
              "(ORDER BY cosine DESC, neighbor) AS k FROM reduced WHERE target = 'the') " \
              "WHERE k <= {0})"
    white = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}" \
            r"\x{202f}\x{205f}\x{3000}]+"
    profile_text = ", ".join(_decimal(_r(m), 10) for m in MEASURES)
    similarity_text = ", ".join(
        [_decimal(_r(m), 6) for m in ("cosine", "wjaccard", "lin", "l1", "l2")]
        + [_decimal(_r("jsd", 4), 6), "'0'"]
        + [_decimal(_r(m, 4), 6) for m in ("askew1", "askew2")])
    vectors = """SELECT target, context, n,
          ('0x' || left(md5(context), 8))::BIGINT % ceil(d / 500)::BIGINT AS part
        FROM (SELECT *, count(*) OVER (PARTITION BY target) AS d FROM pc)"""
    sql = {
        "corpus_lines": "SELECT line FROM lines",
        "sentence_lines": "SELECT sentence FROM sents",
        "clean_line": "SELECT line, cleaned FROM cleaned",
        "tokenize": "SELECT line, array_to_string(t, '|') AS tokens, len(t)::BIGINT AS size "
                    f"FROM (SELECT line, {_tokens('line')} AS t FROM lines)",
        "ngrams_2": _grams("toks", 2, " "),
        "ngrams_2_clean": "SELECT ngram FROM bigrams",
        "ngram_counts_3": "SELECT ngram, count(*)::BIGINT AS n FROM "
                          f"({_grams('toks', 3, ',')}) GROUP BY 1",
        "ngram_counts_3_clean": "SELECT ngram, n FROM tricount",
        "adjacent_pairs_alnum": f"""SELECT target, context FROM
            (SELECT regexp_replace(f[i], '[^A-Za-z0-9]+', '', 'g') AS target,
               regexp_replace(f[i + 1], '[^A-Za-z0-9]+', '', 'g') AS context
             FROM (SELECT f, unnest(range(1, len(f))) AS i
                   FROM (SELECT list_filter(string_split_regex(line, '{white}'),
                           lambda x: x <> '') AS f FROM lines)))
            WHERE target <> '' AND context <> ''""",
        "parse_pairs": "SELECT target, context FROM parsed",
        "target_counts": frequent.format("target"),
        "context_counts": frequent.format("context"),
        "filtered_pairs": _filtered(MIN_FREQ, 1),
        "pair_counts": "SELECT target, context, n FROM pc",
        "pair_total": "SELECT sum(n)::BIGINT AS total FROM pc",
        "target_links": links.format("target"),
        "context_links": links.format("context"),
        "target_profiles": f"SELECT word, total, {_r('entropy')} AS entropy FROM tprof",
        "context_profiles": f"SELECT word, total, {_r('entropy')} AS entropy FROM cprof",
        "pair_marginals": f"""SELECT target, context, n, target_n,
            {_r('entropy_target')} AS entropy_target, context_n,
            {_r('entropy_context')} AS entropy_context FROM marg""",
        "assoc_profiles": f"SELECT {profile}, {rounded} FROM prof",
        "target_vectors": "SELECT target, count(*)::BIGINT AS contexts, sum(n)::BIGINT AS total, "
                          "sum(n * n)::BIGINT AS sumsq FROM pc GROUP BY 1",
        "similarity": f"SELECT {near} FROM simcos",
        "similarity_distances": f"SELECT {far} FROM simdist",
        "similarity_high_threshold": f"SELECT {far} FROM simhighdist",
        "similarity_assoc_min": f"SELECT {near} FROM simassoc",
        "similarity_pruned": f"SELECT {far} FROM simhighdist",
        "similarity_words": f"SELECT {far} FROM simdist "
                            f"WHERE target1 IN ({_WORDS_SQL}) OR target2 IN ({_WORDS_SQL})",
        "similarity_hybrid": f"SELECT {far} FROM simdist",
        "similarity_every_word": f"SELECT {near} FROM simcos",
        "nearest_neighbors": "SELECT target, neighbor, cosine FROM ranked WHERE rn <= 10",
        "similarity_dist_max": f"SELECT {far} FROM simdist "
                               "WHERE NOT (lin > 0.5 AND l1 > 0.5 AND jsd > 0.5)",
        "similarity_random": """SELECT target1, target2,
            ('0x' || left(md5(concat_ws(chr(9), '7', target1, target2)), 13))::BIGINT
              * pow(2, -52) AS randomic FROM simcos""",
        "thesaurus": f"SELECT {near} FROM simcos UNION ALL SELECT {nearback} FROM simcos",
        "reduced_thesaurus": "SELECT target, neighbor, cosine FROM reduced",
        "reduced_thesaurus_all_words": "SELECT target, neighbor, cosine FROM ranked "
                                       "WHERE rn <= 10",
        "read_pair_counts_text": "SELECT target, context, n FROM pc",
        "read_profiles_text": f"SELECT {profile}, {stored} FROM prof",
        "read_thesaurus_text": "SELECT target, neighbor, round_even(cosine, 6) AS cosine "
                               "FROM thes",
        "read_frequencies_text": "SELECT word, freq FROM freqs",
        "read_trigrams_grouped": "SELECT w_prev, w, w_next, n FROM tris",
        "read_trigrams_ungrouped": """SELECT lower(f[1]) AS w_prev, lower(f[2]) AS w,
            lower(f[3]) AS w_next, count(*)::BIGINT AS n
            FROM (SELECT string_split(rtrim(replace(ngram, ',', ' '), ' '), ' ') AS f
                  FROM trigram) WHERE len(f) = 3 GROUP BY 1, 2, 3""",
        "render_vector": "SELECT target, part, string_agg(context || ':' || n, ',' "
                         f"ORDER BY context) AS text FROM ({vectors}) GROUP BY 1, 2",
        "parse_vector": "SELECT target, context, n FROM pc",
        "render_profiles": f"SELECT concat_ws(chr(9), target, '0.0', context, '0.0', n, "
                           f"target_n, context_n, {profile_text}) AS line FROM prof",
        "render_similarity": f"SELECT concat_ws(chr(9), target1, target2, {similarity_text}) "
                             "AS line FROM simdist",
        "neighbor_frequencies": "SELECT target, neighbor, cosine, freq FROM nf",
        "sentence_contexts": "SELECT word, w_prev, target, w_next FROM ctx",
        "context_trigrams": "SELECT target, w_prev, w, w_next, n, weight FROM lm",
        "evaluate_thesaurus": _top("scored"),
        "evaluate_thesaurus_dedupe": _top("best"),
        "evaluate_thesaurus_all_words": _top("scoredall"),
        "sentence_variants": f"""SELECT sentence, NULL::VARCHAR AS neighbor, sentence AS variant
            FROM sents WHERE contains(sentence, 'the')
            UNION ALL SELECT sentence, neighbor, regexp_replace(sentence,
              '(^|[^\\p{{L}}\\p{{Nd}}_])the', '\\1' || neighbor, 'g') AS variant
            FROM sents, {nearest.format(50)} WHERE contains(sentence, 'the')""",
        "substitute_sentence": "SELECT sentence, neighbor, replace(sentence, 'the', neighbor) "
                               f"AS variant FROM sents, {nearest.format(1)}",
        "substitute_words": f"""SELECT sentence, target, neighbor,
              replace(sentence, target, neighbor) AS variant
            FROM (SELECT sentence, unnest(list_distinct({_tokens('sentence')})) AS word FROM sents)
            JOIN ranked ON target = word WHERE rn = 1 AND word <> ''""",
        "words_in_sentences": "SELECT sentence, word FROM inside",
        "sentence_contexts_of_table": f"""SELECT word,
              lower(CASE WHEN p > 1 THEN tok[p - 1] ELSE '' END) AS w_prev, lower(word) AS target,
              lower(CASE WHEN p > 1 THEN coalesce(tok[p + 1], '') ELSE '' END) AS w_next
            FROM (SELECT word, tok, coalesce(list_position(tok, word), 0) AS p
                  FROM (SELECT word, {_tokens('sentence')} AS tok FROM inside))""",
        "sentence_variants_of_table": f"""SELECT sentence, word AS target, neighbor,
              CASE WHEN neighbor IS NULL THEN sentence ELSE regexp_replace(sentence,
                CASE WHEN regexp_matches(word, '^[\\p{{L}}\\p{{Nd}}_]')
                  THEN '(^|[^\\p{{L}}\\p{{Nd}}_])' ELSE '([\\p{{L}}\\p{{Nd}}_])' END
                || regexp_escape(word), '\\1' || neighbor, 'g') END AS variant
            FROM (SELECT sentence, word FROM sents, (SELECT DISTINCT neighbor AS word FROM reduced)
                  WHERE contains(sentence, word))
            JOIN (SELECT target, neighbor FROM wranked WHERE rn = 1
                  UNION ALL SELECT DISTINCT target, NULL FROM wranked) ON target = word""",
        "substitute_inside": """SELECT sentence, word AS target, neighbor,
              replace(sentence, word, neighbor) AS variant
            FROM (SELECT DISTINCT target AS word, neighbor FROM ranked WHERE rn = 1), sents
            WHERE contains(sentence, word)""",
        "build_thesaurus_pair_lines": f"SELECT {far} FROM simdist "
                                      f"UNION ALL SELECT {back} FROM simdist",
        "build_thesaurus": f"SELECT {far} FROM simdist UNION ALL SELECT {back} FROM simdist",
    }
    return {name: _select(text) for name, text in sql.items()}
