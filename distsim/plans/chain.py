"""The chained jobs: corpus to thesaurus, thesaurus to ranked substitutes.

``steps`` is called with the name and the rows of each intermediate table and returns
the rows to go on with: :func:`distsim.sources.sinks.no_steps` keeps one lazy plan, a
:class:`distsim.sources.sinks.StepWriter` stores every table and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts, ngrams, profiles, similarity as sim, thesaurus as thes
from ..sources.sinks import no_steps

Steps = Callable[[str, DataFrame], DataFrame]


def filter_pairs(
    pairs: DataFrame, min_freq: int = 0, min_pair: int = 1, steps: Steps = no_steps
) -> DataFrame:
    """Counted pairs that pass the word and the pair threshold."""
    counted = steps("pairs_counted", counts.count_pairs(pairs))
    targets = steps("targets_filtered", counts.target_counts(counted, min_freq))
    contexts = steps("contexts_filtered", counts.context_counts(counted, min_freq))
    kept = steps("filtered_pairs", counts.keep_frequent(counted, targets, contexts))
    return steps("pair_counts", kept.where(F.col("n") >= min_pair))


def build_profiles(pair_counts: DataFrame, steps: Steps = no_steps) -> DataFrame:
    """Association profiles of counted pairs."""
    pair_counts = counts.shared_once(pair_counts)
    steps("target_profiles", profiles.target_profiles(pair_counts))
    steps("context_profiles", profiles.context_profiles(pair_counts))
    marginals = steps("pair_marginals", profiles.pair_marginals(pair_counts))
    total = profiles.pair_total(pair_counts)
    return steps("assoc_profiles", profiles.profile_measures(marginals, total))


def calculate_similarity(
    pair_counts: DataFrame,
    sim_min: float | None = None,
    dist_max: float | None = None,
    assoc_min: float | None = None,
    distances: bool = False,
    steps: Steps = no_steps,
    **options,
) -> DataFrame:
    """Thesaurus from counted pairs or association profiles, both directions of a pair."""
    entries = steps("similarity_filtered", sim.association_filter(pair_counts, assoc_min))
    steps("target_vectors", sim.target_vectors(entries))
    pairs = sim.similarity(entries, sim_min, dist_max, None, distances, **options)
    return sim.thesaurus(steps("similarity", pairs))


def build_thesaurus(
    lines: DataFrame,
    min_freq: int = 0,
    min_pair: int = 1,
    sim_min: float | None = None,
    dist_max: float | None = None,
    assoc_min: float | None = None,
    distances: bool = False,
    clean: bool = True,
    pair_lines: bool = False,
    steps: Steps = no_steps,
    **options,
) -> DataFrame:
    """Corpus lines to thesaurus; with ``pair_lines``, lines of two words each are read.

    Needs a positive ``sim_min`` or ``all_pairs=True``. Association profiles are not
    computed on the way: similarity reads only the counts.
    """
    pairs = ngrams.parse_pairs(lines, "line") if pair_lines else ngrams.bigram_pairs(lines, clean)
    counted = filter_pairs(pairs, min_freq, min_pair, steps)
    return calculate_similarity(
        counted, sim_min, dist_max, assoc_min, distances, steps, **options
    )


def evaluate_thesaurus(
    thesaurus: DataFrame,
    frequencies: DataFrame,
    trigrams: DataFrame | Callable[[DataFrame], DataFrame],
    sentences: DataFrame,
    words: str | Sequence[str] | DataFrame,
    synonyms: int = 10,
    thesaurus_size: int = 50,
    dedupe: bool = False,
    same_sentence: bool = False,
    strict_context: bool = False,
    steps: Steps = no_steps,
) -> DataFrame:
    """Rank substitutes for each word from similarity, frequency and sentence context.

    ``words`` may be a DataFrame with a column ``target``, then with ``strict_context``.
    ``trigrams`` may be a function that gets the neighbors as a column ``word`` and returns
    their trigrams, such as one that calls :func:`~distsim.operators.ngrams.trigrams_of`.
    """
    reduced = thes.reduced_thesaurus(thesaurus, words, thesaurus_size)
    reduced = steps("reduced_thesaurus", thes.shared_neighbors(reduced))
    if callable(trigrams):
        trigrams = trigrams(reduced.select(F.col("neighbor").alias("word")))
    neighbors = steps("neighbor_frequencies", thes.neighbor_frequencies(reduced, frequencies))
    contexts = thes.sentence_contexts(sentences, words, strict_context)
    matches = steps(
        "context_trigrams", thes.context_trigrams(trigrams, contexts, reduced, same_sentence)
    )
    return steps("evaluation", thes.score_neighbors(neighbors, matches, synonyms, dedupe))


evaluate = evaluate_thesaurus
