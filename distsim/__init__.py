"""Distributional semantics over large text corpora, on Spark DataFrames."""

from .functions.render import (
    PROFILE_MEASURES,
    parse_vector,
    render_evaluation,
    render_ngram_counts,
    render_pair_counts,
    render_profiles,
    render_similarity,
    render_vector,
)
from .functions.text import clean_line, split_fields, tokenize
from .operators.counts import (
    context_counts,
    count_pairs,
    filtered_pairs,
    pair_counts,
    target_counts,
)
from .operators.ngrams import (
    adjacent_pairs_alnum,
    bigram_pairs,
    corpus_lines,
    ngram_counts,
    ngrams,
    parse_pairs,
    trigram_counts,
    trigrams_of,
    word_frequencies,
)
from .operators.profiles import (
    assoc_profiles,
    context_links,
    context_profiles,
    pair_marginals,
    pair_total,
    target_links,
    target_profiles,
)
from .operators.containment import word_keys, words_in
from .operators.nearest import nearest_neighbors
from .operators.similarity import (
    configure,
    similarity,
    target_vectors,
    thesaurus,
    vector_parts,
)
from .operators.substitution import (
    sentence_variants,
    sentence_variants_of_words,
    substitute_sentence,
    substitute_words,
)
from .operators.thesaurus import (
    context_trigrams,
    neighbor_frequencies,
    reduced_thesaurus,
    score_neighbors,
    sentence_contexts,
    shared_neighbors,
)
from .plans.chain import (
    build_profiles,
    build_thesaurus,
    calculate_similarity,
    evaluate,
    evaluate_thesaurus,
    filter_pairs,
)
from .sources.sinks import StepWriter, write_pairs_csv, write_stage
from .sources.text_files import (
    read_frequencies_text,
    read_lines,
    read_pair_counts_text,
    read_profiles_text,
    read_thesaurus_text,
    read_trigrams_text,
    sentences_from,
)

__all__ = [name for name in dir() if not name.startswith("_")]
