"""The feature vector of a text: the only thing that scoring reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx
from idiolect.functions.numbers import rounded
from idiolect.operators import counting, metrics

#: Names, in order. Fixed values.
FEATURES = tuple("""
avg_sentence_length sentence_length_variance avg_paragraph_length avg_word_length long_word_rate vocabulary_diversity
contraction_rate first_person_rate second_person_rate passive_rate question_rate fragment_rate conjunction_rate
subordinate_rate initial_conjunction_rate imperative_rate hedge_rate filler_rate buzzword_rate formal_vocab_rate
colloquial_rate intensifier_rate humour_marker_rate technical_rate formal_transition_rate exclamation_rate comma_rate
semicolon_rate parenthesis_rate em_dash_rate
""".split())
RENAMED = {"avg_sentence_length": "average_sentence_length", "avg_paragraph_length": "average_paragraph_length", "avg_word_length": "average_word_length", "semicolon_rate": "rate_semicolon", "parenthesis_rate": "rate_parentheses", "em_dash_rate": "rate_em_dash"}


def analyse(df: DataFrame, text_col: str = "text", words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """df with every metric and feature of its texts as columns; a null text counts as empty.

    One Arrow function (operators/counting.py) and expressions, no shuffle. Arrays that other operators read are columns,
    too, made only where they are: tokens, sentences, sentence_tokens, paragraphs, lines."""
    out = tx.normalised(counting.in_small_batches(df), text_col).withColumn("counts", counting.counts(F.col("norm"), words))
    names = counting.fields(tuple(metrics.MARKS))
    out = metrics.measured(out.select(*(c for c in out.columns if c != "counts"), *(F.col("counts")[k].alias(k) for k in (*names, *counting.PATTERNS, "maybe", "sentence_lengths", "phrases", "vocabulary_diversity"))))
    out = out.withColumn("text_length", F.length("norm").cast("long")).withColumns(metrics.counted_patterns(words)).withColumns(metrics.counted_rates()).drop("maybe", "phrases", "smiles", *counting.PATTERNS)
    out = out.withColumns({f"band_{m}": metrics.band(m, f"rate_{m}", f"n_{m}") for m in metrics.MARKS})
    made: dict[str, Column] = {new: F.col(old) for new, old in RENAMED.items()}
    made["exclamation_rate"] = rounded(F.col("n_exclamation") * 100.0 / F.greatest(F.col("sentence_count"), F.lit(1)), 4)
    made["comma_rate"] = rounded(F.col("rate_comma") / 10.0, 4)
    return out.withColumns(made)


def features(df: DataFrame, keys: list[str], text_col: str = "text", words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """keys, word_count, sentence_count and the features."""
    return analyse(df.select(*keys, text_col), text_col, words).select(*keys, "word_count", "sentence_count", *FEATURES)


def long_form(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value)."""
    return wide.unpivot([F.col(k) for k in keys], list(FEATURES), "feature", "value")
