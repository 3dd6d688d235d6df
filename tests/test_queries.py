"""Queries against their oracle SQL on the smallest tables, and the entry."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from idiolect.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["sample_arguments", "json_answers", "typed_entries", "evidence_log", "evidence_ids", "evidence_join_samples", "scripted_choices", "normalise", "tokens_count", "paragraph_split", "sentence_split", "line_kinds", "context_labels", "basic_metrics", "mtld", "mtld_in_sql", "punctuation", "syntax_metrics", "vocabulary_rates", "technical_shapes", "token_freq", "lexicon_hits", "top_lists", "prefer_list", "avoid_list", "phrase_counts", "features", "dimension_scores", "verdict_latest_wins", "avoid_merge", "dimension_priority", "weakest_dimensions", "question_rank", "answered_questions", "choice_records", "pair_rank", "confidence_movement", "describe_bands", "english_lists", "splice_block", "stream_counts", "question_selection", "sample_records", "metric_dump", "recurring_phrases", "additive_profiles", "started_contexts", "profile_documents", "rendered_profiles", "validate_profiles"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "events documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, tables, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(tables.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["writer", "dimension", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
