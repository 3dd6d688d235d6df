"""The corpus pipeline: documents through five operators, each stage written and read again by the next, then removed.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Quality rules drop what they
reject, near-dedup keeps the smallest id of each group, decontamination drops documents with benchmark passages,
secret scans replace secrets in the texts (n_chars follows), and BPE returns token counts and digests.
Empty tables, null texts and further columns pass through as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idiolect.llm import bpe, decontam, quality, secrets, simhash
from idiolect.llm.common import cut_at, removed, scratch, table
from idiolect.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(docs, secrets.train(secrets.bundled(spark)))
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: Fingerprints, edit distances, Markov scores and BPE are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        docs = cut_at(stage(spark, docs, sf_dir), path)
        if read:
            removed(spark, read)  # the stage before this one: nothing reads it any more
        read = path
    return docs
