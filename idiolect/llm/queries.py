"""The queries of the corpus operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from idiolect.llm import audit, bpe, bpr, chat, classifier, decontam, language, pii, quality, rolling, secrets, simhash, warc
from idiolect.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_pii that SQL can state."""
    return pii.patterns(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpr.remove_repeats(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(classifier.sample(docs, table(spark, sf_dir, "labels")))
    return classifier.scores(docs, model)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"), secrets.train(secrets.bundled(spark)))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_secrets that SQL can state."""
    return secrets.patterns(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.medians(table(spark, sf_dir, "clicks"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_chat_rotation, op3_pii, pii_patterns, op4_simhash, op5_warc, op6_suffix_dedup, op7_byte_bpe, op8_decontamination, op9_quality_classifier, op10_secrets, secret_patterns, op11_filter_audit, op12_rolling_median, op13_language_id)}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.ORACLE, "op2_chat_rotation": chat.ORACLE, "pii_patterns": pii.PATTERNS_SQL, "op5_warc": warc.ORACLE, "op6_suffix_dedup": bpr.ORACLE, "secret_patterns": secrets.PATTERNS_SQL, "op11_filter_audit": audit.ORACLE, "op12_rolling_median": rolling.ORACLE}
