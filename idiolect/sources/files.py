"""Texts, answers and profiles in files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idiolect.functions import text as tx


def home(path: str | None = None) -> str:
    return path or os.environ.get("IDIOLECT_HOME") or os.path.join(os.path.expanduser("~"), ".idiolect")


def samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of text files that are not blank; each file is one sample."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(tx.strip(F.col("text")) != "")


def skipped(spark: SparkSession, paths: list[str]) -> int:
    """How many of the files are blank."""
    return spark.read.text(paths, wholetext=True).where(tx.strip(F.col("value")) == "").count()


def answers(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines' other columns and (question_id, answer) of JSON objects, values as strings. What is no object is an error."""
    got = F.from_json(F.col(column), "map<string,string>")
    checked = F.when(got.isNull() | ~tx.strip(F.col(column)).startswith("{"), F.raise_error(F.lit("answers are not a JSON object"))).otherwise(got)
    return lines.select(*(c for c in lines.columns if c != column), F.explode(checked).alias("question_id", "answer"))


PASTE_END = "."


def entered(lines: DataFrame, keys: list[str], paste: bool = False) -> DataFrame:
    """(keys, entry, text): what was typed in each session. lines: keys, n (from 0), line.

    An answer ends at a blank line that is not its first; a paste, which has paragraphs, at a line that is a full stop
    alone; the last of a session with its lines. Of a run of blank lines after an answer every second one ends an entry,
    beginning with the first, and at the start of a session with the second, as the others are first lines themselves."""
    w = Window.partitionBy(*keys).orderBy("n")
    bare = tx.strip(F.col("line"))
    if paste:
        ended = lines.withColumn("ends", bare == PASTE_END)
    else:
        filled = F.last(F.when(bare != "", F.col("n")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = lines.withColumn("filled", filled)
        place = F.col("n") - F.coalesce("filled", F.lit(-1))
        ended = rows.withColumn("ends", (bare == "") & (place % 2 == F.when(F.col("filled").isNull(), 0).otherwise(1)))
    entry = F.coalesce(F.sum(F.col("ends").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.array_sort(F.collect_list(F.when(~F.col("ends"), F.struct("n", "line"))))
    return ended.withColumn("entry", entry).groupBy(*keys, "entry").agg(tx.strip(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"))


def metric_dump(analysed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json) of all metrics of analysed texts, their word lists and recurring phrases. Texts of equal keys would
    share their lists; a null key is none."""
    from idiolect.operators import metrics, vocabulary
    from idiolect.operators.features import FEATURES

    basic = F.struct("word_count", "sentence_count", "paragraph_count", "average_sentence_length", "sentence_length_variance", "average_paragraph_length", "average_word_length", "long_word_rate", "vocabulary_diversity", "unique_word_count", "heading_count", "bullet_count")
    syntax = F.struct(*(c for k in (*metrics.PER_WORD, *metrics.PER_SENTENCE) for c in ([f"{k}_rate"] if "modal" in k else [f"{k}_count", f"{k}_rate"])), "contraction_preference", F.array(*map(F.lit, metrics.APPROXIMATE)).alias("approximate"))
    marks = F.struct(*(F.struct(*(F.col(f"{p}{m}").alias(m) for m in sorted(metrics.MARKS))).alias(n) for p, n in (("n_", "counts"), ("rate_", "rates_per_1000_words"), ("band_", "bands"))))
    rates = F.struct(*(F.col(f"{k}_rate").alias(k) for k in sorted(metrics.VOCABULARY)))
    features = F.struct(*sorted(FEATURES))
    shown = vocabulary.LISTS[:9]
    lists = vocabulary.top_lists(vocabulary.terms(analysed, keys), keys).select(*keys, *shown)
    phrases = vocabulary.recurring_phrases(analysed, keys)
    none = F.array().cast("array<string>")
    dropped = ("text", "norm", "lower", "bare", "tokens", "sentences", "sentence_tokens", "paragraphs", "lines")
    both = analysed.drop(*(c for c in dropped if c not in keys)).join(lists, keys, "left").join(phrases, keys, "left").withColumns({c: F.coalesce(c, none) for c in (*shown, "phrases")})
    whole = F.struct(basic.alias("basic"), syntax.alias("syntax"), marks.alias("punctuation"), F.struct(*shown, rates.alias("rates_per_100_words")).alias("vocabulary"), features.alias("features"), F.col("phrases").alias("recurring_phrases"), F.array(*map(F.lit, metrics.APPROXIMATE)).alias("approximate_metrics"))
    return both.select(*keys, F.to_json(whole).alias("json"))


def save_json(profiles: DataFrame, path: str) -> None:
    """(writer, json): a document a writer, after validation."""
    from idiolect.operators import profile

    bad = profile.errors(profiles)
    text = F.when(F.size(bad) == 0, profile.to_json(profiles)).otherwise(F.raise_error(F.array_join(bad, "; ")))
    profiles.select("writer", text.alias("json")).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of save_json(); missing keys have their defaults."""
    from idiolect.operators import profile

    return profile.parsed(spark.read.schema("writer string, json string").json(path))
