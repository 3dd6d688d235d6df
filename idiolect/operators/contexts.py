"""Contexts started on demand: requests for a writer's context, each with the text that would start it.

samples and requests: writer, context, text. A context is there once its samples have CONTEXT_WORDS words; a request for
one that is there changes nothing, any other keeps its text, and starts the context if that is enough.

Defined cases: labels are normalised, so requests that differ in case or blanks are one; requests without a label are left
out. Null and blank texts are no texts. A writer who is null is one of them, and one without samples has no contexts yet.
Repeated requests are one outcome, their texts counted each. Empty tables give no rows. Words are counted by sample
and summed, so neither a writer nor a context is ever in one task; what is collected are a writer's labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.functions import text as tx
from idiolect.operators.keys import joined
from idiolect.operators.profile import CONTEXT_WORDS

KNOWN, NO_TEXT, STARTED, TOO_SHORT, NO_PROFILE = "known", "no text", "started", "too short", "no profile"
NONE_YET = "none yet"
KEYS = ["writer", "context"]


def counted(samples: DataFrame) -> DataFrame:
    """(writer, context, texts, words) of the labelled samples, those without a text as none of no words."""
    rows = samples.select("writer", tx.context_label(F.col("context")).alias("context"), tx.strip(F.coalesce("text", F.lit(""))).alias("text")).where("context is not null")
    words = tx.token_count(F.col("norm")).cast("long")
    return tx.normalised(rows).groupBy(*KEYS).agg(F.sum(F.when(F.col("text") != "", 1).otherwise(0)).alias("texts"), F.sum(words).alias("words"))


def outcomes(samples: DataFrame, requests: DataFrame, writers: DataFrame | None = None) -> DataFrame:
    """(writer, context, listed, words, status) of each requested context: the contexts that its writer has, how many words
    the requested one has with the request's, and what comes of it. writers: those who have a profile; others' requests
    keep nothing."""
    had, asked = counted(samples), counted(requests)
    there = had.where(F.col("words") >= CONTEXT_WORDS)
    names = there.groupBy("writer").agg(F.array_join(F.array_sort(F.collect_list("context")), ", ").alias("listed"))
    rows = joined(asked, had.select(*KEYS, F.col("words").alias("before")), KEYS, "left")
    rows = joined(rows, names, ["writer"], "left")
    if writers is None:
        rows = rows.withColumn("profiled", F.lit(True))
    else:
        rows = joined(rows, writers.select("writer").distinct().withColumn("profiled", F.lit(True)), ["writer"], "left")
    before = F.coalesce("before", F.lit(0).cast("long"))
    ready = before >= CONTEXT_WORDS
    both = F.when(ready | F.col("profiled").isNull(), before).otherwise(before + F.col("words"))
    status = F.when(F.col("profiled").isNull(), NO_PROFILE).when(ready, KNOWN).when(F.col("texts") == 0, NO_TEXT).when(both >= CONTEXT_WORDS, STARTED).otherwise(TOO_SHORT)
    return rows.select(*KEYS, F.coalesce("listed", F.lit(NONE_YET)).alias("listed"), both.alias("words"), status.alias("status"))


def kept(requests: DataFrame, found: DataFrame) -> DataFrame:
    """The requests whose texts are to be stored, by the outcomes found for them."""
    label = requests.withColumn("context", tx.context_label(F.col("context"))).where(tx.strip(F.coalesce("text", F.lit(""))) != "")
    return joined(label, found.where(F.col("status").isin(STARTED, TOO_SHORT)), KEYS, "left_semi")
