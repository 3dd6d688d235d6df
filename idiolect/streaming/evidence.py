"""The evidence log as a stream: new samples are analysed as they arrive and profile inputs kept up to date.

An extension: the metrics have no windows of time, so there is no watermark. Each micro-batch appends features, a row
a sample, under its batch number; a batch that is run again after a failure replaces its own rows, so every
sample counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from idiolect.operators.features import FEATURES, features
from idiolect.sources import evidence
from idiolect.sources.store import Store


def log_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    return evidence.parsed(spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path))


def keep_features(spark: SparkSession, texts: str, out: str, checkpoint: str, keys: list[str], schema: str, files_at_once: int = 1000) -> StreamingQuery:
    """Follow a folder of JSON lines (schema: keys and text) and write features of each text, until stopped or, with
    availableNow, until all that is there is done."""

    def one(batch: DataFrame, number: int) -> None:
        rows = features(batch.where("text is not null"), keys)
        rows.select(*keys, "word_count", *FEATURES).withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(texts)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_profiles(samples: DataFrame, store: Store, name: str, checkpoint: str, now: str) -> StreamingQuery:
    """Follow a stream of samples (writer, seq, source, text, and context) and keep every writer's profile up to date. A
    batch is added to the log and the writers in it are built again; its number is committed with their profiles, so one
    that comes again after that is left out, and one that comes again before it finds its records in the log, where they
    count once. A late sample takes its place by seq."""

    def one(batch: DataFrame, number: int) -> None:
        version = store.version()
        if version is not None and version.batches.get(name, -1) >= number:
            return
        store.add(batch, timestamp=now)
        store.rebuild(now, batch=(name, number))

    return samples.writeStream.queryName(name).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_kind(log: DataFrame) -> DataFrame:
    """Running counts and words of evidence by kind: state of one row a kind."""
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))
