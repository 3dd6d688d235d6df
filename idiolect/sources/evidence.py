"""The evidence log: append-only JSON lines, from which every profile is rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idiolect.functions import text as tx
from idiolect.operators.calibration import NEITHER
from idiolect.operators.features import FEATURES

KINDS = ("onboarding_response", "calibration_response", "writing_sample", "manual_edit", "calibration_choice", "observed_edit")
#: Records without a seq of their own are numbered from here.
LATE = 1 << 40
REQUIRED = ("id", "timestamp", "kind", "source", "word_count")
# Fields in the order of their names, as the lines have them. seq and writer are ours: the order of a log that is many
# files, and whose it is.
SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("meta", T.StructType([
        T.StructField("chosen", T.StringType()), T.StructField("context", T.StringType()), T.StructField("formal", T.StringType()),
        T.StructField("plain", T.StringType()), T.StructField("targets", T.ArrayType(T.StringType())),
    ])),
    T.StructField("metrics", T.StructType([
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())), T.StructField("sentence_count", T.LongType()), T.StructField("word_count", T.LongType()),
    ])),
    T.StructField("prompt", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("text_ref", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("word_count", T.LongType()),
    T.StructField("writer", T.StringType()),
])


def new_id(text: Column, kind: Column, seq: Column) -> Column:
    """A kind's first four letters and twelve digits of its content's digest: equal content, equal id."""
    return F.concat(F.substring(kind, 1, 4), F.lit("_"), F.substring(F.sha2(F.concat_ws(":", kind, seq.cast("string"), text), 256), 1, 12))


def now() -> Column:
    """UTC to the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of lines of JSON. Blank and malformed lines, those that are not objects and those without a required
    field cost themselves alone; unknown fields are ignored."""
    schema = T.StructType([*SCHEMA.fields, T.StructField("__bad", T.StringType())])
    got = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = lines.where(tx.strip(F.col(column)) != "").select(*(c for c in lines.columns if c != column), got.alias("r"))
    complete = F.lit(True)
    for f in REQUIRED:
        complete = complete & F.col(f"r.{f}").isNotNull()
    return rows.where(F.col("r.__bad").isNull() & complete).select(*(c for c in rows.columns if c != "r"), *(F.col(f"r.{f.name}").alias(f.name) for f in SCHEMA.fields))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path; no rows where nothing is there yet."""
    from pyspark.errors import AnalysisException

    try:
        return parsed(spark.read.text(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def append(records: DataFrame, path: str) -> None:
    has = set(records.columns)
    records.select(*(F.col(f.name) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields)).write.mode("append").json(path)


def summarised(analysed: DataFrame) -> Column:
    """What a record keeps of an analysis: the rest can be had from the text again."""
    features = F.map_from_arrays(F.array(*(F.lit(f) for f in sorted(FEATURES))), F.array(*(F.col(f) for f in sorted(FEATURES))))
    return F.struct(features.alias("features"), F.col("sentence_count").cast("long").alias("sentence_count"), F.col("word_count").cast("long").alias("word_count"))


def records(texts: DataFrame, kind: str, timestamp: Column | None = None) -> DataFrame:
    """Records of texts (seq, source, text, and writer, context, prompt and targets where they have them), and the texts to
    store, as columns of one row: text is stripped first, text_ref names its sample."""
    from idiolect.operators.features import analyse

    if kind not in KINDS:
        raise ValueError(f"unknown kind of evidence: {kind}")
    has = lambda c, t: F.col(c) if c in texts.columns else F.lit(None).cast(t)
    rows = texts.select("seq", "source", has("writer", "string").alias("writer"), tx.strip(F.coalesce("text", F.lit(""))).alias("text"), tx.context_label(has("context", "string")).alias("context"), has("prompt", "string").alias("prompt"), has("targets", "array<string>").alias("targets"))
    done = analyse(rows)
    key = new_id(F.col("text"), F.lit(kind), F.col("seq"))
    none = F.lit(None).cast("string")
    meta = F.struct(none.alias("chosen"), F.col("context").alias("context"), none.alias("formal"), none.alias("plain"), F.col("targets").alias("targets"))
    return done.select(key.alias("id"), F.lit(kind).alias("kind"), meta.alias("meta"), summarised(done).alias("metrics"), "prompt", "source", F.concat(F.lit("samples/"), key, F.lit(".txt")).alias("text_ref"), (now() if timestamp is None else timestamp).alias("timestamp"), "word_count", "text", "seq", "writer")


def choice_records(choices: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Records of answered pairs (writer, seq, pair_id, formal, plain, chosen). No text of the writer's is in them."""
    picked = F.when(F.col("chosen").isin("") | ~((F.col("chosen") == F.col("formal")) | (F.col("chosen") == F.col("plain"))), None).otherwise(F.col("chosen"))
    key = new_id(F.concat_ws(":", "pair_id", F.coalesce(picked, F.lit(NEITHER))), F.lit("calibration_choice"), F.col("seq"))
    none = F.lit(None).cast("string")
    meta = F.struct(picked.alias("chosen"), none.alias("context"), F.col("formal"), F.col("plain"), F.lit(None).cast("array<string>").alias("targets"))
    return choices.select(key.alias("id"), F.lit("calibration_choice").alias("kind"), meta.alias("meta"), F.lit(None).cast(SCHEMA["metrics"].dataType).alias("metrics"), F.lit("Which of these would you actually write?").alias("prompt"), F.col("pair_id").alias("source"), none.alias("text_ref"), (now() if timestamp is None else timestamp).alias("timestamp"), F.lit(0).cast("long").alias("word_count"), F.col("seq").cast("long").alias("seq"), "writer")


def in_order(log: DataFrame) -> DataFrame:
    """log with a writer and a seq in every record: what has no writer is one writer's, "", and what has no seq comes by
    time and id after what has."""
    named = log.withColumn("writer", F.coalesce("writer", F.lit("")))
    if "seq" not in log.columns:
        named = named.withColumn("seq", F.lit(None).cast("long"))
    late = named.where("seq is null")
    w = Window.partitionBy("writer").orderBy("timestamp", "id")
    return named.where("seq is not null").unionByName(late.withColumn("seq", F.row_number().over(w).cast("long") + LATE))


def labelled_samples(log: DataFrame, samples: DataFrame) -> DataFrame:
    """Records joined with the samples that still exist: log's columns, seq and writer among them, text and context.
    samples: text_ref, text."""
    return log.where("text_ref is not null").join(samples, "text_ref").withColumn("context", F.col("meta.context"))


def verdicts(log: DataFrame) -> DataFrame:
    """Answered choices: log's columns and formal, plain, chosen."""
    rows = log.where("kind = 'calibration_choice'").select("*", F.col("meta.formal").alias("formal"), F.col("meta.plain").alias("plain"), F.col("meta.chosen").alias("chosen"))
    return rows.where("coalesce(formal, '') <> '' and coalesce(plain, '') <> ''")


def answered(log: DataFrame, bank: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, source, since) of the bank's questions that were answered, once each. bank: question_id."""
    known = log.join(F.broadcast(bank.select(F.col("question_id").alias("source")).distinct()), "source", "left_semi")
    return known.groupBy(*keys, "source").agg(F.min(order).alias("since"))


def answered_pairs(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    return log.where("kind = 'calibration_choice'").groupBy(*keys, "source").agg(F.min(order).alias("since"))
