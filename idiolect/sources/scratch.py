"""Tables that are written once and read several times, in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it, or the context's checkpoint folder; a folder of our own only where
    neither is set and all is one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="idiolect-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Spark's setting: a write's shuffle files go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/idiolect-{label}-{uuid.uuid4().hex}"


def cut_at(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read back; its shuffles' files are gone then, and what is written is packed well, as several
    of these tables are on disk at once."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before) if before is not None else conf.unset(SHUFFLES_GO)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: made once, whatever reads it, and not again for a lost executor."""
    return cut_at(df, scratch(df.sparkSession, label))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, on whatever file system it is, that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
