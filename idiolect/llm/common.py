"""Tables, the shared scratch folder and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


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


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there outlives a lost executor."""
    return f"{shared_dir(spark).rstrip('/')}/idiolect-{label}-{uuid.uuid4().hex}"


def cut_at(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """df, written to path and read back: its lineage ends there."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, written to a new path of the shared folder and read back."""
    return cut_at(df, scratch(df.sparkSession, label), compression)


def free(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, on whatever file system it is, that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
