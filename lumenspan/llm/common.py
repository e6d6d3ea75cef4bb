"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where intermediate tables go if no shared folder is named and all runs on one machine, as in tests.
LOCAL_WORK = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{shared or LOCAL_WORK}/lumenspan"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so that a lost executor costs no recomputation and
    every later reader sees the same rows."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise wrote; nothing that is still to be computed may read it."""
    if path := getattr(df, "_written", None):
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def tagged(docs: DataFrame) -> DataFrame:
    """docs with a written number for each row, __row."""
    return materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "tagged")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: they stay on the executors' disks until the driver's JVM has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions for per_task rows each, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
