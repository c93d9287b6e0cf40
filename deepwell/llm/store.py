"""Where lineage is cut: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set: a temporary folder on one machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="deepwell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_BYTES = 8 << 20


def stored_bytes(df: DataFrame) -> int:
    """Of the files under a table that was read; from the file system, without a scan."""
    spark = df.sparkSession
    total = 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with the hint to broadcast it, if its files are at most ``limit`` bytes; else joins shuffle it."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """At most so many bytes in an Arrow batch: rows may be very long, and JVM and Python hold a batch each per core."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name, None)
    if have is None or not have.rstrip("b").isdigit() or int(have.rstrip("b")) > limit or int(have.rstrip("b")) <= 0:
        spark.conf.set(name, str(limit))
