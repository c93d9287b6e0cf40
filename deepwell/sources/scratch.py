"""Where lineage is cut: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError

SMALL = 8 << 20


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set: a temporary folder on one machine, an error on a cluster."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local["):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        name = "file://" + tempfile.mkdtemp(prefix="deepwell-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(table: DataFrame) -> int:
    """Of the files under a table that was read."""
    spark = table.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in table.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def small(table: DataFrame, limit: int = SMALL) -> DataFrame:
    """A written table with the hint to broadcast it, if its files are small; else joins shuffle it."""
    return F.broadcast(table) if stored_bytes(table) <= limit else table
