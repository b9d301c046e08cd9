"""Tables written to the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from siteweave.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") and sc.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))  # one process, as in tests; a cluster names its shared folder
    return shared_folder(spark, name)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(df: DataFrame) -> int:
    """Number of reduce partitions, set by whoever sizes the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
