"""Loads the given tables and derives the corpus from them with Spark."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from checks import corpus as C


#: bytes of a stored table per task: a page or customer takes many times its stored size once its HTML is read
TASK_BYTES = 1 << 20
#: rows of a table per task: a row of few bytes makes a page too
TASK_ROWS = 10_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, dealt out to all cores; a large one in more parts, so that no task grows with the table."""
    scratch(spark)
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    stored = file.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-stored // TASK_BYTES), -(-rows.count() // TASK_ROWS)))


def scratch(spark: SparkSession) -> None:
    """A local session that names no shared folder gets a folder of its own; any other has to name one."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") and sc.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def derived(spark: SparkSession, sf: str, sql: str, *names: str) -> DataFrame:
    """Run SQL over the named tables; they are passed in, so no view is left behind."""
    text = sql
    frames = {}
    for name in names:
        frames[f"t_{name}"] = table(spark, sf, name)
    for name in names:
        text = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{t_{name}}}", text)
    # literal braces of the SQL must survive formatting
    keep = {f"{{t_{n}}}" for n in names}
    parts = re.split(r"(\{t_\w+\})", text)
    safe = "".join(p if p in keep else p.replace("{", "{{").replace("}", "}}") for p in parts)
    return spark.sql(safe, **frames)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, C.CORPUS_SQL, "pages", "customer")


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, C.CRAWL_SQL, "pages", "customer")
