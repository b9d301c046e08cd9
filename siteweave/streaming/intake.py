"""Incremental page intake (ST1, ST2) with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteweave.operators.links import page_links
from siteweave.operators.signals import page_signals
from siteweave.streaming.seen import SeenSet

STREAM_SCHEMA = "page_id bigint, url string, html string, fetched_at timestamp"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def each_url_once(pages: DataFrame, within: str | None = None) -> DataFrame:
    """ST1: the first arrival of every URL.

    With ``within`` (say ``'7 days'``) the set of seen URLs is bounded by a
    watermark on ``fetched_at``; without it every URL is remembered.
    """
    if within is None:
        return pages.dropDuplicates(["url"])
    return pages.withWatermark("fetched_at", within).dropDuplicatesWithinWatermark(["url"])


def running_link_counts(pages: DataFrame) -> DataFrame:
    """ST2: links per site and type so far; use with output mode ``update`` or ``complete``.

    State is one counter per (site, type); a large site's links are counted
    within each task before they meet.
    """
    return page_links(page_signals(pages)).groupBy("site_id", "link_type").agg(F.count("*").alias("links"))


def durable_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, on the executors' disks and as changelogs in the checkpoint, instead of on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def store_each_url_once(pages: DataFrame, seen: SeenSet, out: str, checkpoint: str, compact_every: int = 50) -> StreamingQuery:
    """ST1 as a table: pages whose URL no earlier batch had, in ``out/batch=N``.

    What is known lies in the stored set, not in streaming state, so it may grow without bound and other jobs can ask it.  A batch first
    writes its pages, then adds its URLs; both replace what a stopped run of the same batch has left.
    """
    def handle(batch: DataFrame, number: int) -> None:
        seen.fresh(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.add(batch.select("url"), number)
        if number and number % compact_every == 0:
            seen.compact(number)

    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_link_counts(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """ST2 as a versioned table: the counters that a batch changed, with their new totals, in ``out/version=N``.

    A batch that is repeated after a stop writes the same version again.
    """
    def handle(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/version={number}")

    return running_link_counts(pages).writeStream.outputMode("update").foreachBatch(handle).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def link_counts(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """ST2: the counters as of a version, the latest without one: each key's row of the last batch that changed it."""
    rows = spark.read.schema("site_id string, link_type string, links bigint, version bigint").option("basePath", out).parquet(f"{out}/version=*")
    if version is not None:
        rows = rows.where(rows.version <= version)
    return rows.groupBy("site_id", "link_type").agg(F.max_by("links", "version").alias("links"))
