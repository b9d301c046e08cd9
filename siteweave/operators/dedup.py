"""Content-hash deduplication (DD1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.session import materialise


def content_hash(pages: DataFrame) -> DataFrame:
    """md5 of the page's content record with its keys in sorted order."""
    record = F.struct("content", "meta", "title", "url")
    doc = F.to_json(record, {"ignoreNullFields": "false"})
    return pages.select("page_id", "url", "title", "content", "meta", F.md5(doc).alias("content_hash"))


def unique_pages(pages: DataFrame, salts: int = 16) -> DataFrame:
    """DD1: the first page of every content hash.

    Copies are found on (hash, page_id) alone: 40 bytes per page, combined on
    the map side, so a third of all pages sharing one hash costs one row per
    task.  Hashes of several pages meet their pages over ``salts`` parts of the
    key.  The ids of the copies are stored and taken out of the bodies: where
    copies are few, no body is shuffled.
    """
    told = pages.select("content_hash", "page_id")
    several = told.groupBy("content_hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    parts = several.select("content_hash", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = told.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    copies = salted.join(parts, ["content_hash", "salt"]).where("page_id <> first").select("page_id")
    return pages.join(materialise(copies, "copies"), "page_id", "left_anti")
