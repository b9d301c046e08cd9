"""Breadth-first discovery over the stored link graph (LK17, LK18)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.operators.links import complexity
from siteweave.operators.walk import depths
from siteweave.session import materialise, shared_folder


def reach(starts: DataFrame, edges: DataFrame, max_urls: int | None = None, max_depth: int | None = None) -> DataFrame:
    """LK17: URLs discovered from the main URL of each site, level by level, all sites at once.

    ``starts(site_id, url)``, ``edges(site_id, source, url, link_seq)`` with
    internal links only.  Result: ``(site_id, url, depth, position, processed)``;
    ``position`` is the place in the site's queue, ``processed`` tells whether
    the page was opened before the site reached ``max_urls``.

    Without ``max_urls`` every page is opened, so no queue is kept: ``position``
    is null and the depths come from :func:`siteweave.operators.walk.depths`.

    The cap acts between pages, as in a queue: a page is opened only while
    fewer than ``max_urls`` URLs are known, and then all its links count.
    Within a level, new URLs are ordered by (position of the parent, place on
    the page); the number known before a parent is opened is the rank of its
    first new URL.  A site has at most ``max_urls`` opened pages in all, whose
    links are what the per-site windows rank.

    Each level is written to the shared folder and read back, so a lost
    executor costs one level and plans stay small.  The loop itself fetches
    one row per level, to see whether it is done.
    """
    if max_urls is None:
        found = depths(starts, edges, max_depth)
        none = F.lit(None).cast("bigint")
        return found.select("site_id", "url", F.col("depth").cast("int").alias("depth"), none.alias("position"), F.lit(True).alias("processed"))
    spark = starts.sparkSession
    links = materialise(edges.groupBy("site_id", "source", "url").agg(F.min("link_seq").alias("link_seq")), "edges")
    folder = shared_folder(spark, "levels")
    schema = "site_id string, url string, parent bigint, position bigint, known bigint"

    def level(depth: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/depth={depth}")

    one = F.lit(1).cast("bigint")
    starts.select("site_id", "url", F.lit(0).cast("bigint").alias("parent"), one.alias("position"), one.alias("known")) \
        .write.parquet(f"{folder}/depth=0")
    by_site = Window.partitionBy("site_id")
    for depth in count() if max_depth is None else range(max_depth):
        frontier = level(depth).where(F.col("known") < max_urls)
        if frontier.isEmpty():
            break
        seen = spark.read.schema(schema).parquet(f"{folder}/depth=*").select("site_id", "url")
        found = frontier.select("site_id", F.col("url").alias("source"), F.col("position").alias("parent"), "known").join(
            links, ["site_id", "source"])
        new = found.groupBy("site_id", "url").agg(
            F.min(F.struct("parent", "link_seq")).alias("at"), F.max("known").alias("known")
        ).join(seen, ["site_id", "url"], "left_anti")
        # known + URLs first seen on earlier parents = URLs known when the parent is opened
        ranked = new.withColumn("before", F.col("known") + F.rank().over(by_site.orderBy("at.parent")) - 1)
        kept = ranked.where(F.col("before") < max_urls).withColumn(
            "position", F.col("known") + F.row_number().over(by_site.orderBy("at")))
        kept.select(
            "site_id", "url", F.col("at.parent").cast("bigint").alias("parent"), "position",
            (F.col("known") + F.count("*").over(by_site)).alias("known"),
        ).write.parquet(f"{folder}/depth={depth + 1}")
    levels = spark.read.schema(schema + ", depth int").option("basePath", folder).parquet(folder)
    # the parent whose links reach the cap is the last one opened on its level
    full = levels.where((F.col("position") >= max_urls) & (F.col("depth") > 0)).groupBy("site_id", (F.col("depth") - 1).alias("depth")).agg(
        F.min("parent").alias("last"))
    opened = (F.col("known") < max_urls) & (F.col("last").isNull() | (F.col("position") <= F.col("last")))
    return levels.join(full, ["site_id", "depth"], "left").select("site_id", "url", "depth", "position", opened.alias("processed"))


def site_edges(links: DataFrame) -> DataFrame:
    """Edge table of a classified link table: internal links by source page."""
    return links.where(F.col("link_type") == "internal").select(
        "site_id", F.col("source_page").alias("source"), "url", "link_seq")


def crawl_stats(reached: DataFrame, links: DataFrame) -> DataFrame:
    """LK18, LK19: discovered URLs, links on opened stored pages, deepest opened stored page, complexity.

    Link counts are made per page before the join, so a site with most of the
    links costs one row per page, not one per link.
    """
    per_page = links.groupBy("site_id", F.col("source_page").alias("url")).agg(F.count("*").alias("links"))
    rows = reached.join(per_page, ["site_id", "url"], "left")
    stats = rows.groupBy("site_id").agg(
        F.count("*").alias("total_pages"),
        F.sum(F.when(F.col("processed"), F.coalesce("links", F.lit(0))).otherwise(0)).alias("total_links"),
        F.max(F.when(F.col("processed") & F.col("links").isNotNull(), F.col("depth")).otherwise(0)).cast("bigint").alias("max_depth"),
    )
    return stats.withColumn("complexity", complexity(F.col("total_pages")))
