"""Sinks (SNK1-SNK8).  Record builders return DataFrames; ``write_*`` store them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.operators import links as L
from siteweave.operators import pages as P
from siteweave.operators.dedup import content_hash, unique_pages
from siteweave.session import materialise


def sitemap_parts(links: DataFrame, part_size: int = 1000) -> DataFrame:
    """SNK1: unique links per site and section as JSON arrays of bounded parts.

    A section is split into parts of about ``part_size`` links by hash, so no
    row ever holds all links of a large site; small sections have one part.
    Entries of a part keep document order, and hold depth, place and context
    where the links do.
    """
    first = materialise(L.first_links(links), "first_links")
    # a stored table of one row per section: sent to all tasks while small, joined with skew splitting beyond
    sizes = materialise(first.groupBy("site_id", "section").agg(F.ceil(F.count("*") / part_size).alias("parts")), "section_sizes")
    names = [c for c in ("url", "anchor_text", "source_page", "depth", "is_navigation", "is_footer", "is_contact", "is_about", "context") if c in first.columns]
    entry = F.struct("page_id", "link_seq", *names)
    keyed = first.join(sizes, ["site_id", "section"]).withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts")))
    grouped = keyed.groupBy("site_id", "section", "part").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    shown = F.transform(F.col("e"), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return grouped.select("site_id", "section", "part", F.size("e").cast("bigint").alias("links"), F.to_json(shown).alias("entries"))


def sitemap_head(sites: DataFrame) -> DataFrame:
    """SNK1: the scalar part of the sitemap document."""
    info = F.struct("direct_links", "iframe_embeds", "javascript_maps", "structured_data_maps", "contact_page_maps",
                    F.col("all_maps").alias("all_maps_links"), "primary_maps_link", F.col("maps_status").alias("maps_integration_status"),
                    "total_maps_found")
    return sites.select("site_id", F.to_json(F.struct(
        "domain", "main_url", "total_pages", "total_links", F.col("max_depth").alias("crawl_depth_reached"),
        F.col("complexity").alias("website_structure_complexity"), info.alias("google_maps_info"))).alias("document"))


def page_records(signals: DataFrame, found: DataFrame, reached: DataFrame) -> DataFrame:
    """SNK2: the 13 metadata fields of each page; the depth is that of the crawl, 0 for a page it did not reach.

    One projection of the signals; only map links and depths, both narrow, are joined.
    """
    own_maps = found.groupBy("page_id").agg(F.sort_array(F.collect_set("map_url")).alias("google_maps_found"))
    depths = reached.select("site_id", "url", F.col("depth").alias("known_depth"))
    url, text = F.col("url"), F.col("text")
    docs = F.filter(F.transform(F.coalesce("ld", F.array().cast("array<string>")), F.trim), lambda d: F.try_parse_json(d).isNotNull())
    rows = signals.select(
        "site_id", "page_id", "url", "title", P.description().alias("description"), "status_code", "load_time",
        T.word_count(text).alias("word_count"), P.page_type(url).alias("page_type"), P.is_about_page().alias("is_about_page"),
        P.is_contact_page(url, text).alias("is_contact_page"), docs.alias("json_ld"), P.meta_maps(F.col("metas")).alias("meta_tags"))
    joined = rows.join(own_maps, "page_id", "left").join(depths, ["site_id", "url"], "left")
    before = [c for c in rows.columns if c not in ("json_ld", "meta_tags")]
    return joined.select(*before, F.coalesce("known_depth", F.lit(0)).cast("int").alias("depth"), "json_ld", "meta_tags",
                         F.coalesce("google_maps_found", F.array().cast("array<string>")).alias("google_maps_found"))


def page_json(records: DataFrame) -> DataFrame:
    """SNK2: (site_id, page_id, document)."""
    fields = [c for c in records.columns if c not in ("site_id", "page_id")]
    return records.select("site_id", "page_id", F.to_json(F.struct(*fields)).alias("document"))


def page_metadata_json(signals: DataFrame) -> DataFrame:
    """SNK2, scalar fields as one JSON document per page."""
    url, text = F.col("url"), F.col("text")
    doc = F.struct("url", "title", "status_code", "load_time", P.page_type(url).alias("page_type"), P.is_about_page().alias("is_about_page"),
                   P.is_contact_page(url, text).alias("is_contact_page"))
    return signals.select("page_id", "site_id", F.to_json(doc).alias("document"))


def html_files(pages: DataFrame) -> DataFrame:
    """SNK3: (site_id, file_name, html)."""
    # names are stored, so their size is known when the bodies meet them by page_id
    names = materialise(P.page_names(pages).select("page_id", "file_name"), "page_names")
    return pages.join(names, "page_id").select(U.site_of(F.col("url")).alias("site_id"), "file_name", "html")


def master_json(sites: DataFrame) -> DataFrame:
    """SNK4: the whole site record as one JSON document."""
    return sites.select("site_id", F.to_json(F.struct(*[F.col(c) for c in sites.columns])).alias("document"))


def unique_page_json(pages: DataFrame) -> DataFrame:
    """SNK8: (file_name, document) of the first page of each content hash."""
    kept = unique_pages(content_hash(pages))
    return kept.select(P.safe_name(F.col("url")).alias("file_name"), F.to_json(F.struct("content", "meta", "title", "url")).alias("document"))


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK5, SNK6."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_documents(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """SNK1-SNK4, SNK6-SNK8 as a table of documents, laid out by a hash of the site.

    ``buckets`` folders whatever the number of sites, each written by one task
    per part of its rows; ``site_id`` (or ``file_name``) stays a column to filter by.
    """
    key = "site_id" if "site_id" in rows.columns else "file_name"
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_site_folders(rows: DataFrame, path: str) -> None:
    """One folder per site, for few sites only: rows are clustered by site before they are written."""
    rows.repartition("site_id").write.mode("overwrite").partitionBy("site_id").json(path)
