"""Sources (SRC1-SRC4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import urls as U

PAGE_SCHEMA = "page_id bigint, url string, html string, status_code int, load_time double"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: CSV with a column ``url``."""
    rows = spark.read.csv(path, header=True)
    if "url" not in rows.columns:
        raise ValueError(f"column 'url' missing in {path}")
    return seeds(rows)


def seeds(rows: DataFrame) -> DataFrame:
    """SRC1: distinct non-null URLs with their site."""
    urls = rows.where("url is not null").select("url").distinct()
    return urls.select(U.site_of(F.col("url")).alias("site_id"), F.col("url").alias("main_url"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: stored page table."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: folders of html files, one site per folder.

    The id is a hash of the file's path.  A file does not hold its URL: the
    page is given one from its folder and name, which tells its site and kind.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    where = F.col("_metadata.file_path")
    rows = files.select(
        F.xxhash64(where).alias("page_id"), F.element_at(F.split(where, "/"), -2).alias("folder"),
        F.element_at(F.split(where, "/"), -1).alias("file_name"), F.col("value").alias("html"))
    stem = F.regexp_replace("file_name", r"\.html$", "")
    path = F.when(F.startswith(stem, F.concat("folder", F.lit("_"))), F.substr(stem, F.length("folder") + 2)).otherwise(stem)
    return rows.select(
        "page_id", F.concat(F.lit("https://"), "folder", F.lit("/"), path).alias("url"), "html", F.lit(200).alias("status_code"),
        F.lit(None).cast("double").alias("load_time"), "folder", "file_name")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC4 on the table that SNK7 writes: ``(folder, path, content)``, one report per domain."""
    rows = spark.read.parquet(path)
    return pick_reports(rows.select(F.concat_ws("/", "site_id", "file_name").alias("path"), "content"))


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC4 on text files: one report per domain folder: comprehensive ones first, then by name.

    Only file names are compared; the chosen contents are joined back by path.
    """
    files = spark.read.text(f"{path}/*/*_summary.txt", wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return pick_reports(rows)


def pick_reports(rows: DataFrame) -> DataFrame:
    """SRC4 rule on (path, content)."""
    named = rows.select("path").withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn(
        "rank", F.when(F.col("path").endswith("_comprehensive_summary.txt"), 0).when(F.col("path").endswith("_summary.txt"), 1))
    best = named.where("rank is not null").groupBy("folder").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))
    return rows.join(best, "path").select("folder", "path", "content")
