"""Summaries merged from the states of several days against the summary of all pages."""

import math

from pyspark.sql import functions as F

from checks import page_checks as PC
from siteweave.plans import increment as I
from siteweave.plans import summary as S
from siteweave.sources import readers
from tests.test_operators import pages_of


def rows(df):
    return {r.site_id: r.asDict(recursive=True) for r in df.collect()}


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12))


def test_days_merge_to_the_whole(spark, sf, tmp_path):
    folder, days = str(tmp_path / "states"), str(tmp_path / "pages")
    PC.crawl(spark, sf).withColumn("day", F.pmod("page_id", F.lit(2))).write.partitionBy("day").parquet(days)
    pages = spark.read.parquet(days)
    seeds = readers.seeds(pages.where("page_id % 5 = 3").select("url"))
    for d in range(2):
        I.store_day(pages.where(F.col("day") == d), folder, f"d{d}", seeds)
    I.store_day(pages.where(F.col("day") == 1), folder, "d1", seeds)  # once more
    whole = rows(S.site_summary(pages, seeds, analysis_date="x"))
    got = rows(I.summary_of(spark, folder, analysis_date="x", pages=pages))
    assert got.keys() == whole.keys() and len(whole) > 20
    for site, want in whole.items():
        assert got[site].keys() == want.keys()
        for c, v in want.items():
            assert same(got[site][c], v), (site, c, got[site][c], v)


def test_a_later_link_names_an_old_page(spark, tmp_path):
    """The about page is told by a link of the next day; its text is made from that page alone."""
    story = "We have been building wooden boats beside the lake for many years. " * 4
    first = pages_of(spark, f"<html><body><main>{story}</main></body></html>", base="https://www.site.com/story")
    second = pages_of(spark, '<a href="/story0">About Us</a>', base="https://www.site.com/x").withColumn("page_id", F.lit(7).cast("bigint"))
    folder = str(tmp_path / "states")
    I.store_day(first, folder, "a")
    I.store_day(second, folder, "b")
    pages = first.unionByName(second)
    want, got = rows(S.site_summary(pages)), rows(I.summary_of(spark, folder, pages=pages))
    assert got == want and got["site.com"]["about_url"] == "https://www.site.com/story0"
