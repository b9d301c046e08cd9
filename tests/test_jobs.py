"""Whole jobs: every page counts, outputs read back, ids and hosts of any kind."""

import json
import random

from pyspark.sql import functions as F

from checks import page_checks as PC
from siteweave.operators import dom as D
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators import pages as P
from siteweave.operators.signals import page_signals
from siteweave.plans import compiler as CP
from siteweave.plans import documents as DOC
from siteweave.plans import pipeline
from siteweave.plans import reports as R
from siteweave.plans import summary as S
from siteweave.session import materialise
from siteweave.sources import readers, sinks
from siteweave.sources.documents import write_pieces
from tests.test_operators import pages_of


def test_summary_reads_all_pages_of_a_large_site(spark):
    html = "<html><body><p>four words on page</p><a href='/x'>x</a></body></html>"
    pages = spark.range(1300).select(F.col("id").alias("page_id"), F.concat(F.lit("https://big.com/"), "id").alias("url"), F.lit(html).alias("html"),
                                     F.lit(200).alias("status_code"), F.lit(0.5).alias("load_time"))
    row = S.site_summary(pages).first()
    assert (row.pages_analysed, row.total_words, row.internal_links) == (1300, 1300 * 5, 1300)


def test_outputs_of_a_crawl_read_back(spark, sf, tmp_path):
    done = pipeline.crawl(PC.crawl(spark, sf), analysis_date="2026-01-02 03:04:05")
    out = str(tmp_path / "out")
    pipeline.write_all(done, out)

    def table(name):
        return spark.read.parquet(f"{out}/{name}")

    sites, n_pages = done.sites.count(), done.pages.count()
    assert table("page_json").count() == table("html").count() == n_pages
    depths = {json.loads(r.document)["depth"] for r in table("page_json").collect()}
    assert max(depths) >= 1
    full = S.with_lists(done.sites, done.found, done.videos)
    flat = {r["Domain"]: r for r in S.flatten(full).collect()}
    lists = {r.site_id: (r.all_maps, r.videos) for r in full.collect()}
    first = {(r.site_id, r.section, r.url) for r in L.first_links(done.links).collect()}
    texts = ""
    for site, row in flat.items():
        base = tmp_path / "out"
        sitemap = json.loads((base / "sitemaps" / site / f"{site}_complete_sitemap.json").read_text())
        assert sitemap["domain"] == site and sitemap["google_maps_info"]["all_maps_links"] == lists[site][0]
        for section in ("internal", "external", "social", "contact"):
            urls = [e["url"] for e in sitemap[f"{section}_links"]]
            assert len(urls) == len(set(urls)) and set(urls) == {u for s, k, u in first if s == site and k == section}
        if sitemap["internal_links"]:
            assert list(sitemap["internal_links"][0]) == DOC.LONG_LINK
        master = json.loads((base / "master" / site / f"{site}_master.json").read_text())
        assert (master["all_maps"], master["videos"]) == lists[site] and master["main_url"] == row["Main URL"]
        texts += (base / "sitemaps" / site / f"{site}_sitemap_summary.txt").read_text()
    assert len(list((tmp_path / "out" / "reports").glob("*/*_comprehensive_summary.txt"))) == sites
    assert "Navigation Links (" in texts and "Footer Links (" in texts
    in_rows = {r.site_id: r.content for r in R.business_report(full).collect()}
    files = {r.folder: r.content for r in readers.read_report_files(spark, f"{out}/reports").collect()}
    assert files == in_rows
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/summary_csv")
    assert read.columns == S.flatten(full).columns
    sinks.write_csv(S.flatten(full), f"{out}/plain_csv")
    plain = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/plain_csv")
    assert sorted(map(str, read.collect())) == sorted(map(str, plain.collect()))
    back = CP.compile_reports(readers.read_report_files(spark, f"{out}/reports"))
    for r in back.collect():
        assert r.email == (flat[r.domain]["Email"] or "") and r.total_word_count == str(flat[r.domain]["Total Word Count"])


def test_a_site_of_many_links_is_written_in_pieces(spark, tmp_path):
    """No piece holds a list; the documents hold all of it, in order."""
    n = 30_000
    link = spark.range(n).select(
        F.lit("hot.com").alias("site_id"), F.col("id").alias("page_id"), F.lit(0).alias("link_seq"), F.concat(F.lit("https://hot.com/"), "id").alias("source_page"),
        F.concat(F.lit("https://facebook.com/"), "id").alias("url"), F.lit("t").alias("anchor_text"), F.lit("social").alias("link_type"), F.lit(None).cast("string").alias("context"),
        *[F.lit(False).alias(c) for c in ("is_navigation", "is_footer", "is_contact", "is_about")])
    found = spark.range(n).select(F.lit("hot.com").alias("site_id"), F.concat(F.lit("https://maps/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("map_url"))
    videos = spark.createDataFrame([("hot.com", "https://v/1")], "site_id string, video_url string")
    pages = pages_of(spark, "<title>T</title>").withColumn("url", F.lit("https://hot.com/"))
    sites = S.site_summary(pages, lists=False).withColumn("total_maps_found", F.lit(n)).withColumn("video_count", F.lit(1)).withColumn("social_links", F.lit(n))
    lists = materialise(DOC.site_lists(found, videos), "lists")
    pieces = DOC.sitemap_text(sites, link, lists).unionByName(DOC.sitemap_json(sites, link, lists)).unionByName(DOC.report_text(sites, lists))
    assert pieces.agg(F.max(F.length("text"))).first()[0] < 10_000
    assert write_pieces(pieces, DOC.ORDER, str(tmp_path / "out")) == 3
    base = tmp_path / "out" / "hot.com"
    text = (base / "hot.com_sitemap_summary.txt").read_text()
    shown = [line for line in text.split("\n") if "facebook.com" in line]
    assert shown == [f"  • https://facebook.com/{i} (from: https://hot.com/{i})" for i in range(n)]
    numbered = [line for line in (base / "hot.com_comprehensive_summary.txt").read_text().split("\n") if "https://maps/" in line]
    assert numbered == [f"  {i + 1}. https://maps/{i:06d}" for i in range(n)]
    sitemap = json.loads((base / "hot.com_complete_sitemap.json").read_text())
    assert [e["url"] for e in sitemap["social_links"]] == [f"https://facebook.com/{i}" for i in range(n)] and len(sitemap["google_maps_info"]["all_maps_links"]) == n


def test_buckets_follow_the_place_on_the_page(spark):
    html = '<nav class="main-menu"><a href="/a">a</a><a href="/b">b</a></nav><main><a href="/c">c</a></main><footer><a href="/d">d</a></footer>'
    rows = {r.bucket: r for r in L.internal_buckets(L.placed_links(D.parse(pages_of(spark, html)))).collect()}
    assert {b: r.links for b, r in rows.items()} == {"Navigation Links": 2, "General Pages": 1, "Footer Links": 1}


def test_a_tag_may_have_any_number_of_attributes(spark):
    many = "".join(f' data-a{i}="v{i}"' for i in range(450))
    rows = L.page_links(page_signals(pages_of(spark, f'<a{many} href="/x">t</a>'))).collect()
    assert [(r.url, r.anchor_text) for r in rows] == [("https://www.site.com/x", "t")]


def test_positions_of_hashed_ids(spark):
    rnd = random.Random(4)
    rows = [(rnd.getrandbits(63) - (1 << 62), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id bigint, site_id string")
    got = {r.page_id: r.position for r in P.site_positions(df, ranges=16).collect()}
    want = {}
    for site in {s for _, s in rows}:
        want |= {p: i for i, p in enumerate(sorted(p for p, s in rows if s == site))}
    assert got == want


def test_html_folder_feeds_the_engine(spark, tmp_path):
    for name in ("a.com/a.com_contact_000.html", "a.com/a.com_page_001.html", "b.org/b.org_about_000.html"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("<title>T</title><a href='/x'>x</a>")
    pages = readers.read_html_folder(spark, str(tmp_path))
    links = L.page_links(page_signals(pages)).collect()
    assert sorted((r.site_id, r.url) for r in links) == [("a.com", "https://a.com/x")] * 2 + [("b.org", "https://b.org/x")]
    assert sorted(r.page_type for r in P.page_kinds(page_signals(pages)).collect()) == ["about", "contact", "general"]
    assert pages.select("page_id").distinct().count() == 3


def test_meta_maps_equal_the_tree(spark):
    html = '<meta charset=utf-8><META Name="a" content=\'x "y" &amp; z\' data-x><meta name="n" name="m" content="">'
    pages = pages_of(spark, html)
    got = page_signals(pages).select(P.meta_maps(F.col("metas")).alias("m")).first().m
    assert [dict(m) for m in got] == [{"charset": "utf-8"}, {"name": "a", "content": 'x "y" & z', "data-x": None}, {"name": "m", "content": ""}]


def test_maps_of_all_methods_come_from_one_scan(spark, sf):
    signals = page_signals(PC.crawl(spark, sf))
    one = M.all_maps(signals)
    four = M.direct(signals).unionByName(M.iframes(signals)).unionByName(M.scripts(signals)).unionByName(M.structured(signals))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, four.collect()))


def test_page_records_without_a_crawl_have_depth_zero(spark):
    signals = page_signals(pages_of(spark, "<title>T</title>"))
    nothing = spark.createDataFrame([], "site_id string, url string, depth int")
    row = sinks.page_records(signals, M.all_maps(signals), nothing).first()
    assert (row.title, row.depth, row.google_maps_found) == ("T", 0, [])
