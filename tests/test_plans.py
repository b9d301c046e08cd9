"""Site summary, reports, the compiler round trip, sinks and streams."""

import json

from pyspark.sql import functions as F

from checks import page_checks as PC
from siteweave import constants as K
from siteweave.operators.signals import page_signals
from siteweave.plans import compiler as CP
from siteweave.plans import pipeline
from siteweave.plans import reports as R
from siteweave.plans import summary as S
from siteweave.sources import readers, sinks
from siteweave.sources.documents import write_reports
from siteweave.streaming import intake


def test_report_round_trip(spark, sf, tmp_path):
    sites = S.site_summary(PC.crawl(spark, sf), analysis_date="2026-01-02 03:04:05").cache()
    flat = {r["Domain"]: r for r in S.flatten(sites).collect()}
    assert len(S.flatten(sites).columns) == 84
    report = R.business_report(sites)
    back = CP.compile_reports(report.select(F.col("site_id").alias("folder"), "content")).collect()
    assert len(back) == len(flat) and back[0].asDict().keys() == dict.fromkeys(K.COMPILED_COLUMNS).keys()
    for row in back:
        want = flat[row.domain]
        plain = {"company_name": "Company Name", "email": "Email", "address": "Address", "founded_year": "Founded Year",
                 "facebook_url": "Facebook URL", "instagram_handle": "Instagram Handle", "logo_url": "Logo URL", "segmentation": "Segmentation"}
        for mine, theirs in plain.items():
            value = (want[theirs] or "").replace("Unknown", "").strip()
            assert row[mine] == " ".join(value.split()), mine
        for mine, theirs in {"mobile_phone": "Mobile Phone", "company_phone": "Company Phone"}.items():
            assert row[mine] == (want[theirs] or "").split(",")[0]
        assert row.all_google_maps_links.split("; ") == (want["All Google Maps Links"] or "").split(", ") or ", " in str(want["All Google Maps Links"])
        assert row.ssl_secure == {"Yes": "True", "No": "False"}[want["SSL Secure"]]
        assert row.min_price_product_1_name == (want["Min Price Product 1 Name"] or "")
        assert row.total_word_count == str(want["Total Word Count"]) and row.notes_for_sdr.startswith("📊 Key Insights: |")
        assert "\n" not in "".join(row)
    out = str(tmp_path / "out")
    sinks.write_csv(S.flatten(sites), f"{out}/summary_csv")
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/summary_csv")
    assert read.count() == len(flat)
    assert all(json.loads(d.document)["main_url"].startswith("http") for d in sinks.master_json(sites).collect())
    sinks.write_documents(report, f"{out}/table")
    assert write_reports(report, f"{out}/reports") == len(flat)
    for rows in (readers.read_reports(spark, f"{out}/table"), readers.read_report_files(spark, f"{out}/reports")):
        assert sorted(map(str, CP.compile_reports(rows).collect())) == sorted(map(str, back))


def test_whole_job_walks_the_graph(spark, sf):
    sites = pipeline.analyse(PC.crawl(spark, sf), analysis_date="d")
    assert sites.count() > 0 and sites.agg(F.max("max_depth")).first()[0] >= 1


def test_address_forms(spark):
    cases = {
        "12 Main Street, Springfield, CA 90210": ("Springfield", "California", "United States"),
        "1 Road, Town, ZZ 11111": ("Town", "", ""),
        "5 Rue, Lyon, Rhone, fr": ("Lyon", "Rhone", "France"),
        # a capitalised word after the comma is taken for a state code (Q17)
        "1 Road, Lyon, FRance": ("Lyon", "", ""),
        "Austin, tx": ("Austin", "Texas", "United States"), "Paris, France": ("Paris", "", "France"),
        "Lisbon, Lisboa": ("Lisbon", "Lisboa", ""), "nowhere": ("", "", ""),
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    got = {r.a: tuple(r.p) for r in df.select("a", CP.address_parts(F.col("a")).alias("p")).collect()}
    assert got == cases


def test_reports_are_picked_from_folders(spark, tmp_path):
    for name in ["one/b_comprehensive_summary.txt", "one/a_summary.txt", "two/x_summary.txt", "two/y_summary.txt", "three/note.txt"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("Domain: " + name)
    got = {r.folder: r.content for r in readers.read_report_files(spark, str(tmp_path)).collect()}
    assert got == {"one": "Domain: one/b_comprehensive_summary.txt", "two": "Domain: two/x_summary.txt"}


def test_seed_csv(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("url\nhttps://www.a.com/\n\nhttps://b.com/x?y#z\nhttps://www.a.com/\n")
    got = sorted(tuple(r) for r in readers.read_seeds(spark, str(tmp_path / "seeds.csv")).collect())
    assert got == [("a.com", "https://www.a.com/"), ("b.com", "https://b.com/x?y#z")]


def test_sitemap_parts_are_bounded_and_whole(spark, sf):
    links = PC.links(spark, sf)
    parts = sinks.sitemap_parts(links, part_size=5)
    assert parts.agg(F.sum("links")).first()[0] == sinks.sitemap_parts(links).agg(F.sum("links")).first()[0]
    assert parts.agg(F.max("links")).first()[0] < 40
    assert all(json.loads(r.entries)[0]["url"] for r in parts.limit(5).collect())


def test_stream_handles_each_url_once_and_counts_links(spark, tmp_path):
    src = tmp_path / "in"
    html = '<a href="/x">x</a><a href="https://facebook.com/y">y</a>'
    for i, urls in enumerate([["https://a.com/1", "https://a.com/2"], ["https://a.com/1", "https://b.com/1"]]):
        rows = [(j, u, html, f"2026-01-0{i + 1} 00:00:00") for j, u in enumerate(urls)]
        spark.createDataFrame(rows, "page_id bigint, url string, html string, t string").selectExpr(
            "page_id", "url", "html", "cast(t as timestamp) AS fetched_at").coalesce(1).write.mode("append").parquet(str(src))
    once = intake.each_url_once(intake.page_stream(spark, str(src), 1), "7 days").select("url")
    once.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["https://a.com/1", "https://a.com/2", "https://b.com/1"]
    seen = {}

    def keep(batch, number):
        seen.update({(r.site_id, r.link_type): r.links for r in batch.collect()})

    counts = intake.running_link_counts(intake.page_stream(spark, str(src), 1))
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {("a.com", "internal"): 3, ("a.com", "social"): 3, ("b.com", "internal"): 1, ("b.com", "social"): 1}


def test_html_is_pruned_from_url_only_plans(spark, sf):
    plan = readers.read_pages(spark, f"{sf}/pages.parquet").select("url")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan


def test_text_operators_stay_in_the_jvm(spark, sf):
    plan = page_signals(PC.crawl(spark, sf)).select("text", "anchors")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
