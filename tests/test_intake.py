"""Stored seen set and restarted streams."""

import random

import pytest
from pyspark.sql import functions as F

from siteweave.operators import links as L
from siteweave.streaming import intake
from siteweave.streaming.seen import SeenSet

HTML = '<a href="/x">x</a><a href="https://facebook.com/y">y</a>'


def pages(spark, urls, first=0):
    return spark.createDataFrame([(first + i, u, HTML) for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def test_fresh_pages_equal_the_anti_join(spark, tmp_path):
    """Small filters, so that many answers are false and only the exact step is right."""
    rng = random.Random(3)
    seen = SeenSet(spark, str(tmp_path / "seen"), buckets=8, bits=256)
    done, false = [], 0
    for batch in range(4):
        urls = [f"https://s{rng.randint(0, 3)}.com/{rng.randint(0, 400)}" for _ in range(150)] + [None, "", None]
        rows = pages(spark, urls, batch * 1000)
        processed = spark.createDataFrame([(u,) for u in done], "url string")
        want = sorted(map(str, L.unprocessed(rows, processed).collect()))
        assert sorted(map(str, seen.fresh(rows).collect())) == want
        maybe = {r.url for r in seen.maybe_known(rows.where("url is not null").select("url").distinct()).collect()}
        assert maybe >= {u for u in urls if u is not None and u in done}
        false += len(maybe - set(done))
        for _ in range(2):  # stored twice, as a repeated batch is
            seen.add(rows.select("url"), batch)
        assert sorted(map(str, seen.fresh(rows, batch).collect())) == want
        done += urls
        if batch == 2:
            seen.compact(2)
            assert {r.batch for r in spark.read.parquet(str(tmp_path / "seen" / "filters")).select("batch").distinct().collect()} == {1, 2}
    assert false > 0
    assert sorted(r.url for r in seen.urls().select("url").distinct().collect()) == sorted({u for u in done if u is not None})


def test_new_urls_read_no_bucket_and_known_ones_only_theirs(spark, tmp_path):
    seen = SeenSet(spark, str(tmp_path / "seen"), buckets=64, bits=1 << 14)
    old = spark.range(5000).select(F.concat(F.lit("https://a.com/"), "id").alias("url"))
    seen.add(old, 0)
    new = spark.range(100).select(F.concat(F.lit("https://b.com/"), "id").alias("url"))
    maybe = seen.maybe_known(new).count()
    assert maybe <= 10 and seen.known(new).count() == 0
    few = old.limit(3).unionByName(new)
    hit = [r.bucket for r in seen.maybe_known(few).select("bucket").distinct().collect()]
    assert 1 <= len(hit) <= 13
    stored = seen.stored(hit)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r.f for r in stored.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == set(map(str, hit))
    assert seen.known(few).count() == 3


def write_arrivals(spark, src, days):
    for i, urls in enumerate(days):
        rows = [(10 * i + j, u, HTML, f"2026-01-{i + 1:02d} 00:00:00") for j, u in enumerate(urls)]
        spark.createDataFrame(rows, "page_id bigint, url string, html string, t string").selectExpr(
            "page_id", "url", "html", "cast(t as timestamp) AS fetched_at").coalesce(1).write.mode("append").parquet(src)


DAYS = [["https://a.com/1", "https://a.com/2"], ["https://a.com/1", "https://b.com/1"], ["https://b.com/1", "https://b.com/2", "https://a.com/2"]]


def test_a_stopped_stream_goes_on_without_loss_or_repeats(spark, tmp_path, monkeypatch):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    write_arrivals(spark, src, DAYS)
    seen = SeenSet(spark, str(tmp_path / "seen"), buckets=4, bits=1 << 10)
    add, calls = SeenSet.add, []

    def stops_once(self, urls, batch):
        calls.append(batch)
        if calls == [0, 1]:  # the second batch has written its pages, not yet its URLs
            raise RuntimeError("machine lost")
        add(self, urls, batch)

    monkeypatch.setattr(SeenSet, "add", stops_once)
    with pytest.raises(Exception, match="machine lost"):
        intake.store_each_url_once(intake.page_stream(spark, src, 1), seen, out, check).awaitTermination()
    intake.store_each_url_once(intake.page_stream(spark, src, 1), seen, out, check).awaitTermination()
    assert calls == [0, 1, 1, 2]
    rows = spark.read.parquet(out).select("url", "page_id", "batch").collect()
    assert sorted(map(tuple, rows)) == [("https://a.com/1", 0, 0), ("https://a.com/2", 1, 0), ("https://b.com/1", 11, 1), ("https://b.com/2", 21, 2)]


def test_counts_survive_a_stop(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    intake.durable_state(spark)
    try:
        src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
        write_arrivals(spark, src, DAYS[:2])
        intake.store_link_counts(intake.page_stream(spark, src, 1), out, check).awaitTermination()
        want = {("a.com", "internal"): 3, ("a.com", "social"): 3, ("b.com", "internal"): 1, ("b.com", "social"): 1}
        assert {(r.site_id, r.link_type): r.links for r in intake.link_counts(spark, out).collect()} == want
        # the last batch counts as not ended: it is run again from the state of the one before
        commits = tmp_path / "check" / "commits"
        last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
        (commits / str(last)).unlink()
        (commits / f".{last}.crc").unlink(missing_ok=True)
        intake.store_link_counts(intake.page_stream(spark, src, 1), out, check).awaitTermination()
        assert {(r.site_id, r.link_type): r.links for r in intake.link_counts(spark, out).collect()} == want
        write_arrivals(spark, src, DAYS)
        intake.store_link_counts(intake.page_stream(spark, src, 1), out, check).awaitTermination()
        now = {(r.site_id, r.link_type): r.links for r in intake.link_counts(spark, out).collect()}
        assert now == {("a.com", "internal"): 7, ("a.com", "social"): 7, ("b.com", "internal"): 4, ("b.com", "social"): 4}
        assert {(r.site_id, r.link_type): r.links for r in intake.link_counts(spark, out, last).collect()} == want
        assert any(tmp_path.glob("check/state/**/*.changelog")) or any(tmp_path.glob("check/state/**/*.zip"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_urls_are_forgotten_after_the_watermark(spark, tmp_path):
    """ST1 with ``within``: state goes in the batch after the one that moved the watermark past it, so the state stays bounded."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day in (1, 2, 20, 21, 40):
        spark.createDataFrame([(day, "https://a.com/1", HTML, f"2026-01-{day:02d} 00:00:00" if day < 32 else "2026-02-09 00:00:00")],
                              "page_id bigint, url string, html string, t string").selectExpr(
            "page_id", "url", "html", "cast(t as timestamp) AS fetched_at").coalesce(1).write.mode("append").parquet(src)
    once = intake.each_url_once(intake.page_stream(spark, src, 1), "5 days").select("page_id", "url")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == [1, 40]
