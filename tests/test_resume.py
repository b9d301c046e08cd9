"""Jobs that stop and are run again; why sites failed."""

import pytest

from checks import page_checks as PC
from siteweave import session
from siteweave.operators import graph as G
from siteweave.operators import pages as P
from siteweave.plans import pipeline
from siteweave.plans import summary as S
from siteweave.sources import readers


def test_a_stopped_crawl_goes_on_where_it_stopped(spark, sf, tmp_path, monkeypatch):
    PC.crawl(spark, sf).limit(60).coalesce(2).write.parquet(str(tmp_path / "pages"))
    pages, folder = spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "jobs")
    made = []
    keep = session.Stages.keep
    monkeypatch.setattr(session.Stages, "keep", lambda self, name, build: (made.append((name, self.done(name))), keep(self, name, build))[1])

    def lost(*_):
        raise RuntimeError("machine lost")

    with monkeypatch.context() as m:
        m.setattr(G, "reach", lost)
        with pytest.raises(RuntimeError, match="machine lost"):
            pipeline.resumable(pages, folder, analysis_date="d", max_depth=9)
    assert made == [("signals", False), ("links", False), ("reached", False)]
    # a stage whose writer was stopped has no success mark, and is written again
    job = next((tmp_path / "jobs").iterdir())
    (job / "links" / "_SUCCESS").unlink()
    made.clear()
    done = pipeline.resumable(pages, folder, analysis_date="d", max_depth=9)
    assert made[:3] == [("signals", True), ("links", False), ("reached", False)]
    whole = pipeline.crawl(pages, analysis_date="d", max_depth=9)
    assert sorted(map(str, done.sites.collect())) == sorted(map(str, whole.sites.select(done.sites.columns).collect()))
    made.clear()
    again = pipeline.resumable(pages, folder, analysis_date="d", max_depth=9)
    assert all(there for _, there in made) and again.sites.count() == done.sites.count()
    stages = session.Stages.of(spark, folder, pages, as_of_year=2026, analysis_date="d", max_urls=None, max_depth=9)
    assert [m["stage"] for m in stages.manifest()][:2] == ["signals", "links"] and all(m["seconds"] >= 0 for m in stages.manifest())


def test_other_parameters_or_input_are_other_jobs(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(a)
    spark.range(4).write.parquet(b)
    folder = str(tmp_path / "jobs")
    paths = {session.Stages.of(spark, folder, spark.read.parquet(p), year=y).path for p in (a, b) for y in (1, 2)}
    assert len(paths) == 4 and session.Stages.of(spark, folder, spark.read.parquet(a), year=1).path in paths
    jobs = [session.Stages.of(spark, folder, spark.read.parquet(a), year=y) for y in range(5)]
    for job in jobs:
        job.keep("x", lambda: spark.range(2))
    assert jobs[1].prune(keep=2) == 3 and jobs[1].done("x") and sum(j.done("x") for j in jobs) == 2


def test_why_sites_failed(spark):
    long = "<p>" + "word " * 400
    rows = [(1, "https://ok.com/", long, 200), (2, "https://ok.com/x", "short", 200), (3, "https://short.com/", "short", 200), (4, "https://gone.com/a", long, 404),
            (5, "https://gone.com/b", long, 404), (6, "https://gone.com/c", long + "Access Denied", 403), (7, "https://robot.com/", "solve this captcha", 503), (8, "https://none.com/", None, None)]
    pages = spark.createDataFrame([(*r, 0.1) for r in rows], "page_id bigint, url string, html string, status_code int, load_time double")
    seeds = readers.seeds(spark.createDataFrame([(f"https://{s}.com/",) for s in ("ok", "short", "gone", "robot", "none", "never")], "url string"))
    sites = P.accepted(pages).selectExpr("'ok.com' AS site_id").distinct()
    got = {r.site_id: (r.outcome, r.reason, r.pages, r.refused) for r in S.site_outcomes(seeds, pages, sites).collect()}
    assert got == {"ok.com": ("completed", None, 2, 1), "short.com": ("failed", "body of 1000 characters or less", 1, 1), "gone.com": ("failed", "status 404", 3, 3),
                   "robot.com": ("failed", "CAPTCHA Challenge", 1, 1), "none.com": ("failed", "no body", 1, 1), "never.com": ("failed", "no page stored", 0, 0)}
