"""Jobs end to end: crawl table in, reports, JSON and CSV out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.operators import dom as D
from siteweave.operators import graph as G
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators import marketing as MK
from siteweave.operators import pages as P
from siteweave.operators.signals import page_signals
from siteweave.plans import compiler, documents, summary
from siteweave.session import Kept, Stages, materialise
from siteweave.sources import sinks
from siteweave.sources.documents import write_pieces


@dataclass
class Crawl:
    """Tables of one analysed crawl; all but the pages are stored."""

    pages: DataFrame
    signals: DataFrame
    links: DataFrame
    reached: DataFrame
    sites: DataFrame  # without the lists that grow with a site
    found: DataFrame  # map links
    videos: DataFrame


def crawl(pages: DataFrame, seeds: DataFrame | None = None, as_of_year: int = 2026, analysis_date: str = "",
          max_urls: int | None = None, max_depth: int | None = None, stages: Kept | None = None) -> Crawl:
    """Accept pages, read signals and links once, walk the link graph, summarise every site.

    Signals and links are stored first; the graph, its counts and the summary
    read those.  Nothing is cut unless ``max_urls`` or ``max_depth`` is given:
    they bound the walk, and so the totals and depth it finds.  ``stages`` says
    where the stages are stored.
    """
    keep = (stages or Kept()).keep
    good = P.accepted(pages)
    signals = keep("signals", lambda: page_signals(good))
    links = keep("links", lambda: L.placed_links(D.parse(good)))

    def walk() -> DataFrame:
        starts = L.main_pages(signals, seeds).select("site_id", F.col("main_url").alias("url"))
        return G.reach(starts, G.site_edges(links), max_urls, max_depth)

    reached = keep("reached", walk)
    stats = keep("crawl_stats", lambda: G.crawl_stats(reached, links))
    found = keep("map_links", lambda: M.all_maps(signals))
    videos = keep("videos", lambda: MK.videos(signals))
    sites = keep("records", lambda: summary.site_summary(
        good, seeds, stats, as_of_year, analysis_date, signals, links, found, videos, lists=False, stages=stages))
    return Crawl(good, signals, links, reached, sites, found, videos)


def resumable(pages: DataFrame, folder: str, seeds: DataFrame | None = None, as_of_year: int = 2026, analysis_date: str = "",
              max_urls: int | None = None, max_depth: int | None = None, keep_jobs: int = 3) -> Crawl:
    """A crawl whose stages lie below ``folder``: called again after a stop, it goes on with the first stage that is missing."""
    said = {"as_of_year": as_of_year, "analysis_date": analysis_date, "max_urls": max_urls, "max_depth": max_depth}
    if seeds is not None:
        said["seeds"] = str(sorted(seeds.inputFiles()) or seeds.semanticHash())
    stages = Stages.of(pages.sparkSession, folder, pages, **said)
    done = crawl(pages, seeds, as_of_year, analysis_date, max_urls, max_depth, stages)
    stages.prune(keep_jobs)
    return done


def analyse(pages: DataFrame, seeds: DataFrame | None = None, as_of_year: int = 2026, analysis_date: str = "",
            max_urls: int | None = None, max_depth: int | None = None) -> DataFrame:
    """The site records of :func:`crawl`, with their lists as arrays."""
    done = crawl(pages, seeds, as_of_year, analysis_date, max_urls, max_depth)
    return summary.with_lists(done.sites, done.found, done.videos)


def write_all(done: Crawl, out: str) -> None:
    """SNK1-SNK5, SNK7, SNK8 and SS6 of a crawl.

    Named documents of each site: ``reports``, ``sitemaps`` and ``master`` hold a folder per site, ``summary_csv`` the summary rows; no row
    holds a whole list.  Page records, HTML and unique pages are tables.
    """
    lists = materialise(documents.site_lists(done.found, done.videos), "site_lists")
    links = materialise(L.with_depth(done.links, done.reached), "links_with_depth")
    write_pieces(documents.report_text(done.sites, lists), documents.ORDER, f"{out}/reports")
    write_pieces(documents.sitemap_json(done.sites, links, lists).unionByName(documents.sitemap_text(done.sites, links, lists)), documents.ORDER, f"{out}/sitemaps")
    write_pieces(documents.master_json(done.sites, lists), documents.ORDER, f"{out}/master")
    write_pieces(documents.summary_csv(done.sites, lists), documents.ORDER, out)
    records = materialise(sinks.page_records(done.signals, done.found, done.reached), "page_records")
    sinks.write_documents(sinks.page_json(records), f"{out}/page_json")
    sinks.write_documents(sinks.html_files(done.pages), f"{out}/html")
    content = done.signals.select("page_id", F.col("text").alias("content"))
    bodies = records.select("page_id", "url", "title", F.col("meta_tags").alias("meta")).join(content, "page_id")
    sinks.write_documents(sinks.unique_page_json(bodies), f"{out}/unique_pages")


def compile_csv(report_rows: DataFrame, out: str) -> None:
    """SRC4 rows to SNK6."""
    sinks.write_csv(compiler.compile_reports(report_rows), out)
