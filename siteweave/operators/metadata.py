"""Site metadata (MD*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.rows import unnest
from siteweave.operators import dom as D
from siteweave.operators import pages as P
from siteweave.operators.facts import first_values
from siteweave.session import materialise


def page_titles(signals: DataFrame) -> DataFrame:
    """MD1: titles of all pages, one row each; the order is that of page_id."""
    return signals.select("site_id", "page_id", "title").where("title is not null")


def about_pages(signals: DataFrame, links: DataFrame) -> DataFrame:
    """MD2: the longest about page of each site (ties to the lowest page_id).

    About pages are named by an about link of the site or recognised by
    themselves.  Link targets are made distinct before the join, so a page
    every other page links to is one row on the link side.  Candidates are
    reduced to (site, length, page) before the shuffle.
    """
    return longest_about(about_candidates(signals), links.where("is_about").select("site_id", "url").distinct())


def about_candidates(signals: DataFrame) -> DataFrame:
    """MD2: every page with its length and whether it is an about page by itself."""
    return signals.select("site_id", "url", "page_id", F.length("text").alias("n"), P.is_about_page().alias("own"))


def longest_about(rows: DataFrame, links: DataFrame) -> DataFrame:
    """MD2 over :func:`about_candidates` and the distinct targets of about links."""
    named = links.select("site_id", "url").withColumn("named", F.lit(True))
    about = rows.join(named, ["site_id", "url"], "left").where(F.col("own") | F.col("named"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), "page_id", "url"))
    return about.groupBy("site_id").agg(best.alias("b")).select("site_id", "b.page_id", "b.url")


def keyword_list(metas: Column) -> Column:
    """MD7 for one page: keywords over two characters."""
    words = F.transform(F.split(H.meta_content(metas, "keywords", ignore_case=True), ","), T.strip)
    return F.filter(words, lambda w: F.length(w) > 2)


def keyword_rows(signals: DataFrame) -> DataFrame:
    """MD7: every keyword of every page."""
    return unnest(signals, ["site_id", "page_id"], keyword_list(F.col("metas")), "keyword")


def keywords(signals: DataFrame, k: int = 20) -> DataFrame:
    """MD7: the first 20 distinct meta keywords per site, sorted (Q2)."""
    return first_values(keyword_rows(signals), "keyword", ["site_id"], k).withColumnRenamed("joined", "keywords")


def about_fallback(sections: DataFrame, limit: int = 3000) -> DataFrame:
    """MD5: distinct sections over 50 characters in page order, joined by a blank line, 3000 characters.

    Every kept section has over 50 characters, so the first ``limit / 50``
    sections already fill the result; the rest cannot show up in it.
    """
    from siteweave.operators.topk import top_k

    long = sections.where(F.length("section_text") > 50)
    order = F.struct("page_id", "selector", "elem_seq")
    first = long.groupBy("site_id", F.md5(F.lower("section_text")).alias("digest")).agg(
        F.min(F.struct(order.alias("pos"), "section_text")).alias("s"))
    kept = top_k(first.select("site_id", "s.pos", "s.section_text"), ["site_id"], [F.col("pos")], limit // 50 + 1)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("rn", "section_text"))), lambda s: s["section_text"])
    return kept.groupBy("site_id").agg(F.substring(F.array_join(joined, "\n\n"), 1, limit).alias("about_text"))


def about(pages: DataFrame, signals: DataFrame, links: DataFrame) -> DataFrame:
    """MD2-MD5: about text and URL per site.

    Only the chosen page of each site is parsed for its main text, and only
    pages with an about-like attribute of sites left without one are parsed
    for sections.
    """
    best = materialise(about_pages(signals, links), "about_pages")
    body = pages.select("page_id", "url", "html")
    main = D.about_texts(D.parse(body.join(best.select("page_id"), "page_id", "left_semi")))
    named = best.join(main.select("page_id", "about_text"), "page_id").where("about_text is not null")
    # read twice below, so stored
    named = materialise(named.select("site_id", "about_text", F.col("url").alias("about_url")), "about_texts")
    wanted = signals.where("about_marker").select("site_id", "page_id").join(named.select("site_id"), "site_id", "left_anti")
    left = body.join(wanted.select("page_id"), "page_id", "left_semi")
    sections = D.about_sections(D.parse(left)).withColumn("site_id", U.site_of(F.col("url")))
    rest = about_fallback(sections).withColumn("about_url", F.lit(None).cast("string"))
    return named.unionByName(rest)
