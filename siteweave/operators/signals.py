"""Everything later operators read from a page, extracted in one JVM-only scan.

``page_signals`` is a plain projection.  Used directly, Catalyst prunes it to
the columns an operator needs; a job that runs many operators persists or
writes it once and never touches the HTML again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.rows import computed, unnest


def _script_maps(html: Column) -> Column:
    """MP3: map URLs in script text, distinct per page."""
    def urls(body: Column) -> Column:
        return F.concat(*[F.regexp_extract_all(body, F.lit("(?i)" + p), 0) for p in K.MAP_SCRIPT_PATTERNS])

    found = F.array_distinct(F.flatten(F.transform(H.script_bodies(html), urls)))
    return F.when(T.contains_any("lower(html)", K.MAP_HOSTS), found)


def page_signals(pages: DataFrame) -> DataFrame:
    """One row per page: site, title, visible text and the raw pieces of links, metas, icons, embeds and JSON-LD.

    ``anchors`` holds each anchor's attributes and inner markup; ``metas``,
    ``icons``, ``embeds``, ``iframes`` and ``images`` hold attribute strings; ``ld``
    holds JSON-LD source text.
    """
    html, markup = F.col("html"), F.col("markup")
    extra = [c for c in ("status_code", "load_time") if c in pages.columns]
    marked = html.contains("application/ld+json")
    staged = pages.select("page_id", "url", *extra, U.site_of(F.col("url")).alias("site_id"), "html", H.visible_html(html).alias("markup"))
    return staged.select(
        "page_id", "url", *extra, "site_id",
        H.title(markup).alias("title"),
        H.text_of(markup).alias("text"),
        H.anchor_pieces(markup).alias("anchors"),
        H.open_tags(markup, "meta").alias("metas"),
        H.open_tags(markup, "link").alias("icons"),
        H.open_tags(markup, "iframe").alias("iframes"),
        H.open_tags(markup, "(?:video|iframe)").alias("embeds"),
        H.open_tags(markup, "img").alias("images"),
        _script_maps(html).alias("script_maps"),
        F.when(marked, F.filter(F.regexp_extract_all(html, F.lit(H.JSON_LD_BODY), 1), lambda s: s != "")).alias("ld"),
        T.contains_any("lower(html)", K.VIDEO_MARKERS).alias("video_marker"),
        F.lower(html).contains("viewport").alias("viewport"),
        T.contains_any("html", [K.MICRODATA_PRODUCT] + K.CARD_CLASSES).alias("product_marker"),
        F.lower(html).rlike(K.ABOUT_MARKER).alias("about_marker"),
    )


def anchor_rows(signals: DataFrame) -> DataFrame:
    """One row per anchor that has an href, in document order."""
    rows = unnest(signals, ["page_id", "site_id", "url"], "anchors", "piece", "link_seq")
    hrefs = computed(rows, ["page_id", "site_id", F.col("url").alias("source_page"), "link_seq", "piece"],
                     href=H.attr(H.piece_attrs(F.col("piece")), "href"))
    return hrefs.select("page_id", "site_id", "source_page", "link_seq", "href", "piece").where("href is not null")


def ld_rows(signals: DataFrame) -> DataFrame:
    """PG8: one row per valid JSON-LD document, as VARIANT; top-level arrays stay one document."""
    rows = unnest(signals, ["page_id", "site_id", "url"], "ld", "body", "ld_seq")
    doc = F.try_parse_json(T.strip(F.col("body")))
    return computed(rows, ["page_id", "site_id", "url", "ld_seq"], doc=doc).where("doc is not null")
