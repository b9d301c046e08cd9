"""Map-link detection (MP*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.rows import computed, unnest, unnest_structs
from siteweave.operators.signals import anchor_rows, ld_rows
from siteweave.session import materialise


def _rows(rows: DataFrame, method: str, url: Column) -> DataFrame:
    return rows.select("page_id", "site_id", "source_page", F.lit(method).alias("method"), url.alias("map_url"))


def direct(signals: DataFrame) -> DataFrame:
    """MP1: anchors that lead to a map host."""
    out = _rows(anchor_rows(signals), "direct", U.resolve(F.col("source_page"), F.col("href")))
    return out.where(T.contains_any(F.lower("map_url"), K.MAP_HOSTS))


def iframes(signals: DataFrame) -> DataFrame:
    """MP2: iframes that embed a map."""
    rows = unnest(signals, ["page_id", "site_id", F.col("url").alias("source_page")], "iframes", "attrs")
    rows = rows.withColumn("src", H.attr(F.col("attrs"), "src")).where("src is not null")
    out = _rows(rows, "iframe", U.resolve(F.col("source_page"), F.col("src")))
    return out.where(T.contains_any(F.lower("map_url"), K.MAP_IFRAME_HOSTS))


def scripts(signals: DataFrame) -> DataFrame:
    """MP3: map URLs in script text, distinct per page."""
    rows = unnest(signals, ["page_id", "site_id", F.col("url").alias("source_page")], "script_maps", "u")
    return _rows(rows, "javascript", F.col("u"))


def _text_at(doc: str, path: str) -> Column:
    return F.try_variant_get(F.col(doc), path, "string")


def structured_url(doc: str = "doc") -> Column:
    """MP4: map URL of one JSON-LD document."""
    geo = [_text_at(doc, f"$.location.geo.{k}") for k in ("latitude", "longitude")]
    parts = F.concat_ws(", ", *[_text_at(doc, f"$.address.{k}") for k in K.ADDRESS_KEYS])
    return F.coalesce(
        _text_at(doc, "$.hasMap"),
        F.when(geo[0].isNotNull() & geo[1].isNotNull(),
               F.concat(F.lit("https://www.google.com/maps?q="), geo[0], F.lit(","), geo[1])),
        F.when(parts != "", F.concat(F.lit("https://www.google.com/maps/search/"), F.replace(parts, F.lit(" "), F.lit("+")))),
    )


def structured(signals: DataFrame) -> DataFrame:
    """MP4: one row per JSON-LD document that tells a place."""
    rows = ld_rows(signals).select("page_id", "site_id", F.col("url").alias("source_page"), structured_url().alias("u"))
    return _rows(rows.where("u <> ''"), "structured", F.col("u"))


def all_maps(signals: DataFrame) -> DataFrame:
    """MP1-MP4 as one table: (page_id, site_id, source_page, method, map_url).

    The pieces of a page are tagged by method and unnested together, so the
    pages are read once.
    """
    def tagged(method: str, pieces: str) -> Column:
        none = F.array().cast("array<string>")
        return F.transform(F.coalesce(F.col(pieces), none), lambda p: F.struct(F.lit(method).alias("method"), p.alias("piece")))

    pieces = F.concat(tagged("direct", "anchors"), tagged("iframe", "iframes"), tagged("javascript", "script_maps"), tagged("structured", "ld"))
    rows = unnest_structs(signals, ["page_id", "site_id", F.col("url").alias("source_page")], pieces)
    method, piece = F.col("method"), F.col("piece")
    target = F.when(method == "direct", H.attr(H.piece_attrs(piece), "href")).when(method == "iframe", H.attr(piece, "src"))
    docs = rows.select("page_id", "site_id", "source_page", "method", "piece", target.alias("target"),
                       F.when(method == "structured", F.try_parse_json(T.strip(piece))).alias("doc"))
    # resolving drops line breaks and joins whole segments, so a map's host stands in the reference or in the page's URL: others are not resolved
    likely = T.contains_any(F.lower(F.translate("target", "\t\r\n", "")), K.MAP_TOKENS) | T.contains_any(F.lower("source_page"), K.MAP_TOKENS)
    url = F.when(method.isin("direct", "iframe"), F.when(likely, U.resolve(F.col("source_page"), F.col("target")))).when(method == "javascript", piece).otherwise(structured_url())
    found = computed(docs, ["page_id", "site_id", "source_page", "method"], map_url=url).where("map_url <> ''")
    lowered = F.lower("map_url")
    return found.where(F.when(method == "direct", T.contains_any(lowered, K.MAP_HOSTS)).when(method == "iframe", T.contains_any(lowered, K.MAP_IFRAME_HOSTS)).otherwise(True))


def priority(url: Column) -> Column:
    """MP7: index of the first priority pattern in the URL; last when none."""
    lowered = F.lower(url)
    rank = F.lit(len(K.MAP_PRIORITY))
    for i, pattern in reversed(list(enumerate(K.MAP_PRIORITY))):
        rank = F.when(lowered.contains(pattern), F.lit(i)).otherwise(rank)
    return rank


def site_maps(sites: DataFrame, found: DataFrame) -> DataFrame:
    """MP5, MP7: per site the counts by method, distinct total, status and primary link.

    Two aggregates: first by (site, url), which spreads a large site, then by
    site over one row per distinct URL.
    """
    def n(method: str) -> Column:
        return F.count_if(F.col("method") == method)

    per_url = found.groupBy("site_id", "map_url").agg(
        n("direct").alias("d"), n("iframe").alias("i"), n("javascript").alias("j"), n("structured").alias("s"))
    per_site = per_url.groupBy("site_id").agg(
        F.sum("d").alias("direct_links"), F.sum("i").alias("iframe_embeds"),
        F.sum("j").alias("javascript_maps"), F.sum("s").alias("structured_data_maps"),
        F.count("*").alias("total_maps_found"),
        F.min(F.struct(priority(F.col("map_url")).alias("p"), "map_url"))["map_url"].alias("primary_maps_link"))
    zero = F.lit(0).cast("bigint")
    out = sites.select("site_id").join(per_site, "site_id", "left")
    numbers = ["direct_links", "iframe_embeds", "javascript_maps", "structured_data_maps", "total_maps_found"]
    return out.select(
        "site_id", *[F.coalesce(c, zero).alias(c) for c in numbers], "primary_maps_link",
        F.when(F.col("total_maps_found") > 0, "Integrated").otherwise("Not Found").alias("status"))


def page_maps(found: DataFrame) -> DataFrame:
    """MP6: map links of each page, with the page where the site first showed them (Q5).

    The running list of a page is the set of the site's links whose first page
    is not later; ``first_page`` states that without materialising the lists.
    """
    # read twice below, so stored: otherwise the pages behind it are read and matched twice
    per_page = materialise(found.groupBy("site_id", "map_url", "page_id").agg(F.count("*").alias("hits")), "page_maps")
    first = per_page.groupBy("site_id", "map_url").agg(F.min("page_id").alias("first_page"))
    return per_page.join(first, ["site_id", "map_url"]).select("site_id", "page_id", "map_url", "hits", "first_page")


def contact_page_maps(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """MP6: map links of contact pages, distinct per page, counted per site."""
    contact = kinds.where("is_contact_page").select("page_id")
    links = found.select("site_id", "page_id", "map_url").distinct()
    return links.join(contact, "page_id", "left_semi").groupBy("site_id").agg(F.count("*").alias("contact_page_maps"))
