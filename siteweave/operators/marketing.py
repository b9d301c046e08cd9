"""Marketing intelligence (MK*) and website features (FT*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions.keywords import Keywords
from siteweave.functions.rows import unnest
from siteweave.operators.business import social_count


def instagram_handle(profile: Column) -> Column:
    """MK1."""
    return F.concat(F.lit("@"), T.first_group(profile, r"instagram\.com/([^/?]+)"))


def creator_sites(texts: DataFrame) -> DataFrame:
    """MK2 per site."""
    known = Keywords(K.CREATOR_KEYWORDS)
    named = F.size(known.found(F.lower("text"))) > 0
    return texts.groupBy("site_id").agg(F.bool_or(named).alias("worked_with_creators"))


def video_sources(signals: DataFrame) -> DataFrame:
    """MK3: embeds and anchors that lead to a video, every occurrence in page order."""
    embeds = F.filter(
        F.transform(F.col("embeds"), lambda a: F.coalesce(T.blank_to_null(H.attr(a, "src")), T.blank_to_null(H.attr(a, "data-src")))),
        lambda s: T.contains_any(s, K.VIDEO_EMBED_PLATFORMS))
    linked = F.filter(F.col("anchors"), lambda p: T.contains_any(p, ["youtube", "vimeo", "tiktok"]))
    anchors = F.filter(F.transform(linked, lambda p: H.attr(H.piece_attrs(p), "href")),
                       lambda h: T.contains_any(h, K.VIDEO_ANCHOR_PARTS))
    return unnest(signals, ["site_id", "page_id"], F.concat(embeds, anchors), "video_url", "video_seq")


def videos(signals: DataFrame) -> DataFrame:
    """MK3: distinct video links per site, with the first page that shows them."""
    return video_sources(signals).groupBy("site_id", "video_url").agg(F.min("page_id").alias("first_page"))


def first_videos(signals: DataFrame, k: int = 10) -> DataFrame:
    """MK3, older variant: the first ten occurrences, repeats kept."""
    from siteweave.operators.topk import top_k

    return top_k(video_sources(signals), ["site_id"], [F.col("page_id"), F.col("video_seq")], k).select(
        "site_id", F.col("rn").cast("bigint").alias("rank"), "video_url")


def ig_score() -> Column:
    """MK4 over instagram_handle, worked_with_creators, video_count, platforms and complexity."""
    return (F.when(F.col("instagram_handle").isNotNull(), 25).otherwise(0)
            + F.when(F.col("worked_with_creators"), 20).otherwise(0)
            + F.least(F.lit(20), F.coalesce(F.col("video_count"), F.lit(0)) * 2)
            + F.least(F.lit(20), social_count() * 3)
            + F.when(F.col("complexity").isin("Complex", "Moderate"), 15).otherwise(0)).cast("int")


def engagement_map() -> Column:
    """MK5: 50 per present platform, 75 when the site has more than three social links."""
    points = F.when(F.col("social_links") > 3, 75).otherwise(50)
    entries = F.filter(F.array(*[F.when(F.col(p) != "", F.struct(F.lit(p), points)) for p in K.SOCIAL_NAMES]), lambda e: e.isNotNull())
    return F.map_from_entries(entries)


def text_features(known: Keywords, found: Column | str) -> list[Column]:
    """FT1 for one page; the keyword rule for social presence is kept apart (FT2)."""
    return [known.any_of(found, words).alias(name) for name, words in K.FEATURE_KEYWORDS.items()] + [
        known.any_of(found, K.SOCIAL_TEXT_KEYWORDS).alias("social_in_text")]


def features(signals: DataFrame) -> DataFrame:
    """FT1, FT3 per site."""
    known = Keywords(*K.FEATURE_KEYWORDS.values(), K.SOCIAL_TEXT_KEYWORDS)
    rows = signals.select("site_id", known.found(F.lower("text")).alias("found"), "video_marker")
    rows = rows.select("site_id", *text_features(known, "found"), F.col("video_marker").alias("video_presence"))
    names = [c for c in rows.columns if c != "site_id"]
    return rows.groupBy("site_id").agg(*[F.bool_or(c).alias(c) for c in names])


def social_presence(links: DataFrame) -> DataFrame:
    """FT2: any social link."""
    return links.groupBy("site_id").agg(F.bool_or(F.col("link_type") == "social").alias("social_media_presence"))


def main_page_features(mains: DataFrame) -> DataFrame:
    """FT4 over (site_id, main_url, viewport) of main pages."""
    return mains.select("site_id", F.col("main_url").startswith("https://").alias("ssl_secure"), F.col("viewport").alias("mobile_responsive"))
