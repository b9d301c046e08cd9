"""One wide row per site (SS1-SS5): every extractor over one persisted scan.

The HTML is read once into page signals.  Text facts of all kinds are computed
in one projection and one aggregate; the other extractors each end in one row
per site.  Those rows are put side by side by a union and one aggregate instead
of a chain of joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.keywords import Keywords
from siteweave.operators import business as B
from siteweave.operators import contact as C
from siteweave.operators import dom as D
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators import marketing as MK
from siteweave.operators import metadata as MD
from siteweave.operators import pages as P
from siteweave.operators import products as PR
from siteweave.operators.signals import page_signals
from siteweave.operators.topk import top_k
from siteweave.session import Kept, materialise


def capped_pages(pages: DataFrame, limit: int, seeds: DataFrame | None = None) -> DataFrame:
    """LK20 on stored pages: at most ``limit`` per site, main page first, then by URL.

    Ranks and cuts see ids and URLs only; page bodies are filtered by the ids
    that are left, so no site's bodies meet in one task.
    """
    mains = L.main_pages(pages, seeds).select("page_id", F.lit(True).alias("is_main"))
    rows = pages.select("page_id", "url", U.site_of(F.col("url")).alias("site_id"))
    marked = rows.join(mains, "page_id", "left").withColumn("later", F.when(F.col("is_main"), 0).otherwise(1))
    cut = top_k(marked, ["site_id"], [F.col("later"), F.col("url"), F.col("page_id")], limit).where(F.col("rn") == limit)
    cut = cut.select("site_id", F.col("url").alias("cut_url"), F.col("page_id").alias("cut_page"))
    first = marked.where("is_main").join(cut, "site_id").select("site_id", "cut_url", "cut_page", F.col("page_id").alias("main_page"))
    kept = rows.join(first, "site_id", "left").where(
        F.col("cut_url").isNull() | (F.col("page_id") == F.col("main_page")) | (F.col("url") < F.col("cut_url"))
        | ((F.col("url") == F.col("cut_url")) & (F.col("page_id") <= F.col("cut_page"))))
    return pages.join(materialise(kept.select("page_id"), "page_budget"), "page_id", "left_semi").select(*pages.columns)


def text_state(signals: DataFrame) -> DataFrame:
    """What the text facts of a site come from, in a form that merges: sums, first and best hits as structs, bit masks, flags."""
    text = F.col("text")
    known = Keywords(*K.INDUSTRY_KEYWORDS.values(), *K.BUDGET_KEYWORDS.values(), K.CREATOR_KEYWORDS, *K.FEATURE_KEYWORDS.values(), K.SOCIAL_TEXT_KEYWORDS)
    staged = signals.select("site_id", "page_id", "text", known.found(F.lower(text)).alias("found"), "anchors", "load_time", "video_marker")
    rows = staged.select(
        "site_id", "page_id", "load_time", T.word_count(text).alias("words"),
        C.mailto(F.col("anchors")).alias("m"), F.array_min(C.emails_in(text)).alias("t"), C.address_hit(text).alias("adr"),
        B.employees_hit(text).alias("emp"), B.revenue_hit(text).alias("rev"), *B.year_hits(text),
        *B.keyword_masks(known, "found", K.INDUSTRY_KEYWORDS, "k"),
        known.any_of("found", K.BUDGET_KEYWORDS["High-End"]).alias("hi"), known.any_of("found", K.BUDGET_KEYWORDS["Mid-Budget"]).alias("mid"),
        known.any_of("found", K.CREATOR_KEYWORDS).alias("creators"), *MK.text_features(known, "found"), "video_marker")

    def first(value: str) -> Column:
        return F.min(F.when(F.col(value).isNotNull(), F.struct("page_id", F.col(value).alias("v"))))

    def best(hit: str) -> Column:
        return F.min(F.when(F.col(hit).isNotNull(), F.struct(F.col(f"{hit}.pattern"), F.col("page_id"), F.col(f"{hit}.v").alias("v"))))

    return rows.groupBy("site_id").agg(
        F.count("*").alias("n_pages"), F.sum("words").alias("n_words"), F.sum("load_time").alias("load"), F.count("load_time").alias("n_load"),
        first("m").alias("min_m"), F.min("t").alias("min_t"), *[best(h).alias(f"min_{h}") for h in ("adr", "emp", "rev")],
        *[first(f"year{i}").alias(f"min_year{i}") for i in range(len(K.FOUNDED_PATTERNS))],
        *[F.bit_or(f"k{i}").alias(f"bits_k{i}") for i in range(len(K.INDUSTRY_KEYWORDS))],
        *[F.bool_or(c).alias(f"any_{c}") for c in ("hi", "mid", "creators", *K.FEATURE_KEYWORDS, "video_marker")])


#: how columns of a state merge, by how their names begin
MERGE = {"n_": F.sum, "load": F.sum, "min_": F.min, "bits_": F.bit_or, "any_": F.bool_or}


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """One state per key from several."""
    def merge(name: str) -> Column:
        return next(how for start, how in MERGE.items() if name.startswith(start))(name).alias(name)

    return states.groupBy(*keys).agg(*[merge(c) for c in states.columns if c not in keys])


def text_finish(states: DataFrame, as_of_year: int) -> DataFrame:
    """The text facts of merged states."""
    def year(i: int) -> Column:
        v = F.col(f"min_year{i}.v")
        return F.when(v.try_cast("int").between(1800, as_of_year), v)

    counted = states.select("*", *[F.bit_count(f"bits_k{i}").cast("int").alias(f"k{i}") for i in range(len(K.INDUSTRY_KEYWORDS))])
    return counted.select(
        "site_id", F.col("n_pages").alias("pages_analysed"), F.col("n_words").alias("total_words"), (F.col("load") / F.col("n_load")).alias("avg_load_time"),
        F.coalesce("min_m.v", "min_t").alias("email"), F.col("min_adr.v").alias("address"), F.col("min_emp.v").alias("employees"),
        F.col("min_rev.v").alias("annual_revenue"), F.coalesce(*[year(i) for i in range(len(K.FOUNDED_PATTERNS))]).alias("founded_year"),
        B.budget_label(F.col("any_hi"), F.col("any_mid")).alias("segmentation"), F.col("any_creators").alias("worked_with_creators"),
        *[F.col(f"any_{f}").alias(f) for f in K.FEATURE_KEYWORDS], F.col("any_video_marker").alias("video_presence"),
        F.coalesce(B.best_group(K.INDUSTRY_KEYWORDS, "k"), F.lit("Unknown")).alias("industry"))


def text_facts(signals: DataFrame, as_of_year: int) -> DataFrame:
    """SS2, CT4-CT8, BZ1-BZ4, BZ14, MK2, FT1, FT3 in one projection and one aggregate."""
    return text_finish(text_state(signals), as_of_year)


def totals(signals: DataFrame) -> DataFrame:
    """SS2 alone."""
    rows = signals.select("site_id", "load_time", T.word_count(F.col("text")).alias("words"))
    return rows.groupBy("site_id").agg(
        F.sum("words").alias("total_words"), F.avg("load_time").alias("avg_load_time"), F.count("*").alias("pages_analysed"))


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """Outer join of frames that hold one row per site each: union, then one aggregate."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = [c for c in together.columns if c != "site_id"]
    return together.groupBy("site_id").agg(*[F.max(c).alias(c) for c in names])


def phone_columns(signals: DataFrame) -> DataFrame:
    kinds = C.phones(signals)
    return kinds.groupBy("site_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("phones"))).alias(f"{k}_phone") for k in C.PHONE_KINDS])


def map_columns(found: DataFrame, signals: DataFrame) -> DataFrame:
    """MP5-MP7 per site, without the list of the links."""
    stats = M.site_maps(found.select("site_id").distinct(), found).withColumnRenamed("status", "maps_status")
    return stats.join(M.contact_page_maps(found, P.page_kinds(signals)), "site_id", "left")


def video_columns(videos: DataFrame) -> DataFrame:
    """MK3 per site, without the list of the links."""
    return videos.groupBy("site_id").agg(F.count("*").alias("video_count"))


def with_lists(sites: DataFrame, found: DataFrame, videos: DataFrame) -> DataFrame:
    """The record with its two lists as arrays, sorted: for sites whose lists fit a row.

    :mod:`siteweave.plans.documents` writes records and reports of any size without them.
    """
    maps = found.groupBy("site_id").agg(F.sort_array(F.collect_set("map_url")).alias("all_maps"))
    seen = videos.groupBy("site_id").agg(F.sort_array(F.collect_set("video_url")).alias("videos"))
    none = F.array().cast("array<string>")
    joined = sites.join(side_by_side([maps, seen]), "site_id", "left")
    return joined.select(*sites.columns, *[F.coalesce(c, none).alias(c) for c in ("all_maps", "videos")])


def main_columns(pages: DataFrame, signals: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """PG4-PG6, PG15, PG16, FT4 and the status of the main page."""
    mains = materialise(L.main_pages(signals, seeds), "main_pages")
    heads = signals.join(mains.select("page_id", "main_url"), "page_id").select(
        "site_id", "page_id", "main_url", F.col("status_code").alias("main_status"), *P.head_columns(),
        F.col("viewport").alias("mobile_responsive"), F.col("main_url").startswith("https://").alias("ssl_secure"))
    logo = D.logos(D.parse(pages.select("page_id", "url", "html").join(mains.select("page_id"), "page_id", "left_semi")))
    return heads.join(logo, "page_id", "left").drop("page_id", "description")


def site_summary(pages: DataFrame, seeds: DataFrame | None = None, stats: DataFrame | None = None, as_of_year: int = 2026,
                 analysis_date: str = "", signals: DataFrame | None = None, links: DataFrame | None = None, found: DataFrame | None = None,
                 videos: DataFrame | None = None, lists: bool = True, stages: Kept | None = None) -> DataFrame:
    """SS1: the full record of every site, from all its pages.

    ``pages(page_id, url, html, status_code, load_time)``; ``stats`` is the
    crawl result of :func:`siteweave.operators.graph.crawl_stats`; without it
    page and link totals come from the stored links and the depth is 0.
    A job that has stored ``signals``, ``links``, map links ``found`` and
    ``videos`` passes them on.  The HTML is read by the signals, and again only
    for the pages that are parsed as trees.  Without ``lists`` the record leaves
    out the two lists that grow with a site; their counts are there.
    """
    keep = (stages or Kept()).keep
    signals = signals if signals is not None else keep("signals", lambda: page_signals(pages))
    links = links if links is not None else keep("links", lambda: L.page_links(signals))
    found = found if found is not None else keep("map_links", lambda: M.all_maps(signals))
    videos = videos if videos is not None else keep("videos", lambda: MK.videos(signals))

    def link_columns() -> DataFrame:
        structure = stats if stats is not None else L.site_structure(signals, links).withColumn("max_depth", F.lit(0).cast("bigint"))
        return side_by_side([structure, L.counts(links).drop("total_links")])

    offers = keep("offers", lambda: PR.all_products(signals, pages))
    parts = {
        "text": lambda: text_facts(signals, as_of_year),
        "main": lambda: main_columns(pages, signals, seeds),
        "link_columns": link_columns,
        "maps": lambda: map_columns(found, signals),
        "lists": lambda: side_by_side([C.social_columns(C.social_profiles(signals)), C.ld_brand(signals), phone_columns(signals),
                                       MD.keywords(signals), video_columns(videos)]),
        "products": lambda: PR.product_columns(PR.price_extremes(PR.cheapest_offers(offers))),
        "about": lambda: MD.about(pages, signals, links),
    }
    # one job per extractor: small plans, and a failed job repeats only its own part
    stored = [keep(name, build) for name, build in parts.items()]
    sites = keep("sites", lambda: side_by_side(stored).where("pages_analysed is not null"))
    done = finish(sites, analysis_date)
    return with_lists(done, found, videos) if lists else done


def finish(sites: DataFrame, analysis_date: str = "") -> DataFrame:
    """Fill gaps and add everything that follows from one row per site."""
    zero = ["internal_links", "external_links", "social_links", "maps_links", "contact_links", "direct_links", "iframe_embeds",
            "javascript_maps", "structured_data_maps", "contact_page_maps", "total_maps_found", "video_count"]
    filled = sites.select(
        *[c for c in sites.columns if c not in [*zero, "maps_status"]],
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in zero],
        F.coalesce("maps_status", F.lit("Not Found")).alias("maps_status"),
    ).select(
        "*", F.lit(analysis_date).alias("analysis_date"), F.col("site_id").alias("domain"),
        F.coalesce("ld_brand", C.brand_from_title(F.col("title")), C.brand_from_host(F.col("main_url"))).alias("brand_name"),
        C.city(F.col("address")).alias("city"), C.state(F.col("address")).alias("state"),
        (F.col("social_links") > 0).alias("social_media_presence"), MK.instagram_handle(F.col("instagram")).alias("instagram_handle"))
    return B.scores(filled).select("*", MK.ig_score().alias("ig_score"), MK.engagement_map().alias("social_media_engagement"))


def narrative(sites: DataFrame) -> DataFrame:
    """SS3."""
    eng, firm = F.col("engagement_score"), F.col("firmographic_score")
    return sites.select(
        "site_id", F.when(eng > 70, "high").when(eng > 40, "moderate").otherwise("low").alias("engagement_tier"),
        F.when(firm > 70, "Strong").when(firm > 40, "Moderate").otherwise("Limited").alias("completeness_tier"),
        F.when(eng > 70, "a sophisticated").otherwise("a developing").alias("operation"))


def site_outcomes(seeds: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """SS5 per seed: ``(site_id, main_url, outcome, reason, pages, refused)``.

    A seed without a summary failed: no page of its site is stored, or all were refused, for the reason that holds for most of them (the
    first by name among equals): the error its HTML shows, a short body, or the status.
    """
    verdict = P.fetch_verdict(F.col("status_code"), F.col("html"))
    shown = P.error_class(F.col("html"))
    reason = (F.when(F.col("html").isNull(), "no body").when(shown != "UNKNOWN", shown)
              .when(F.col("status_code").isNull(), "no status").when(F.col("status_code") != 200, F.concat(F.lit("status "), F.col("status_code").cast("string")))
              .otherwise(f"body of {K.MIN_HTML_LENGTH} characters or less"))
    kept = F.coalesce(verdict == "accept", F.lit(False))
    rows = pages.select(U.site_of(F.col("url")).alias("site_id"), kept.alias("kept"), F.when(~kept, reason).alias("reason"))
    # one row per site and reason: a site of many pages is counted where they lie
    by_reason = rows.groupBy("site_id", "reason").agg(F.count("*").alias("n"))
    per_site = by_reason.groupBy("site_id").agg(
        F.sum("n").alias("pages"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("refused"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct((-F.col("n")).alias("n"), "reason")))["reason"].alias("reason"))
    done = sites.select("site_id", F.lit(True).alias("done"))
    joined = seeds.select("site_id", "main_url").join(per_site, "site_id", "left").join(done, "site_id", "left")
    failed = F.col("done").isNull()
    return joined.select(
        "site_id", "main_url", F.when(failed, "failed").otherwise("completed").alias("outcome"),
        F.when(failed, F.coalesce("reason", F.lit("no page stored"))).alias("reason"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("pages", "refused")])


def batch_outcome(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """SS5: seeds with and without a summary."""
    done = sites.select(F.col("site_id"), F.lit(True).alias("done"))
    rows = seeds.select("site_id").join(done, "site_id", "left")
    return rows.agg(F.count_if(F.col("done")).alias("completed"), F.count_if(F.col("done").isNull()).alias("failed"))


PRODUCT_COLUMNS = {f"{side.title()} Price Product {i} {label}": (f"{side}_products", i, field) for side in ("min", "max") for i in (1, 2, 3, 4)
                   for label, field in (("Name", "name"), ("Price", "price"), ("URL", "url"))}


# fixed values: column names of the summary file and the fields they show
CSV_COLUMNS = {
    "Domain": "domain", "Main URL": "main_url", "Analysis Date": "analysis_date", "Company Name": "brand_name",
    "Industry": "industry", "Segmentation": "segmentation", "Website Status": "main_status", "Founded Year": "founded_year",
    "Employees": "employees", "Annual Revenue": "annual_revenue", "Firmographic Score": "firmographic_score",
    "Engagement Score": "engagement_score", "Total Pages Discovered": "total_pages", "Total Links Found": "total_links",
    "Max Crawl Depth": "max_depth", "Website Structure Complexity": "complexity", "Total Word Count": "total_words",
    "Average Load Time (s)": "avg_load_time", "Site Title": "site_title", "Meta Description": "meta_description",
    "Meta Keywords": "meta_keywords", "Keywords Compilation": "keywords", "Logo URL": "logo_url", "Favicon URL": "favicon_url",
    "About Us URL": "about_url", "About Us Text (Snippet)": "about_text", "Mobile Phone": "mobile_phone",
    "Corporate Phone": "corporate_phone", "Support Phone": "support_phone", "Company Phone": "general_phone", "Email": "email",
    "Address": "address", "Company City": "city", "Company State": "state", "Google Maps Integration Status": "maps_status",
    "Primary Google Maps Link": "primary_maps_link", "All Google Maps Links": "all_maps", "Facebook URL": "facebook",
    "Instagram URL": "instagram", "TikTok URL": "tiktok", "LinkedIn URL": "linkedin", "Twitter URL": "twitter",
    "Pinterest URL": "pinterest", "YouTube URL": "youtube", "Instagram Handle": "instagram_handle", "IG Score": "ig_score",
    "Worked With Creators": "worked_with_creators", "Integrated Video Links": "videos", "D2C Presence": "d2c_presence",
    "E-Commerce Presence": "ecommerce_presence", "Social Media Presence (Feature)": "social_media_presence",
    "Integrated Videos (Feature)": "video_presence", "SaaS / Platform": "saas_platform", "Blog / Content": "blog_presence",
    "CTA Presence": "cta_presence", "Product Listings": "product_listings", "Contact Forms": "contact_forms",
    "Newsletter Signup": "newsletter_signup", "SSL Secure": "ssl_secure", "Mobile Responsive": "mobile_responsive",
}


def flatten(sites: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """SS4: 84 columns; booleans as Yes / No, lists joined, products spread out."""
    kinds = dict(sites.dtypes)
    fields = []
    for label, name in CSV_COLUMNS.items():
        c = F.col(name)
        if kinds[name] == "boolean":
            c = T.yes_no(c)
        elif kinds[name] == "array<string>":
            c = F.array_join(c, ", ")
        elif name == "about_text":
            c = F.concat(F.substring(c, 1, 200), F.lit("..."))
        elif name == "keywords":
            c = F.coalesce(c, F.lit(""))
        fields.append(c.alias(label))
    products = [F.try_element_at(F.col(column), F.lit(i))[field].alias(label) for label, (column, i, field) in PRODUCT_COLUMNS.items()]
    return sites.select(*keep, *fields, *products)
