"""Links of pages: discovery, classification, counts and per-site reports (LK*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.rows import computed, unnest
from siteweave.operators import dom as D
from siteweave.operators.signals import anchor_rows
from siteweave.operators.topk import top_k
from siteweave.session import materialise


def _followable(anchors: DataFrame, *more: Column | str) -> DataFrame:
    """LK10: anchors that lead somewhere, resolved; excluded file types are left out."""
    href = F.col("href")
    kept = anchors.where((href != "") & ~href.startswith("#") & ~href.startswith("javascript:"))
    own = ["page_id", "site_id", "source_page", "link_seq"]
    resolved = computed(kept, [*own, *more], url=U.resolve(F.col("source_page"), href))
    return resolved.select(*own, "url", *[c for c in resolved.columns if c not in (*own, "url")]).where(~T.ends_with_any(F.lower(F.col("url")), K.EXCLUDED_EXTENSIONS))


def discovered(signals: DataFrame) -> DataFrame:
    """LK1, LK10: every followable anchor of every page, resolved, in document order."""
    return _followable(anchor_rows(signals), H.compact_text_of(H.piece_inner(F.col("piece"))).alias("anchor_text"))


def placed_links(dom: DataFrame) -> DataFrame:
    """LK1 with the link's place: navigation and footer flags (LK7) and context (LK9), classified.

    Ancestors are known to the tree only, so these links come from it; for
    questions without them :func:`page_links` stays in the JVM.
    """
    anchors = D.discovery_places(dom).withColumnsRenamed({"url": "source_page", "elem_seq": "link_seq"})
    anchors = anchors.withColumn("site_id", U.site_of(F.col("source_page"))).withColumn("link_seq", F.col("link_seq").cast("bigint"))
    return classified(_followable(anchors, "anchor_text", "is_navigation", "is_footer", "context"))


def with_depth(links: DataFrame, reached: DataFrame) -> DataFrame:
    """LK1: the depth of each link, one below its page; null where the page was not reached."""
    depth = reached.select("site_id", F.col("url").alias("source_page"), (F.col("depth") + 1).cast("int").alias("depth"))
    return links.join(depth, ["site_id", "source_page"], "left")


def link_type(url: Column, site: Column) -> Column:
    """LK4: internal, social, maps or external; social is a substring test (Q10)."""
    host = U.site_of(url)
    return (
        F.when(host == site, "internal")
        .when(T.contains_any(host, K.DISCOVERY_SOCIAL), "social")
        .when(T.contains_any(url, K.MAP_IFRAME_HOSTS), "maps")
        .otherwise("external")
    )


def exact_social(url: Column) -> Column:
    """Q10, exact variant: the host is a social domain or a subdomain of one."""
    host = U.site_of(url)
    hit = F.lit(False)
    for domain in K.DISCOVERY_SOCIAL:
        hit = hit | (host == domain) | host.endswith("." + domain)
    return hit


def classified(links: DataFrame) -> DataFrame:
    """LK4, LK6 (discovery flavour): add type and flags.

    The site of a link is the site of the page it stands on, so nothing is joined.
    """
    rows = links.withColumn("link_type", link_type(F.col("url"), F.col("site_id")))
    internal, lowered = F.col("link_type") == "internal", F.lower(F.col("url"))
    return rows.select(
        "*",
        (internal & T.contains_any(lowered, K.DISCOVERY_CONTACT_KEYWORDS)).alias("is_contact"),
        (internal & lowered.contains("about")).alias("is_about"),
        (F.col("link_type") == "maps").alias("is_google_maps"),
    )


def page_links(signals: DataFrame) -> DataFrame:
    """LK1 + LK4 + LK6 in one narrow step."""
    return classified(discovered(signals))


def guarded(pages: DataFrame) -> DataFrame:
    """LK16: pages whose links may be read (no missing html, no error page)."""
    from siteweave.operators.pages import has_error

    return pages.where(F.col("html").isNotNull() & (F.col("html") != "") & ~has_error(F.col("html")))


def by_section(links: DataFrame) -> DataFrame:
    """One row per (link, section); a contact link counts in two sections, a map link in none."""
    sections = F.filter(
        F.array(
            F.when(F.col("link_type").isin("internal", "external", "social"), F.col("link_type")),
            F.when(F.col("is_contact"), F.lit("contact")),
        ),
        lambda s: s.isNotNull(),
    )
    return unnest(links, links.columns, sections, "section").drop("pos")


def first_links(links: DataFrame) -> DataFrame:
    """LK12: first occurrence of every URL in each section of a site.

    An aggregate, not a window: repeated links shrink before the shuffle, and a
    large site spreads over all tasks because the URL is part of the key.
    """
    order = F.struct("page_id", "link_seq")
    places = [c for c in ("depth", "is_navigation", "is_footer", "context") if c in links.columns]
    payload = F.struct("source_page", "anchor_text", "is_contact", "is_about", *places)
    first = by_section(links).groupBy("site_id", "section", "url").agg(
        F.min(F.struct(order.alias("pos"), payload.alias("row"))).alias("first")
    )
    return first.select("site_id", "section", "url", F.col("first.pos.page_id"), F.col("first.pos.link_seq"), "first.row.*")


def counts(links: DataFrame) -> DataFrame:
    """LK13: links per site and section (occurrences)."""
    kind = F.col("link_type")
    return links.groupBy("site_id").agg(
        F.count_if(kind == "internal").alias("internal_links"),
        F.count_if(kind == "external").alias("external_links"),
        F.count_if(kind == "social").alias("social_links"),
        F.count_if(kind == "maps").alias("maps_links"),
        F.count_if(F.col("is_contact")).alias("contact_links"),
        F.count("*").alias("total_links"),
    )


def bucket(is_about: Column, is_contact: Column, is_navigation: Column, is_footer: Column) -> Column:
    """LK14: report bucket of an internal link."""
    return (
        F.when(is_about, "About Pages").when(is_contact, "Contact Pages")
        .when(is_navigation, "Navigation Links").when(is_footer, "Footer Links").otherwise("General Pages")
    )


def internal_buckets(links: DataFrame, shown: int = 5) -> DataFrame:
    """LK14: per site and bucket the number of links, the first five URLs, how many are left and where the first one stands.

    ``links`` come from :func:`placed_links`.
    """
    rows = links.where(F.col("link_type") == "internal").select(
        "site_id", bucket(F.col("is_about"), F.col("is_contact"), F.col("is_navigation"), F.col("is_footer")).alias("bucket"),
        "page_id", "link_seq", "url",
    )
    rows = materialise(rows, "buckets")  # read twice: once for the totals, once for the first URLs
    keys = ["site_id", "bucket"]
    totals = rows.groupBy(*keys).agg(F.count("*").alias("links"), F.min(F.struct("page_id", "link_seq")).alias("first"))
    firsts = top_k(rows, keys, [F.col("page_id"), F.col("link_seq")], shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", "url"))).alias("shown"))
    return totals.join(firsts, keys).select(
        *keys, "links", F.col("shown.url").alias("urls"),
        F.greatest(F.col("links") - shown, F.lit(0)).alias("more"), "first",
    )


def external_domains(links: DataFrame, shown: int = 10) -> DataFrame:
    """LK15: external links per domain, the first ten domains in first-seen order."""
    domains = links.where(F.col("link_type") == "external").groupBy("site_id", U.netloc(F.col("url")).alias("domain")).agg(
        F.count("*").alias("links"), F.min(F.struct("page_id", "link_seq")).alias("first_seen"))
    return top_k(domains, ["site_id"], [F.col("first_seen")], shown).select(
        "site_id", "domain", "links", F.col("rn").cast("bigint").alias("rank"))


def complexity(total_pages: Column) -> Column:
    """LK19."""
    return T.tier(total_pages, K.COMPLEXITY_TIERS)


def site_structure(pages: DataFrame, links: DataFrame) -> DataFrame:
    """LK18, LK19 without a crawl: distinct internal URLs plus the main page, link occurrences.

    Distinct URLs are counted through (site, url) groups, so a large site is
    counted by many tasks.
    """
    main = main_pages(pages).select("site_id", F.col("main_url").alias("url"), F.lit(0).alias("n"))
    inside = F.when(F.col("link_type") == "internal", F.col("url"))
    per_url = main.unionByName(links.select("site_id", inside.alias("url"), F.lit(1).alias("n"))).groupBy("site_id", "url").agg(F.sum("n").alias("n"))
    # links that lead elsewhere have no URL here: they count as links, not as pages
    sites = per_url.groupBy("site_id").agg(F.count("url").alias("total_pages"), F.sum("n").alias("total_links"))
    return sites.select("site_id", "total_pages", "total_links", complexity(F.col("total_pages")).alias("complexity"))


def main_pages(pages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Q1: the main page of each site: the seeded URL if stored, else the lowest page_id."""
    rows = pages.select(U.site_of(F.col("url")).alias("site_id"), "page_id", F.col("url").alias("main_url"))
    if seeds is not None:
        # one row per seed: matching on the URL keeps this an equi join without a hot key
        marks = seeds.select(F.col("main_url"), F.lit(0).alias("seeded")).distinct()
        rows = rows.join(marks, "main_url", "left")
    else:
        rows = rows.withColumn("seeded", F.lit(1))
    best = F.min(F.struct(F.coalesce("seeded", F.lit(1)).alias("s"), "page_id", "main_url"))
    return rows.groupBy("site_id").agg(best.alias("b")).select("site_id", F.col("b.page_id").alias("page_id"), "b.main_url")


def pages_to_analyse(pages: DataFrame, links: DataFrame, limit: int = K.MAX_PAGES_PER_SITE) -> DataFrame:
    """LK20: main URL and internal URLs of a site, distinct; the first ``limit`` with the main URL first,
    then in lexicographic order (Q2)."""
    main = main_pages(pages).select("site_id", F.col("main_url").alias("url"), F.lit(0).alias("later"))
    inside = links.where(F.col("link_type") == "internal").select("site_id", "url", F.lit(1).alias("later"))
    urls = main.unionByName(inside).groupBy("site_id", "url").agg(F.min("later").alias("later"))
    return top_k(urls, ["site_id"], [F.col("later"), F.col("url")], limit).select(
        "site_id", "url", F.col("rn").cast("bigint").alias("position"))


def unprocessed(pages: DataFrame, processed: DataFrame) -> DataFrame:
    """LK21: pages whose URL was not handled before, each URL once."""
    done = processed.select("url").distinct()
    keep = pages.select("url", "page_id").join(done, "url", "left_anti").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return pages.join(keep.select("page_id"), "page_id", "left_semi")
