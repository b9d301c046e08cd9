"""Page projections (PG*, SRC2): one narrow, JVM-only step over the page table.

Input: ``pages(page_id, url, html[, status_code, load_time])``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.rows import unnest
from siteweave.session import materialise


# --- labels of one fetch -----------------------------------------------------

def fetch_verdict(status: Column, html: Column) -> Column:
    """SRC2: accept, reject or retry."""
    return (
        F.when((status == 200) & (F.length(html) > K.MIN_HTML_LENGTH), "accept")
        .when(status.isin(K.TERMINAL_STATUS), "reject")
        .otherwise("retry")
    )


def accepted(pages: DataFrame) -> DataFrame:
    """SRC2: pages worth analysing.  The filter runs before any parsing."""
    return pages.where(fetch_verdict(F.col("status_code"), F.col("html")) == "accept")


def has_error(html: Column) -> Column:
    """PG12: any error phrase, case-insensitive ('.' of a phrase matches any character)."""
    return F.lower(html).rlike("|".join(p.lower() for p in K.ERROR_PHRASES))


def has_effective_error(html: Column) -> Column:
    """PG12 as it takes effect on lower-cased html: two phrases only (Q3)."""
    return T.contains_any(F.lower(html), K.EFFECTIVE_ERROR_PHRASES)


def error_class(html: Column) -> Column:
    """PG13: first matching class; the last branch is shadowed by an earlier one (Q3)."""
    lowered = F.lower(html)
    return (
        F.when(html.contains("520: Web server is returning an unknown error"), "520 Unknown Server Error")
        .when(html.contains("Just a moment..."), "Cloudflare Challenge")
        .when(html.contains("Access Denied"), "Access Denied")
        .when(html.contains("Service Unavailable"), "Service Unavailable")
        .when(html.contains("Cloudflare"), "Cloudflare Protection")
        .when(T.contains_any(lowered, K.EFFECTIVE_ERROR_PHRASES), "CAPTCHA Challenge")
        .when(T.contains_any(html, ["Not Found", "404 Error"]), "404 Not Found")
        .otherwise("UNKNOWN")
    )


def retryable(status: Column, html: Column) -> Column:
    """PG14: retryable status, or an error page."""
    return F.coalesce(status.isin(K.RETRYABLE_STATUS), F.lit(False)) | has_error(html)


def status_label(status: Column) -> Column:
    """PG20: website status text."""
    code = status.cast("string")
    return (
        F.when(status == 200, "✅ Good (200 OK)")
        .when(status.isin(301, 302), F.concat(F.lit("↗️ Redirect ("), code, F.lit(")")))
        .otherwise(F.concat(F.lit("⚠️ Warning ("), code, F.lit(")")))
    )


# --- page kinds -----------------------------------------------------------------

def page_type(url: Column) -> Column:
    """PG9: first keyword group found in the URL."""
    lowered = F.lower(url)
    kind = F.lit("general")
    for name, words in reversed(K.PAGE_TYPES):
        kind = F.when(T.contains_any(lowered, words), F.lit(name)).otherwise(kind)
    return kind


def is_contact_page(url: Column, text: Column) -> Column:
    """PG10."""
    return F.lower(url).contains("contact") | F.lower(text).contains("contact")


def is_about_page(url: str = "url", text: str = "text") -> Column:
    """PG11 over two named columns."""
    return T.contains_any(F.lower(url), K.ABOUT_URL_KEYWORDS) | T.contains_any(f"lower({text})", K.ABOUT_TEXT_PHRASES)


# --- head of the document ----------------------------------------------------------

def site_title(title: Column) -> Column:
    """PG4, site level: collapsed, 200 characters."""
    return F.substring(T.collapse(title), 1, 200)


def site_meta(metas: Column, name: str, limit: int) -> Column:
    """PG5 / PG6, site level: name in any case, collapsed, cut; null when empty."""
    raw = H.meta_content(metas, name, ignore_case=True)
    return T.blank_to_null(F.substring(T.collapse(T.strip(raw)), 1, limit))


def _linked(base: Column, ref: Column) -> Column:
    """Resolution rule of icons and logos: ``//`` means https, http stays, else join."""
    return (
        F.when(ref.startswith("//"), F.concat(F.lit("https:"), ref))
        .when(ref.startswith("http"), ref)
        .otherwise(U.resolve(base, ref))
    )


def icon_href(link_tags: Column) -> Column:
    """PG15: href of the first icon link by kind of ``rel``."""
    def href_of(rel: str) -> Column:
        def has_rel(attrs: Column) -> Column:
            return attrs.contains(rel.split(" ")[-1]) & (T.collapse(T.strip(H.attr(attrs, "rel", decode=False))) == rel)

        first = F.try_element_at(F.filter(link_tags, has_rel), F.lit(1))
        return T.blank_to_null(H.attr(first, "href"))

    return F.coalesce(*[href_of(rel) for rel in K.FAVICON_RELS])


def favicon(href: Column, base: Column) -> Column:
    """PG15: resolved icon, else the default location."""
    return F.when(href.isNull(), U.resolve(base, F.lit("/favicon.ico"))).otherwise(_linked(base, href))


def is_logo_url(url: Column) -> Column:
    """PG17."""
    lowered = F.lower(url)
    return T.contains_any(lowered, K.LOGO_EXTENSIONS) & ~T.contains_any(lowered, K.LOGO_GENERIC_TERMS)


# --- file names ------------------------------------------------------------------------

def file_name(url: Column, domain: Column, index: Column) -> Column:
    """PG19: ``domain_path_007``, at most 100 characters."""
    path = F.translate(F.regexp_replace(U.path_of(url), r"\A/+|/+\z", ""), "/?", "__")
    number = F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string"))
    plain = F.concat_ws("_", domain, F.lit("page"), number)
    return F.when((path == "") | (path == domain), plain).otherwise(
        F.substring(F.concat_ws("_", domain, path, number), 1, 100)
    )


def safe_name(url: Column) -> Column:
    """PG19, whole-URL variant."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.translate(bare, "/:?=&", "_____")


# --- tables -------------------------------------------------------------------------------

def page_texts(signals: DataFrame) -> DataFrame:
    """PG2, PG3."""
    return signals.select("page_id", "text", T.word_count(F.col("text")).alias("word_count"))


def description() -> Column:
    """PG5, page level: exact name, content as it stands."""
    return H.meta_content(F.col("metas"), "description", ignore_case=False)


def head_columns() -> list[Column]:
    """PG4, PG5, PG6, PG15 from the signals of a page."""
    metas = F.col("metas")
    return [
        F.col("title"),
        site_title(F.col("title")).alias("site_title"),
        description().alias("description"),
        site_meta(metas, "description", 500).alias("meta_description"),
        site_meta(metas, "keywords", 300).alias("meta_keywords"),
        favicon(icon_href(F.col("icons")), F.col("url")).alias("favicon_url"),
    ]


def page_heads(signals: DataFrame) -> DataFrame:
    """PG4, PG5, PG6, PG15."""
    return signals.select("page_id", *head_columns())


def page_kinds(signals: DataFrame) -> DataFrame:
    """PG9, PG10, PG11."""
    url, text = F.col("url"), F.col("text")
    return signals.select(
        "page_id", "site_id",
        page_type(url).alias("page_type"),
        is_contact_page(url, text).alias("is_contact_page"),
        is_about_page().alias("is_about_page"),
    )


def fetch_labels(pages: DataFrame) -> DataFrame:
    """SRC2, PG12, PG13, PG14, PG20 over ``status_code`` and ``html``."""
    status, html = F.col("status_code"), F.col("html")
    return pages.select(
        "page_id",
        fetch_verdict(status, html).alias("verdict"),
        has_error(html).alias("has_error"),
        has_effective_error(html).alias("has_effective_error"),
        error_class(html).alias("error_class"),
        retryable(status, html).alias("retryable"),
        status_label(status).alias("status_label"),
    )


def images(signals: DataFrame) -> DataFrame:
    """PG18: resolved image URLs with an accepted file extension, one row each."""
    rows = unnest(signals, ["page_id", "url"], "images", "attrs", "img_seq")
    rows = rows.select("page_id", "url", "img_seq", H.attr(F.col("attrs"), "src").alias("src")).where("src is not null")
    found = rows.select("page_id", "img_seq", U.resolve(F.col("url"), F.col("src")).alias("image_url"))
    base = F.lower(F.regexp_extract(U.path_of(F.col("image_url")), r"([^/]*)\z", 1))
    return found.where(T.ends_with_any(base, K.IMAGE_EXTENSIONS))


def meta_maps(metas: Column) -> Column:
    """PG7: attribute maps of all meta tags of a page, in order; of a repeated attribute the last one counts."""
    def pairs(attrs: Column) -> Column:
        found = F.regexp_extract_all(attrs, F.lit(r"""(?s)([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?"""), 0)
        return F.transform(found, lambda p: F.struct(
            F.lower(F.regexp_extract(p, r"\A([^\s=]+)", 1)).alias("k"),
            F.when(p.contains("="), H.decode_entities(F.regexp_replace(
                F.regexp_extract(p, r"(?s)\A[^\s=]+\s*=\s*(.*)\z", 1), r"""(?s)\A(["'])(.*)\1\z""", "$2"), strict=True)).alias("v")))

    def as_map(attrs: Column) -> Column:
        return T.let(pairs(attrs), lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(
            F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))))

    return F.transform(metas, as_map)


def page_names(pages: DataFrame) -> DataFrame:
    """PG19 over (site_id, page_id, url); the index is the page's position in its site.

    The position comes from counts and ranks in ranges of a site's pages, so no
    task ranks a whole site.
    """
    numbered = site_positions(pages.select("page_id", "url", U.site_of(F.col("url")).alias("site_id")))
    return numbered.select(
        "page_id",
        file_name(F.col("url"), F.col("site_id"), F.col("position")).alias("file_name"),
        safe_name(F.col("url")).alias("safe_name"),
    )


def site_positions(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Zero-based position of each page in its site by page_id, without one task per site.

    Rows are dealt out in ranges of (site, page_id) of about equal numbers of
    rows, whatever the ids are like; a range's offset in a site is the running
    count of those before it.  The dealt rows are stored, so that both uses see
    the same ranges.
    """
    from pyspark.sql import Window

    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialise(rows.repartitionByRange(n, "site_id", "page_id").withColumn("__b", F.spark_partition_id()), "positions")
    sizes = keyed.groupBy("site_id", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("site_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "site_id", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy("site_id", "__b").orderBy("page_id")
    ranked = keyed.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["site_id", "__b"]).select(
        *rows.columns, (F.col("__off") + F.col("__r")).alias("position")
    )
