"""Contact facts (CT*).  Text operators read (site_id, page_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions import urls as U
from siteweave.functions.rows import computed, unnest, unnest_structs
from siteweave.operators.facts import best_hit, first_hit, first_of, first_values
from siteweave.operators.signals import anchor_rows, ld_rows

PHONE_KINDS = ["mobile", "corporate", "support", "general"]


def phone_is_valid(digits: Column) -> Column:
    """CT3: ten digits, area and exchange start with 2-9 and are not 911."""
    return digits.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$") & ~digits.rlike(r"^911|^...911")


def phones_in(text: Column, kind: str) -> Column:
    """CT2: valid formatted phones of one kind in a text."""
    if kind == "general":
        found = T.all_groups(text, r"(?iU)\b" + K.PHONE + r"\b")
    else:
        found = F.concat(*[T.all_groups(text, rf"(?iU){label}[:\s]*" + K.PHONE) for label in K.PHONE_LABELS[kind]])
    digits = F.filter(F.transform(found, lambda p: F.regexp_replace(p, "[^0-9]", "")), phone_is_valid)
    return F.array_distinct(F.transform(
        digits, lambda d: F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))))


def phone_rows(texts: DataFrame) -> DataFrame:
    """CT2: every phone of every page."""
    def tagged(kind: str) -> Column:
        return F.transform(phones_in(F.col("text"), kind), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("phone")))

    # the number without its prefix stands in every phone of any kind: other texts are not searched kind by kind
    found = F.when(F.col("text").rlike("(?iU)" + K.PHONE_CORE), F.concat(*[tagged(kind) for kind in PHONE_KINDS]))
    return unnest_structs(texts, ["site_id", "page_id"], found)


def phones(texts: DataFrame) -> DataFrame:
    """CT2: per site and kind the first three distinct phones."""
    return first_values(phone_rows(texts), "phone", ["site_id", "kind"], 3).withColumnRenamed("joined", "phones")


def email_is_valid(email: Column) -> Column:
    """CT6."""
    return (email != "") & (F.length(email) <= 254) & ~T.contains_any(F.lower(email), K.EMAIL_ASSET_EXTENSIONS) & email.rlike(K.EMAIL_VALID)


def mailto(anchors: Column) -> Column:
    """CT4: address of the page's first mailto link, null unless valid."""
    hrefs = F.transform(F.filter(anchors, lambda p: F.lower(p).contains("mailto:")), lambda p: H.attr(H.piece_attrs(p), "href"))
    first = F.try_element_at(F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:")), F.lit(1))
    address = F.substring_index(F.replace(first, F.lit("mailto:"), F.lit("")), "?", 1)
    return T.let(address, lambda a: F.when(email_is_valid(a), a))


def emails_in(text: Column) -> Column:
    """CT5, CT6: valid addresses in a text."""
    found = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit("(?iU)" + K.EMAIL), 0))
    return F.filter(found, email_is_valid)


def emails(signals: DataFrame) -> DataFrame:
    """CT4, CT5: per site the mailto address of the first page that has a valid one,
    else the smallest address in any text (Q2)."""
    rows = signals.select("site_id", "page_id", mailto(F.col("anchors")).alias("m"), F.array_min(emails_in(F.col("text"))).alias("t"))
    return rows.groupBy("site_id").agg(
        first_of(F.col("m"), "page_id").alias("mailto_email"), F.min("t").alias("text_email")
    ).withColumn("email", F.coalesce("mailto_email", "text_email"))


def _address(text: Column, pattern: str) -> Column:
    found = F.filter(T.all_groups(text, "(?U)" + pattern), lambda a: a.contains(","))
    return T.strip(F.try_element_at(found, F.lit(1)))


def address_hit(text: Column) -> Column:
    """CT7 for one page."""
    # every address ends in letters and a number of five digits, and counts only with a comma: other texts are not searched number by number
    likely = text.contains(",") & text.rlike(r"(?U)\d{5}") & text.rlike(r"(?U)[A-Za-z]{2}\s*\d{5}")
    return F.when(likely, first_hit(text, K.ADDRESS_PATTERNS, _address))


def city(address: Column) -> Column:
    """CT8; empty when the address does not name one."""
    return T.strip(F.regexp_extract(address, K.CITY_STATE, 1))


def state(address: Column) -> Column:
    """CT8; empty when the address does not name one."""
    return F.regexp_extract(address, K.CITY_STATE, 2)


def addresses(texts: DataFrame) -> DataFrame:
    """CT7, CT8 per site."""
    hits = computed(texts, ["site_id", "page_id"], hit=address_hit(F.col("text"))).where("hit is not null")
    sites = hits.groupBy("site_id").agg(best_hit("hit").alias("address"))
    return sites.select("*", city(F.col("address")).alias("city"), state(F.col("address")).alias("state"))


def social_hits(signals: DataFrame) -> DataFrame:
    """CT9 candidates: (site_id, page_id, link_seq, platform, profile)."""
    lowered = F.lower("href")
    platforms = F.array_distinct(F.filter(
        F.array(*[F.when(lowered.contains(d), F.lit(p)) for d, p in K.SOCIAL_PLATFORMS]), lambda p: p.isNotNull()))
    profile = F.regexp_replace(F.substring_index("href", "?", 1), r"/+\z", "")
    hits = unnest(anchor_rows(signals), ["site_id", "page_id", "link_seq", "href"], platforms, "platform")
    return hits.select("site_id", "page_id", "link_seq", profile.alias("profile"), "platform")


def social_profiles(signals: DataFrame) -> DataFrame:
    """CT9: first profile per site and platform."""
    return social_hits(signals).groupBy("site_id", "platform").agg(
        F.min(F.struct("page_id", "link_seq", "profile"))["profile"].alias("profile"))


def social_columns(profiles: DataFrame) -> DataFrame:
    """CT9 as one column per platform and site."""
    return profiles.groupBy("site_id").agg(
        *[F.max(F.when(F.col("platform") == p, F.col("profile"))).alias(p) for p in K.SOCIAL_NAMES])


def brand_from_title(title: Column) -> Column:
    """CT1, title rules: the first of nine patterns that matches decides; else a separator; else the whole title."""
    def has_word(c: Column) -> Column:
        return T.contains_any(F.lower(c), K.PRODUCT_WORDS)

    name = title
    for sep in reversed(K.TITLE_SEPARATORS):
        name = F.when(title.contains(sep), T.strip(F.substring_index(title, sep, 1))).otherwise(name)
    for pattern in reversed(K.BRAND_TITLE_PATTERNS):
        regex = "(?iuU)" + pattern
        part1 = T.strip(F.regexp_extract(title, regex, 1))
        if pattern.count("(.") > 1:
            part2 = T.strip(F.regexp_extract(title, regex, 2))
            choice = F.when(has_word(part1) & ~has_word(part2) & (part2 != ""), part2)
            choice = choice.when(has_word(part2) & ~has_word(part1) & (part1 == ""), part2).otherwise(part1)
        else:
            choice = part1
        name = F.when(title.rlike(regex), choice).otherwise(name)
    return name


def brand_from_host(url: Column) -> Column:
    """CT1, last resort: first label of the host in title case."""
    label = F.substring_index(U.site_of(url), ".", 1)
    return F.initcap(F.replace(label, F.lit("-"), F.lit(" ")))


def ld_names(signals: DataFrame) -> DataFrame:
    """CT1, JSON-LD rule: names of Organizations and WebSites."""
    docs = ld_rows(signals)
    kind = F.try_variant_get(F.col("doc"), '$["@type"]', "string")
    name = F.try_variant_get(F.col("doc"), "$.name", "string")
    return docs.where(kind.isin("Organization", "WebSite") & (name != "")).select("site_id", "page_id", "ld_seq", T.strip(name).alias("name"))


def ld_brand(signals: DataFrame) -> DataFrame:
    """CT1, JSON-LD rule: name of the first Organization or WebSite of a site."""
    return ld_names(signals).groupBy("site_id").agg(F.min(F.struct("page_id", "ld_seq", "name"))["name"].alias("ld_brand"))


def brands(mains: DataFrame, ld: DataFrame) -> DataFrame:
    """CT1: ``mains(site_id, main_url, title)`` joined with the JSON-LD names, one row per site on both sides."""
    from_title = brand_from_title(F.col("title"))
    return mains.join(ld, "site_id", "left").select(
        "site_id", F.coalesce("ld_brand", from_title, brand_from_host(F.col("main_url"))).alias("brand_name"))


def older_brands(mains: DataFrame, signals: DataFrame) -> DataFrame:
    """CT1, older variant: the main title cut at a separator, else the first JSON-LD name of any type."""
    title = F.col("title")
    cut = title
    for sep in reversed(K.TITLE_SEPARATORS):
        cut = F.when(title.contains(sep), T.strip(F.substring_index(title, sep, 1))).otherwise(cut)
    name = F.try_variant_get(F.col("doc"), "$.name", "string")
    ld = ld_rows(signals).where(name != "").groupBy("site_id").agg(
        F.min(F.struct("page_id", "ld_seq", name.alias("name")))["name"].alias("ld_name"))
    return mains.join(ld, "site_id", "left").select("site_id", F.coalesce(cut, "ld_name").alias("brand_name"))
