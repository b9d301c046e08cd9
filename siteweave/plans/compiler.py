"""Report compiler (RC1-RC20): text reports back to 106 columns.

Input: ``reports(folder, content)``.  One narrow projection; nothing shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import text as T

CONTENT = "content"


def _artifacts(c: Column) -> Column:
    """Q20: drop the two filler words wherever they stand."""
    return T.strip(F.replace(F.replace(c, F.lit("Not found"), F.lit("")), F.lit("Unknown"), F.lit("")))


def section_field(name: str) -> Column:
    """RC1: first labelled value, '' when absent."""
    label, tail = K.REPORT_FIELDS[name]
    found = F.regexp_extract(CONTENT, f"(?im){re.escape(label)}:{tail}", 1)
    return T.let(found, lambda v: _artifacts(T.strip(v))).alias(name)


def _flat(c: Column) -> Column:
    return F.regexp_replace(c, r"\n\s*", " ")


def _block(pattern: str) -> Column:
    return F.regexp_extract(CONTENT, "(?s)" + pattern, 1)


def domain() -> Column:
    """RC2; the folder name stands in."""
    found = T.strip(F.regexp_extract(CONTENT, K.REPORT_PATTERNS["domain"], 1))
    return F.coalesce(T.blank_to_null(_artifacts(found)), F.col("folder")).alias("domain")


def analysis_date() -> Column:
    """RC2."""
    return T.strip(F.regexp_extract(CONTENT, K.REPORT_PATTERNS["generated"], 1)).alias("analysis_date")


def about_text() -> Column:
    """RC3."""
    raw = T.strip(_block(K.REPORT_PATTERNS["about"]))
    return F.substring(T.collapse(raw), 1, 2000).alias("about_us_text")


def map_links() -> Column:
    """RC4 as an array."""
    return F.regexp_extract_all(_block(K.REPORT_PATTERNS["maps"]), F.lit(K.REPORT_PATTERNS["map_line"]), 1)


def primary_map() -> Column:
    """RC5."""
    found = T.strip(F.regexp_extract(CONTENT, K.REPORT_PATTERNS["primary_map"], 1))
    return F.when(found == "Not found", "").otherwise(found).alias("google_map")


def video_links() -> Column:
    """RC6."""
    found = F.regexp_extract_all(_block(K.REPORT_PATTERNS["videos"]), F.lit(K.REPORT_PATTERNS["video_line"]), 0)
    return F.array_join(found, "; ").alias("video_links")


def sales_notes() -> Column:
    """RC7: the block below the heading's rule (Q12), bullets turned into bars."""
    raw = T.strip(_block(K.REPORT_PATTERNS["notes"]))
    return F.substring(_flat(F.regexp_replace(raw, r"\n\s*[•·]\s*", " | ")), 1, 1000).alias("notes_for_sdr")


def short_description() -> Column:
    """RC8 over the extracted columns (Q14)."""
    about, meta = F.col("about_us_text"), F.col("meta_description")
    first = F.substring_index(about, ".", 1)
    return (
        F.when(F.length(meta) > 20, F.substring(meta, 1, 200))
        .when(F.length(about) > 20, F.when((F.length(first) > 20) & (F.length(first) < 200), F.concat(first, F.lit(".")))
              .otherwise(F.concat(F.substring(about, 1, 200), F.lit("..."))))
        .otherwise("").alias("short_description"))


def discovery_summary() -> Column:
    """RC9."""
    return F.substring(_flat(T.strip(_block(K.REPORT_PATTERNS["discovery"]))), 1, 500).alias("discovery_summary")


def product_items(side: str) -> Column:
    """RC10: products of one block as structs (name, price, url)."""
    pattern, line = K.REPORT_PATTERNS[f"{side}_products"], K.REPORT_PATTERNS["product_line"]
    lines = F.filter(F.split(_block(pattern), "\n"), lambda x: T.strip(x).rlike(line))
    return F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, line, 1).alias("name"), F.regexp_extract(x, line, 2).alias("currency"),
        F.regexp_extract(x, line, 3).try_cast("double").alias("price"), F.regexp_extract(x, line, 4).alias("url")))


def product_columns() -> list[Column]:
    """RC11: 24 columns, '' where there is no product."""
    out = []
    for side in ("min", "max"):
        for i in (1, 2, 3, 4):
            item = F.try_element_at(F.col(f"{side}_items"), F.lit(i))
            out += [F.coalesce(item[p].cast("string"), F.lit("")).alias(f"{side}_price_product_{i}_{p}") for p in ("name", "price", "url")]
    return out


def clean_field(name: str) -> Column:
    """RC12, RC13, RC14: cleaning by the column's name."""
    c = _artifacts(F.col(name))
    c = F.when(c == "✅ Yes", "True").when(c == "❌ No", "False").otherwise(c)
    if "phone" in name:
        c = T.strip(F.substring_index(T.collapse(c), ",", 1))
    if "url" in name:
        c = T.let(c, lambda u: F.when((u == "") | u.startswith("http"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u))
                  .otherwise(F.concat(F.lit("https://"), u)))
    if name in K.NUMERIC_REPORT_FIELDS:
        c = F.regexp_replace(c, r"[^\d.]", "")
    if name in K.TEXT_REPORT_FIELDS:
        c = T.collapse(T.strip(c))
        for phrase in K.REPORT_FILLERS:
            c = T.strip(F.replace(c, F.lit(phrase), F.lit("")))
    return c.alias(name)


def address_parts(address: Column) -> Column:
    """RC15, RC16: struct(city, state, country); US, international and simple forms in order (Q17)."""
    def group(pattern: str, i: int) -> Column:
        return T.strip(F.regexp_extract(address, pattern, i))

    def parts(city: Column, state: Column, country: Column) -> Column:
        blank = F.lit("")
        return F.struct(F.coalesce(city, blank).alias("city"), F.coalesce(state, blank).alias("state"), F.coalesce(country, blank).alias("country"))

    us_state = T.lookup(group(K.US_ADDRESS, 3), K.US_STATES)
    us = parts(group(K.US_ADDRESS, 2), us_state, F.when(us_state.isNotNull(), "United States"))
    last = group(K.INTL_ADDRESS, 4)
    intl = parts(group(K.INTL_ADDRESS, 2), group(K.INTL_ADDRESS, 3), F.coalesce(T.lookup(F.lower(last), K.COUNTRIES), last))
    region = group(K.SIMPLE_ADDRESS, 2)
    named, land = T.lookup(F.upper(region), K.US_STATES), T.lookup(F.lower(region), K.COUNTRIES)
    simple = parts(group(K.SIMPLE_ADDRESS, 1), F.coalesce(named, F.when(land.isNull(), region)), F.when(named.isNotNull(), "United States").otherwise(land))
    none = F.lit("")
    return (F.when(address.rlike(K.US_ADDRESS), us).when(address.rlike(K.INTL_ADDRESS), intl)
            .when(address.rlike(K.SIMPLE_ADDRESS), simple).otherwise(parts(none, none, none)))


def to_boolean(c: Column) -> Column:
    """RC17: anything unclear is False."""
    return F.when(F.lower(c).isin("true", "✅ yes", "yes", "1"), "True").otherwise("False")


def maps_status(status: Column, primary: Column, every: Column) -> Column:
    """RC18."""
    return F.coalesce(T.blank_to_null(status), F.when((primary != "") | (every != ""), "Integrated").otherwise("Not Found"))


def sanitise(c: Column) -> Column:
    """RC20: no line breaks, single blanks, no nulls."""
    return T.strip(T.collapse(F.coalesce(c.cast("string"), F.lit(""))))


def parse_reports(reports: DataFrame) -> DataFrame:
    """RC1-RC14: all extracted and cleaned fields, before defaults."""
    raw = reports.select(
        "folder", domain(), analysis_date(), *[section_field(n) for n in K.REPORT_FIELDS], about_text(),
        map_links().alias("maps"), primary_map(), video_links(), sales_notes(), discovery_summary(),
        product_items("min").alias("min_items"), product_items("max").alias("max_items"))
    wide = raw.select(
        "*", F.array_join("maps", "; ").alias("all_google_maps_links"), F.size("maps").cast("string").alias("google_maps_links_count"),
        short_description(), *product_columns()).drop("maps", "min_items", "max_items")
    return wide.select("folder", *[clean_field(c) for c in wide.columns if c != "folder"])


def compile_reports(reports: DataFrame) -> DataFrame:
    """RC15-RC20: the 106 columns in their order."""
    parsed = parse_reports(reports)
    rows = parsed.withColumn("parts", address_parts(F.col("address")))
    extra = {
        "address_city": F.col("parts.city"), "address_state": F.col("parts.state"), "address_country": F.col("parts.country"),
        "keywords": F.col("keywords_compilation"), "status": F.lit(K.REPORT_STATUS),
        "google_maps_integration_status": maps_status(
            F.col("google_maps_integration_status"), F.col("primary_google_maps_link"), F.col("all_google_maps_links")),
        **{name: to_boolean(F.col(name)) for name in K.BOOLEAN_REPORT_FIELDS},
    }
    return rows.select(*[sanitise(extra.get(c, F.col(c) if c in rows.columns else F.lit(""))).alias(c) for c in K.COMPILED_COLUMNS])
