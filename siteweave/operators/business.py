"""Business metrics (BZ1-BZ4, BZ10-BZ16).  Text operators read (site_id, page_id, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import text as T
from siteweave.functions.keywords import Keywords
from siteweave.operators.facts import best_hit, first_hit

SHORT_INDUSTRIES = K.SHORT_INDUSTRY_KEYWORDS


def keyword_masks(known: Keywords, found: Column | str, groups: dict[str, list[str]], prefix: str) -> list[Column]:
    """One bit mask per keyword group."""
    return [known.mask(found, words).alias(f"{prefix}{i}") for i, words in enumerate(groups.values())]


def _group_masks(texts: DataFrame, groups: dict[str, list[str]], prefix: str) -> DataFrame:
    known = Keywords(*groups.values())
    rows = texts.select("site_id", known.found(F.lower("text")).alias("found"))
    return rows.select("site_id", *keyword_masks(known, "found", groups, prefix))


def mask_scores(groups: dict[str, list[str]], prefix: str) -> list[Column]:
    """Aggregates: distinct keywords present per group."""
    return [F.bit_count(F.bit_or(f"{prefix}{i}")).cast("int").alias(f"{prefix}{i}") for i in range(len(groups))]


def best_group(groups: dict[str, list[str]], prefix: str) -> Column:
    """Group with the highest score, ties to the first listed; null when all are zero."""
    names = list(groups)
    top = F.greatest(*[F.col(f"{prefix}{i}") for i in range(len(names))])
    picks = [F.when((F.col(f"{prefix}{i}") == top) & (top > 0), F.lit(name)) for i, name in enumerate(names)]
    return F.coalesce(*picks)


def industries(texts: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """BZ1: industry per site by count of distinct keywords."""
    groups = groups or K.INDUSTRY_KEYWORDS
    masks = _group_masks(texts, groups, "k")
    scores = masks.groupBy("site_id").agg(*mask_scores(groups, "k"))
    return scores.select("site_id", F.coalesce(best_group(groups, "k"), F.lit("Unknown")).alias("industry"))


def _employees(text: Column, pattern: str) -> Column:
    first = T.first_group(text, "(?iU)" + pattern)
    if pattern.count("(") > 1:
        second = T.first_group(text, "(?iU)" + pattern, 2)
        return F.when(second.isNull(), first).otherwise(F.concat(first, F.lit("-"), second))
    return first


def employees_hit(text: Column) -> Column:
    """BZ2 for one page; numbers are not searched one by one in a text without any of the words."""
    return F.when(T.may_name(text, K.EMPLOYEE_WORDS), first_hit(text, K.EMPLOYEE_PATTERNS, _employees))


def revenue_hit(text: Column) -> Column:
    """BZ3 for one page."""
    return F.when(text.contains("$"), first_hit(text, K.REVENUE_PATTERNS, lambda t, p: F.concat(F.lit("$"), T.first_group(t, "(?iU)" + p))))


def year_hits(text: Column) -> list[Column]:
    """BZ4 for one page: the first match of each pattern."""
    return [T.first_group(text, "(?iU)" + p).alias(f"year{i}") for i, p in enumerate(K.FOUNDED_PATTERNS)]


def founded(as_of_year: int) -> Column:
    """BZ4 aggregate: per pattern only its first match counts; the first in 1800..as_of_year wins (Q15)."""
    picks = []
    for i in range(len(K.FOUNDED_PATTERNS)):
        c = F.col(f"year{i}")
        first = F.min(F.when(c.isNotNull(), F.struct("page_id", c.alias("v"))))["v"]
        picks.append(F.when(first.try_cast("int").between(1800, as_of_year), first))
    return F.coalesce(*picks)


def size_facts(texts: DataFrame, as_of_year: int) -> DataFrame:
    """BZ2, BZ3, BZ4 per site.

    No filter on the text: it would be pushed below the projection that makes
    the text and evaluate that a second time.
    """
    t = F.col("text")
    hits = texts.select(
        "site_id", "page_id", employees_hit(t).alias("emp"), revenue_hit(t).alias("rev"), *year_hits(t))
    return hits.groupBy("site_id").agg(
        best_hit("emp").alias("employees"), best_hit("rev").alias("annual_revenue"), founded(as_of_year).alias("founded_year"))


def budget(texts: DataFrame) -> DataFrame:
    """BZ14: High-End if any high keyword, else Mid-Budget, else Unknown (Q7)."""
    known = Keywords(K.BUDGET_KEYWORDS["High-End"], K.BUDGET_KEYWORDS["Mid-Budget"])
    rows = texts.select("site_id", known.found(F.lower("text")).alias("found")).select(
        "site_id", known.any_of("found", K.BUDGET_KEYWORDS["High-End"]).alias("hi"), known.any_of("found", K.BUDGET_KEYWORDS["Mid-Budget"]).alias("mid"))
    return rows.groupBy("site_id").agg(budget_label(F.bool_or("hi"), F.bool_or("mid")).alias("segmentation"))


def budget_label(high: Column, mid: Column) -> Column:
    return F.when(high, "High-End").when(mid, "Mid-Budget").otherwise("Unknown")


def older_budget(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """BZ15: segment with most distinct keywords, else by employees (over 100, over 20), else Unknown."""
    masks = _group_masks(texts, K.BUDGET_KEYWORDS, "b")
    scores = masks.groupBy("site_id").agg(*mask_scores(K.BUDGET_KEYWORDS, "b"))
    number = F.substring_index("employees", "-", 1).try_cast("bigint")
    by_size = F.when(number > 100, "High-End").when(number > 20, "Mid-Budget").when(number.isNotNull(), "Low-End")
    return scores.join(sizes.select("site_id", "employees"), "site_id", "left").select(
        "site_id", F.coalesce(best_group(K.BUDGET_KEYWORDS, "b"), by_size, F.lit("Unknown")).alias("segmentation"))


# --- scores over one row per site ----------------------------------------------------

def _points(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def _present(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def social_count() -> Column:
    """Number of platforms with a profile."""
    return reduce(lambda a, b: a + b, [_points(_present(p), 1) for p in K.SOCIAL_NAMES])


def digital_presence(platforms: Column) -> Column:
    """BZ10."""
    return T.tier(platforms, [(5, "Strong"), (3, "Moderate"), (1, "Basic"), (0, "Limited")])


def contact_accessibility() -> Column:
    """BZ11 over email, phones, address, primary map link and contact links."""
    methods = (_points(_present("email"), 1) + _points(_present("general_phone") | _present("mobile_phone"), 1)
               + _points(_present("address"), 1) + _points(_present("primary_maps_link"), 1)
               + _points(F.coalesce(F.col("contact_links") > 0, F.lit(False)), 1))
    return T.tier(methods, [(4, "Excellent"), (2, "Good"), (1, "Basic"), (0, "Limited")])


def firmographic_score() -> Column:
    """BZ12."""
    ten = [_present("brand_name"), F.col("industry") != "Unknown", _present("founded_year"), _present("address"),
           _present("email"), _present("general_phone"), social_count() > 0]
    fifteen = [_present("employees"), _present("annual_revenue")]
    return reduce(lambda a, b: a + b, [_points(t, 10) for t in ten] + [_points(t, 15) for t in fifteen])


def engagement_score() -> Column:
    """BZ13 over platforms, total_words, total_pages, map status and main URL."""
    words = step_points(F.col("total_words"), [(10000, 25), (5000, 20), (1000, 15)])
    pages = step_points(F.col("total_pages"), [(20, 25), (10, 20), (5, 15)])
    return (F.least(F.lit(30), social_count() * 5) + words + pages
            + _points(F.col("maps_status") == "Integrated", 10) + _points(F.col("main_url").startswith("https://"), 10))


def step_points(c: Column, steps: list[tuple[int, int]]) -> Column:
    """Points of the first step the value exceeds."""
    points = F.lit(0)
    for bound, value in reversed(steps):
        points = F.when(c > bound, value).otherwise(points)
    return points


def scores(sites: DataFrame) -> DataFrame:
    """BZ10-BZ13, BZ16: add the derived metrics to one row per site."""
    return sites.select(
        "*", digital_presence(social_count()).alias("digital_presence"), contact_accessibility().alias("contact_accessibility"),
        firmographic_score().alias("firmographic_score"), engagement_score().alias("engagement_score"))
