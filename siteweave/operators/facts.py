"""Facts read from the visible text of one page, and how a site combines them.

Text is matched page by page and the matches are aggregated, so no site's text
is ever concatenated (Q19) and a site with most of the pages costs no more
than its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions import text as T
from siteweave.operators.topk import top_k


def first_of(value: Column, *order: str) -> Column:
    """Aggregate: value of the first row, in the given order, that has one."""
    return F.min(F.when(value.isNotNull(), F.struct(*order, value.alias("v"))))["v"]


def first_hit(text: Column, patterns: Sequence[str], make=None) -> Column:
    """struct(pattern, v) of the first pattern that matches the text; null when none does."""
    hit = F.lit(None).cast("struct<pattern:int,v:string>")
    for i, pattern in reversed(list(enumerate(patterns))):
        value = make(text, pattern) if make else T.first_group(text, "(?iU)" + pattern)
        hit = F.when(value.isNotNull(), F.struct(F.lit(i).alias("pattern"), value.alias("v"))).otherwise(hit)
    return hit


def best_hit(hit: str) -> Column:
    """Aggregate: lowest pattern, then earliest page.

    A page's own lowest pattern is enough: a page that also matches a higher
    one would lose to its lower one anyway.
    """
    return F.min(F.when(F.col(hit).isNotNull(), F.struct(F.col(f"{hit}.pattern"), F.col("page_id"), F.col(f"{hit}.v").alias("v"))))["v"]


def distinct_values(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Distinct non-null values per group; repeated ones shrink before the shuffle."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min("page_id").alias("first_page"))


def first_values(rows: DataFrame, value: str, keys: Sequence[str], k: int, sep: str = ", ") -> DataFrame:
    """The k smallest distinct values per group, joined."""
    kept = top_k(distinct_values(rows, value, keys), keys, [F.col(value)], k)
    return kept.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), sep).alias("joined"))
