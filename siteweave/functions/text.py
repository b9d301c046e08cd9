"""Column functions on plain text.  All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave.constants import WS, WS_SIGNS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that uses it.

    Keeps nested expressions small: without it each use would repeat the whole
    sub-expression in the plan.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks; only the ends of the text are looked at."""
    return F.btrim(c, F.lit(WS_SIGNS))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; most places are told by one class of signs."""
    return F.regexp_replace(c, rf"(?![\x21-\x7e]){WS}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def word_count(c: Column) -> Column:
    """Number of white-space separated tokens (PG3), without building an array."""
    return let(strip(collapse(c)), lambda flat: F.when(flat == "", F.lit(0)).otherwise(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1
    )).cast("bigint")


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """True when any of the words is a substring.

    Given SQL text (for page texts), the test is a chain of ``contains`` that
    stays in generated code; given a column (for URLs and other short strings)
    it is one alternation.
    """
    if isinstance(c, str):
        return F.expr("(" + " OR ".join(f"contains({c}, '{word}')" for word in words) + ")")
    return c.rlike("|".join(re.escape(word) for word in words))


def may_name(c: Column, words: Sequence[str]) -> Column:
    """False only where no pattern that ignores case finds one of the words (small ASCII letters) in the text.

    Such patterns also take the long s and the Turkish i, which ``lower`` leaves or takes apart.
    """
    return reduce(or_, [*[F.lower(c).contains(word) for word in words], *[c.contains(sign) for sign in "\u017f\u0131\u0130"]])


def ends_with_any(c: Column, suffixes: Sequence[str]) -> Column:
    """True when the text ends with any of the suffixes; only its end is looked at."""
    longest = max(map(len, suffixes))
    return F.substring(c, -longest, longest).rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + r")\z")


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group of the first match, null when there is no match or it is empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def yes_no(c: Column, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(c, F.lit(yes)).otherwise(F.lit(no))


def tier(score: Column, steps: Sequence[tuple[int, str]]) -> Column:
    """Label of the first step whose lower bound the score reaches."""
    label = F.lit(steps[-1][1])
    for bound, name in reversed(steps[:-1]):
        label = F.when(score >= bound, F.lit(name)).otherwise(label)
    return label


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Literal dictionary lookup; null when absent."""
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*items), c)
