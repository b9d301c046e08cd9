"""URL column functions: split, normalise, resolve.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave.functions import text as T

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def netloc(url: Column) -> Column:
    """Host and port; empty when the URL has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def site_of(url: Column) -> Column:
    """LK11: netloc with ``www.`` removed wherever it stands."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _dot_segments(path: Column, rooted: Column) -> Column:
    """Resolve ``.`` and ``..``; a merged path also loses its empty inner segments."""
    def fold(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        between = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
        segments = F.concat(F.filter(between, lambda s: rooted | (s != "")), F.array(last))
        # the empty segment before the first slash is one that ".." can take away
        kept = F.aggregate(
            segments,
            F.array(F.lit("")),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ended = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return T.let(F.array_join(F.concat(kept, ended), "/"), lambda joined: F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined)))

    return T.let(F.split(path, "/", -1), fold)


def resolve(base: Column, href: Column) -> Column:
    """LK3: resolve a reference against an http(s) base URL (RFC 3986).

    Paths with dot segments or doubled slashes take the segment fold; all
    others are pure concatenation.
    """
    scheme = F.regexp_extract(base, _SCHEME, 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")

    def relative(ref: Column) -> Column:
        def with_path(ref_path: Column) -> Column:
            rooted = ref_path.startswith("/")
            merged = F.when(rooted, ref_path).otherwise(
                F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path))
            tail = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
            path = T.let(merged, lambda m: F.when(
                m.rlike(r"/\.\.?(?:/|\z)") | (~rooted & m.contains("//")), _dot_segments(m, rooted)).otherwise(m))
            return F.concat(root, path, tail)
        return T.let(F.regexp_extract(ref, r"^([^?#]*)", 1), with_path)

    def any_form(ref: Column) -> Column:
        return (
            F.when(ref == "", base)
            .when(ref.rlike(_SCHEME), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("#"), F.concat(without_fragment(base), ref))
            .when(ref.startswith("?"), F.concat(root, path_of(base), ref))
            .otherwise(relative(ref))
        )

    cleaned = F.regexp_replace(href, r"[\t\r\n]|\A[\x00-\x20]+", "")
    # "https:page" with the base's own scheme is a relative reference
    bare = T.let(cleaned, lambda ref: F.when(
        F.lower(F.regexp_extract(ref, _SCHEME, 1)) == F.lower(scheme), F.regexp_replace(ref, _SCHEME + "(?!//)", "")).otherwise(ref))
    return T.let(bare, any_form)
