"""Column functions that read HTML with regular expressions.

They cover everything that does not depend on element nesting, so most
operators never leave the JVM.  Nesting questions (ancestors, CSS selectors)
are answered by :mod:`siteweave.operators.dom`.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave.constants import WS
from siteweave.functions import text as T
from siteweave.functions.text import blank_to_null, strip

SEP = "\x01"
# one foldable string, so the table is a single literal in the plan
_ENTITIES = "\x02".join(f"{name}\x03{chr(code)}" for name, code in name2codepoint.items())
_C1 = "".join(map(chr, range(128, 160)))
_CP1252 = bytes(range(128, 160)).decode("cp1252", "replace")
# attributes of one tag: quoted values may hold '>', unquoted ones may hold quotes
# groups of 400, each matched for good, keep the matcher's stack small without a bound on their number
ATTRS = r"""(?:(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+){1,400}+){0,4000}+"""
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script(?=[\s/>]).*?(?:</script\s*>|\z)"
    r"|<style(?=[\s/>]).*?(?:</style\s*>|\z)"
    r"|<template(?=[\s/>]).*?(?:</template\s*>|\z)"
)
# the first form is the second one's for tags that name no value
TAG = rf"<[a-zA-Z/!?](?:[^>=]*+>|{ATTRS}>|[^>]*+>)"
# white space and separators, a separator among them; most places are told by one class of signs
GAP = rf"(?![\x21-\x7e]){WS}*+{SEP}(?:{SEP}|{WS})*+"
SCRIPT_BODY = r"(?is)<!--.*?-->|<script(?=[\s/>])[^>]*+>(.*?)</script\s*>"
JSON_LD_BODY = (
    r"(?is)<!--.*?-->"
    r"""|<script(?=[\s/>])[^>]*?\stype\s*=\s*["']?(?-i:application/ld\+json)(?=["'\s>])[^>]*+>(.*?)</script\s*>"""
    r"|<script(?=[\s/>])[^>]*+>.*?</script\s*>"
)


def decode_entities(c: Column, strict: bool = False) -> Column:
    """Resolve character references in one pass.

    Text between references and the references themselves are zipped back
    together, so ``&amp;lt;`` stays ``&lt;``.  In text an unknown ``&name;``
    becomes ``&name``.  With ``strict`` (attribute values) only references
    closed by ``;`` count and unknown ones stay as they are.
    """
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*)" + (";" if strict else ";?")

    def numeric(name: Column) -> Column:
        digits = F.regexp_replace(name, r"\A#[xX]?", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        return T.let(code, lambda n: F.when(
            n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF),
            # code points 128-159 are meant as windows-1252
            F.translate(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"), _C1, _CP1252),
        ).otherwise("\N{REPLACEMENT CHARACTER}"))

    def resolved(ref: Column) -> Column:
        return T.let(F.regexp_replace(ref, r"\A&|;\z", ""), lambda name: F.when(name.startswith("#"), numeric(name)).otherwise(
            F.coalesce(F.try_element_at(F.str_to_map(F.lit(_ENTITIES), F.lit("\x02"), F.lit("\x03")), name),
                       ref if strict else F.concat(F.lit("&"), name))))

    def glued(text: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), resolved)
        return F.array_join(F.zip_with(F.split(text, pattern, -1), refs, lambda t, r: F.concat(t, F.coalesce(r, F.lit("")))), "")

    return T.let(c, lambda text: F.when(text.contains("&"), glued(text)).otherwise(text))


def visible_html(html: Column) -> Column:
    """Markup without comments, scripts, styles and templates."""
    return F.regexp_replace(html, HIDDEN, SEP)


def text_of(fragment: Column) -> Column:
    """All text nodes of a fragment, each stripped, joined by one blank."""
    raw = decode_entities(F.regexp_replace(fragment, TAG, SEP))
    return strip(F.regexp_replace(raw, GAP, " "))


def compact_text_of(fragment: Column) -> Column:
    """All text nodes of a fragment, each stripped, joined by nothing."""
    raw = decode_entities(F.regexp_replace(fragment, TAG, SEP))
    return strip(F.regexp_replace(raw, GAP, ""))


def attr(attrs: Column, name: str, decode: bool = True) -> Column:
    """Value of one attribute; null when the attribute is absent.

    The pattern walks over the preceding attributes one by one, so the name is
    never found inside another attribute's value.
    """
    value = r"""("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
    skip = rf"""(?:(?:[\s/]++|(?!{name}\s*=)[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+){{1,400}}+){{0,4000}}+"""
    raw = blank_to_null(F.regexp_extract(attrs, rf"(?is)\A{skip}{name}\s*+=\s*+{value}", 1))
    value = F.regexp_replace(raw, r"""(?s)\A(["'])(.*)\1\z""", "$2")
    return decode_entities(value, strict=True) if decode else value


def open_tags(markup: Column, tag: str) -> Column:
    """Attribute strings of every ``<tag ...>`` in document order."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{tag}(?=[\s/>])({ATTRS})>"), 1)


def title(markup: Column) -> Column:
    """PG4 page title, stripped; null when missing or blank."""
    found = F.regexp_extract(markup, r"(?is)<title(?=[\s>])[^>]*+>([^<]*+)</title", 1)
    return blank_to_null(strip(decode_entities(found)))


def meta_content(metas: Column, name: str, ignore_case: bool) -> Column:
    """Raw ``content`` of the first ``<meta name=...>``; null when absent.  ``metas`` comes from open_tags."""

    def is_named(attrs: Column) -> Column:
        found = attr(attrs, "name", decode=False)
        return attrs.contains(name) & (found == name) if not ignore_case else F.lower(found) == name

    return attr(F.try_element_at(F.filter(metas, is_named), F.lit(1)), "content")


def script_bodies(html: Column) -> Column:
    """Bodies of all scripts."""
    return F.filter(F.regexp_extract_all(html, F.lit(SCRIPT_BODY), 1), lambda s: s != "")


def anchor_pieces(markup: Column) -> Column:
    """One string per ``<a``: its attributes, ``>`` and what follows up to its end or the next anchor."""
    parts = F.split(markup, r"(?i)<a(?=[\s/>])", -1)
    pieces = T.let(parts, lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    return F.transform(pieces, lambda p: F.regexp_extract(p, r"(?is)\A(.*?)(?:</a\s*>|\z)", 1))


def piece_attrs(piece: Column) -> Column:
    return F.regexp_extract(piece, rf"(?s)\A({ATTRS})>", 1)


def piece_inner(piece: Column) -> Column:
    """Inner markup of the anchor a piece begins with."""
    return F.regexp_extract(piece, rf"(?s)\A{ATTRS}>(.*)\z", 1)
