"""PG1: the DOM as a table, and the operators that need element nesting.

One pass of the standard library's ``html.parser`` per Arrow batch turns each
page into two arrays: ``nodes`` in document order and ``texts``, the visible
non-blank text nodes.  A node knows its ancestors and the half-open ranges of
nodes (``seq .. stop``) and texts (``t0 .. t1``) below it, so "inside a
footer" or "text of this element" is an array slice in the JVM, and no
operator here shuffles.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import text as T
from siteweave.functions import tree
from siteweave.functions import urls as U
from siteweave.functions.rows import computed, unnest_structs

cloudpickle.register_pickle_by_value(tree)

DOM_SCHEMA = (
    "page_id bigint, url string, "
    "nodes array<struct<seq:int,tag:string,attrs:map<string,string>,parent:int,anc:array<int>,"
    "stop:int,t0:int,t1:int,raw:string>>, texts array<string>"
)
def parse(pages: DataFrame) -> DataFrame:
    """PG1: ``pages(page_id, url, html)`` to one row of ``nodes`` and ``texts`` per page."""
    return pages.select("page_id", "url", "html").mapInArrow(tree.parse_batches, DOM_SCHEMA)


# --- helpers on the arrays ------------------------------------------------------------

def _nodes() -> Column:
    return F.col("nodes")


def _page_texts() -> Column:
    return F.col("texts")


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _css(node: Column) -> Column:
    """Class attribute with single blanks."""
    return T.collapse(T.strip(F.coalesce(_attr(node, "class"), F.lit(""))))


def _id(node: Column) -> Column:
    return F.coalesce(_attr(node, "id"), F.lit(""))


def _has_class(node: Column, *names: str) -> Column:
    """One of the names is a class of the node."""
    return F.coalesce(_attr(node, "class").rlike(rf"(?:^|\s)(?:{'|'.join(names)})(?:\s|$)"), F.lit(False))


def _node(seq: Column) -> Column:
    return F.try_element_at(_nodes(), seq + 1)


def _texts_of(node: Column, limit: int | None = None) -> Column:
    size = node["t1"] - node["t0"]
    return F.slice(_page_texts(), node["t0"] + 1, F.least(size, F.lit(limit)) if limit else size)


def _text(node: Column, sep: str = " ", limit: int | None = None) -> Column:
    return F.array_join(_texts_of(node, limit), sep)


def _first(nodes: Column) -> Column:
    return F.try_element_at(nodes, F.lit(1))


def _below(node: Column) -> Column:
    """Descendants of a node, in document order."""
    return F.slice(_nodes(), node["seq"] + 2, node["stop"] - node["seq"] - 1)


def elements(dom: DataFrame) -> DataFrame:
    """PG1 as rows: one element each, text of the element and its chain of ancestors."""
    def ancestor(seq: Column) -> Column:
        n = _node(seq)
        return F.struct(n["tag"].alias("tag"), _id(n).alias("id"), _css(n).alias("cls"))

    rows = F.transform(
        _nodes(),
        lambda n: F.struct(
            n["seq"].alias("elem_seq"), n["tag"].alias("tag"), n["attrs"].alias("attrs"),
            n["parent"].alias("parent"),
            F.transform(n["anc"], ancestor).alias("ancestors"),
        ),
    )
    return unnest_structs(dom, ["page_id", "url"], rows)


# --- links with their place on the page --------------------------------------------------

def _near(node: Column, words: list[str], tag: str | None = None) -> Column:
    """Any of the five nearest ancestors has one of the words in its class or id (or is ``tag``)."""
    def hit(seq: Column) -> Column:
        n = _node(seq)
        found = F.lower(F.concat_ws("\x01", _attr(n, "class"), _attr(n, "id"))).rlike("|".join(words))
        return found | (n["tag"] == tag) if tag else found

    return F.coalesce(F.exists(F.slice(node["anc"], 1, 5), hit), F.lit(False))


def discovery_places(dom: DataFrame) -> DataFrame:
    """LK7 and LK9 (discovery flavour): one row per anchor with an href."""
    anchors = F.filter(_nodes(), lambda n: (n["tag"] == "a") & _attr(n, "href").isNotNull())
    rows = F.transform(
        anchors,
        lambda n: F.struct(
            n["seq"].alias("elem_seq"),
            _attr(n, "href").alias("href"),
            _text(n, "").alias("anchor_text"),
            _near(n, K.NAV_INDICATORS).alias("is_navigation"),
            _near(n, K.FOOTER_INDICATORS, "footer").alias("is_footer"),
            F.substring(
                F.when(n["parent"].isNull(), F.array_join(F.slice(_page_texts(), 1, 100), ""))
                .otherwise(_text(_node(n["parent"]), "", 100)), 1, 100).alias("context"),
        ),
    )
    return unnest_structs(dom, ["page_id", "url"], rows)


def clickable_links(dom: DataFrame) -> DataFrame:
    """LK2, LK5, LK6, LK8, LK9 (clickable flavour).

    Menu classes are matched against the joined class string (Q4).
    """
    base = F.col("url")

    def place(n: Column) -> Column:
        menu_parent = F.exists(n["anc"], lambda s: (_node(s)["tag"] == "nav") | F.lower(_id(_node(s))).rlike("nav|menu"))
        footer_parent = F.exists(n["anc"], lambda s: _node(s)["tag"] == "footer")
        block = F.try_element_at(
            F.filter(n["anc"], lambda s: _node(s)["tag"].isin(K.CONTEXT_TAGS)), F.lit(1))
        context = T.let(_text(_node(block), " ", 501), lambda raw: F.when(
            F.length(raw) > 500, F.concat(F.substring(T.collapse(raw), 1, 500), F.lit("..."))).otherwise(raw))
        css = _css(n)
        return F.struct(
            n["seq"].alias("elem_seq"),
            T.strip(_attr(n, "href")).alias("href"),
            _text(n).alias("anchor_text"),
            css.alias("css_classes"),
            menu_parent.alias("menu_parent"),
            (footer_parent & ~menu_parent).alias("footer_parent"),
            F.coalesce(context, F.lit("")).alias("context"),
        )

    anchors = F.filter(_nodes(), lambda n: (n["tag"] == "a") & _attr(n, "href").isNotNull())
    rows = unnest_structs(dom, ["page_id", base], F.transform(anchors, place))
    href = F.col("href")
    kept = rows.where((href != "") & ~href.startswith("javascript:") & ~href.startswith("mailto:")
                      & ~href.startswith("tel:"))
    kept = kept.withColumn("target", U.resolve(base, href)).where(F.col("target").rlike("(?i)^https?:"))
    return classify_clickable(kept.withColumn("target", U.without_fragment(F.col("target"))))


def classify_clickable(rows: DataFrame) -> DataFrame:
    """LK5, LK6, LK8 on (url, target, anchor_text, css_classes, menu_parent, footer_parent, context)."""
    base, target = F.col("url"), F.col("target")
    css = F.lower(F.col("css_classes"))
    menu = F.when(F.col("menu_parent"), "header").when(F.col("footer_parent"), "footer").otherwise("body")
    nav, foot = F.col("menu_parent"), F.col("footer_parent")
    for name, pattern in K.MENU_CLASS_PATTERNS:
        hit = css.rlike(pattern)
        menu = F.when(hit, F.lit(name)).otherwise(menu)
        if name in ("header", "dropdown", "subdropdown"):
            nav = nav | hit
        elif name == "footer":
            foot = foot | hit
    home = (target == base) | (target == F.concat(F.rtrim(base, F.lit("/")), F.lit("/")))
    lowered, anchor = F.lower(target), F.lower(F.col("anchor_text"))
    contact = T.contains_any(lowered, K.CLICKABLE_CONTACT_KEYWORDS) | T.contains_any(anchor, K.CLICKABLE_CONTACT_KEYWORDS)
    about = T.contains_any(lowered, K.CLICKABLE_ABOUT_KEYWORDS) | T.contains_any(anchor, K.CLICKABLE_ABOUT_KEYWORDS)
    maps = T.contains_any(lowered, K.MAP_HOSTS)
    kind = (
        F.when(U.site_of(target) == U.site_of(base), "internal")
        .when(U.site_of(target).isin(K.CLICKABLE_SOCIAL), "social")
        .when(maps, "maps").when(contact, "contact").otherwise("external")
    )
    return rows.select(
        "page_id", F.col("elem_seq").alias("link_seq"), target.alias("url"), "anchor_text",
        kind.alias("link_type"), base.alias("source_page"), F.lit(0).alias("depth"),
        nav.alias("is_navigation"), foot.alias("is_footer"), contact.alias("is_contact"),
        about.alias("is_about"), maps.alias("is_google_maps"), "context",
        F.when(home & (menu == "body"), "homepage").otherwise(menu).alias("menu_type"), "css_classes",
    )


# --- logo ---------------------------------------------------------------------------------

def logos(dom: DataFrame) -> DataFrame:
    """PG16: first valid logo by selector order, then document order; null when none."""
    base = F.col("url")

    def under(n: Column, test) -> Column:
        return F.coalesce(F.exists(n["anc"], lambda s: test(_node(s))), F.lit(False))

    def first_child_of_header(n: Column) -> Column:
        # first element child of its parent, somewhere inside a header
        return (n["parent"] == n["seq"] - 1) & under(n, lambda a: a["tag"] == "header")

    def lowered(n: Column, name: str) -> Column:
        return F.lower(F.coalesce(_attr(n, name), F.lit("")))

    selectors = [
        lambda n: lowered(n, "class").contains("logo"),
        lambda n: lowered(n, "id").contains("logo"),
        lambda n: lowered(n, "alt").contains("logo"),
        lambda n: under(n, lambda a: _has_class(a, "logo")),
        lambda n: under(n, lambda a: _attr(a, "id") == "logo"),
        first_child_of_header,
        lambda n: under(n, lambda a: _has_class(a, "navbar-brand")),
        lambda n: under(n, lambda a: _has_class(a, "header-logo")),
        lambda n: under(n, lambda a: _has_class(a, "site-logo")),
        lambda n: under(n, lambda a: _attr(a, "class").contains("brand")),
    ]

    def rank(n: Column) -> Column:
        return F.coalesce(*[F.when(test(n), F.lit(i)) for i, test in enumerate(selectors)])

    def source(n: Column) -> Column:
        return F.coalesce(*[T.blank_to_null(_attr(n, a)) for a in ("src", "data-src", "data-lazy-src")])

    found = F.transform(
        F.filter(_nodes(), lambda n: n["tag"] == "img"),
        lambda n: F.struct(rank(n).alias("rank"), n["seq"].alias("seq"), source(n).alias("src")),
    )
    rows = dom.select("page_id", base, F.inline_outer(F.filter(found, lambda f: f["rank"].isNotNull() & f["src"].isNotNull())))
    from siteweave.operators.pages import _linked, is_logo_url

    logo = _linked(base, F.col("src"))
    valid = rows.select("page_id", F.when(is_logo_url(logo), F.struct("rank", "seq", logo.alias("logo_url"))).alias("best"))
    return valid.groupBy("page_id").agg(F.min("best")["logo_url"].alias("logo_url"))


# --- products in markup ------------------------------------------------------------------------

def _price(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^\d.]", "").try_cast("double")


def _microdata() -> Column:
    """BZ6: array of items of type Product with their name, price and currency."""
    def prop(item: Column, name: str, tag: str | None = None) -> Column:
        def test(n: Column) -> Column:
            named = _attr(n, "itemprop") == name
            return named & (n["tag"] == tag) if tag else named
        return _first(F.filter(_below(item), test))

    def value(n: Column) -> Column:
        return F.coalesce(T.blank_to_null(_attr(n, "content")), _text(n, ""))

    items = F.filter(_nodes(), lambda n: F.coalesce(_attr(n, "itemtype") == K.MICRODATA_PRODUCT, F.lit(False)))
    return F.transform(items, lambda i: F.struct(
        F.lit("microdata").alias("src"),
        T.blank_to_null(_text(prop(i, "name"), "")).alias("name"),
        _price(value(prop(i, "price"))).alias("price"),
        value(prop(i, "priceCurrency")).alias("currency"),
        _attr(prop(i, "url", "a"), "href").alias("href"),
    ))


def _cards() -> Column:
    """BZ7: array of product cards found by class."""
    def with_class(names: list[str], tags: list[str] | None = None):
        return lambda n: (n["tag"].isin(tags) | _has_class(n, *names)) if tags else _has_class(n, *names)

    def card(c: Column) -> Column:
        name = _first(F.filter(_below(c), with_class(K.CARD_TITLE_CLASSES, K.CARD_TITLE_TAGS)))
        price = _text(_first(F.filter(_below(c), with_class(K.CARD_PRICE_CLASSES))), "")
        link = _first(F.filter(_below(c), lambda n: (n["tag"] == "a") & _attr(n, "href").isNotNull()))
        return F.struct(
            F.lit("card").alias("src"),
            T.blank_to_null(_text(name, "")).alias("name"), _price(price).alias("price"),
            T.first_group(price, f"({K.CURRENCY_SYMBOLS})").alias("currency"), _attr(link, "href").alias("href"),
        )

    return F.transform(F.filter(_nodes(), with_class(K.CARD_CLASSES)), card)


def products(dom: DataFrame) -> DataFrame:
    """BZ6, BZ7 in one pass: (page_id, page_url, src, name, price, currency, url)."""
    base = F.col("page_url")
    found = unnest_structs(dom, ["page_id", F.col("url").alias("page_url")], F.concat(_microdata(), _cards()))
    named = found.where(F.col("name").isNotNull() & F.col("price").isNotNull())
    return named.select("page_id", "page_url", "src", "name", "price", "currency", U.resolve(base, F.coalesce("href", base)).alias("url"))


# --- about text -------------------------------------------------------------------------------------

def clean_about(raw: Column) -> Column:
    """MD6: sentences over 20 characters without navigation phrases, 2000 characters."""
    sentences = F.transform(F.split(T.collapse(T.strip(raw)), "[.!?]+", -1), T.strip)
    good = F.filter(sentences, lambda s: (F.length(s) > 20) & ~T.contains_any(F.lower(s), K.ABOUT_UNWANTED))
    return T.let(F.array_join(good, ". "), lambda joined: F.when(
        F.length(joined) > 2000, F.concat(F.substring(joined, 1, 2000), F.lit("..."))).otherwise(joined))


def about_texts(dom: DataFrame) -> DataFrame:
    """MD3: text of the first main content area over 100 characters, else of the body."""
    dropped = F.filter(_nodes(), lambda n: n["tag"].isin(K.ABOUT_DROP_TAGS))
    slim = dom.select("page_id", "url", "nodes", "texts", dropped.alias("dropped"))
    outside = F.filter(_nodes(), lambda n: ~F.exists(F.col("dropped"), lambda d: (d["seq"] <= n["seq"]) & (n["seq"] < d["stop"])))
    slim = slim.select("page_id", "url", "texts", "dropped", outside.alias("nodes"))

    def kept_text(n: Column) -> Column:
        inside = F.transform(_texts_of(n), lambda t, i: F.when(
            F.exists(F.col("dropped"), lambda d: (d["t0"] <= n["t0"] + i) & (n["t0"] + i < d["t1"])), None).otherwise(t))
        return F.array_join(inside, " ")

    def area(tag: str | None, css: str | None, ident: str | None) -> Column:
        return _first(F.filter(_nodes(), lambda n: (n["tag"] == tag) if tag else _has_class(n, css) if css else (_attr(n, "id") == ident)))

    areas = F.transform(F.array(*[area(*s) for s in K.CONTENT_SELECTORS]), kept_text)
    body = kept_text(_first(F.filter(_nodes(), lambda n: n["tag"] == "body")))
    picked = slim.select("page_id", "url", _first(F.filter(areas, lambda t: F.length(t) > 100)).alias("area"), body.alias("body"))
    cleaned = picked.select("page_id", "url", F.col("area").isNotNull().alias("from_area"), clean_about(F.coalesce("area", "body")).alias("t"))
    chosen = F.when(F.col("from_area"), F.col("t")).otherwise(F.substring("t", 1, 2000))
    return cleaned.select("page_id", "url", T.blank_to_null(chosen).alias("about_text"))


def about_sections(dom: DataFrame) -> DataFrame:
    """MD4: cleaned text of about-like sections, one row per (selector, element)."""
    def hits(i: int, tag: str, attribute: str, word: str) -> Column:
        found = F.filter(_nodes(), lambda n: (n["tag"] == tag)
                         & F.lower(F.coalesce(_attr(n, attribute), F.lit(""))).contains(word))
        return F.transform(found, lambda n: F.struct(F.lit(i).alias("selector"), n["seq"].alias("elem_seq"), _text(n).alias("raw")))

    every = F.concat(*[hits(i, *s) for i, s in enumerate(K.ABOUT_SECTION_SELECTORS)])
    rows = unnest_structs(dom, ["page_id", "url"], every).where(F.length("raw") > 100)
    return computed(rows, ["page_id", "url", "selector", "elem_seq"], section_text=clean_about(F.col("raw"))).where("section_text <> ''")
