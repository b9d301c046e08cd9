"""Operators on small hand-written pages, with brute force where there is no SQL."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from siteweave.operators import business as B
from siteweave.operators import contact as C
from siteweave.operators import dom as D
from siteweave.operators import graph as G
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators import metadata as MD
from siteweave.operators import pages as P
from siteweave.operators import products as PR
from siteweave.operators.signals import page_signals
from siteweave.operators.topk import top_k
from siteweave.plans import summary as S


def pages_of(spark, *htmls, base="https://www.site.com/p"):
    rows = [(i, f"{base}{i}", h, 200, 0.5) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, status_code int, load_time double")


def test_navigation_five_up_but_not_six(spark):
    near = '<div id="Main-Menu"><i><i><i><i><a href="/n">n</a></i></i></i></i></div>'
    far = '<div id="Main-Menu"><i><i><i><i><i><a href="/f">f</a></i></i></i></i></i></div>'
    foot = '<footer><a href="/x">x</a></footer><div class="bottom-bar"><a href="/y">y</a></div>'
    rows = {r.href: r for r in D.discovery_places(D.parse(pages_of(spark, near + far + foot))).collect()}
    assert rows["/n"].is_navigation and not rows["/f"].is_navigation
    assert rows["/x"].is_footer and rows["/y"].is_footer and not rows["/n"].is_footer


@pytest.mark.parametrize("css,menu,nav,foot", [
    ("btn top-menu", "header", True, False), ("bottom_menu", "footer", False, True), ("has-children", "dropdown", True, False),
    ("grandchild", "subdropdown", True, False), ("mobile-menu", "mobile", False, False), ("quick_links", "quicklinks", False, False),
    ("plain", "body", False, False),
])
def test_menu_classes(spark, css, menu, nav, foot):
    row = D.clickable_links(D.parse(pages_of(spark, f'<p><a class="{css}" href="/q">q</a></p>'))).first()
    assert (row.menu_type, row.is_navigation, row.is_footer) == (menu, nav, foot)


def test_clickable_links_keep_http_only_and_strip_fragments(spark):
    html = '<nav><a href="/a#x">A</a></nav><a href="mailto:a@b.c">m</a><a href="ftp://h/x">f</a><a href=" ">e</a><a href="#top">t</a><a href="https://t.me/x">s</a>'
    rows = D.clickable_links(D.parse(pages_of(spark, html))).orderBy("link_seq").collect()
    assert [(r.url, r.link_type, r.menu_type) for r in rows] == [
        ("https://www.site.com/a", "internal", "header"), ("https://www.site.com/p0", "internal", "homepage"), ("https://t.me/x", "social", "body")]


def test_long_context_is_cut_short_context_is_kept(spark):
    html = f'<div>{"word  " * 200}<a href="/x">x</a></div><p>a   b<a href="/y">y</a></p>'
    rows = {r.url[-1]: r.context for r in D.clickable_links(D.parse(pages_of(spark, html))).collect()}
    assert rows["x"] == " ".join(["word"] * 200)[:500] + "..." and rows["y"] == "a   b y"


def test_unclosed_and_stray_tags(spark):
    dom = D.parse(pages_of(spark, "<div><p>a<p>b</div></span>c<br>d<img src=x>e"))
    assert dom.first().texts == ["a", "b", "c", "d", "e"]
    nodes = dom.first().nodes
    assert [(n.tag, n.stop) for n in nodes] == [("div", 3), ("p", 3), ("p", 3), ("br", 4), ("img", 5)]


def test_logo_selectors_and_rejects(spark):
    html = ['<img class="Big-Logo" src="/a.png">', '<div id="logo"><img src="//c.com/b.svg"></div>', '<header><img data-src="c.jpg"></header>',
            '<div class="brandbox"><b><img src="d.webp"></b></div>', '<img class="logo" src="/placeholder.png"><img alt="logo" src="/e.gif">', '<img src="/f.png">',
            '<header><b>x</b><img src="/g.png"></header>']
    got = {r.page_id: r.logo_url for r in D.logos(D.parse(pages_of(spark, *html))).collect()}
    s = "https://www.site.com/"
    assert got == {0: s + "a.png", 1: "https://c.com/b.svg", 2: s + "c.jpg", 3: s + "d.webp", 4: s + "e.gif", 5: None, 6: None}


def test_products_from_markup(spark):
    html = ('<div itemtype="http://schema.org/Product"><b itemprop="name">A</b><i itemprop="price">1,299.00</i></div>'
            '<div class="x product-card y"><h2>B</h2><span class="product-price">€ 5.50</span></div>'
            '<div class="product-item"><h3>C</h3><i class="product-price">10.00-20.00</i><a href="c">c</a></div>')
    rows = {r.name: (r.price, r.currency, r.url) for r in PR.markup_products(pages_of(spark, html)).collect()}
    assert rows == {"A": (1299.0, None, "https://www.site.com/p0"), "B": (5.5, "€", "https://www.site.com/p0")}


def test_json_ld_valid_invalid_and_arrays(spark):
    html = ('<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Organization","name":"No"}]</script>'
            '<!-- <script type="application/ld+json">{"@type":"Organization","name":"Hidden"}</script> -->'
            '<script type="application/ld+json">{"@type":"Organization","name":" Yes "}</script>')
    assert [r.ld_brand for r in C.ld_brand(page_signals(pages_of(spark, html))).collect()] == ["Yes"]


def test_brand_rules(spark):
    cases = {"Acme - Best Serum": "Acme", "Cream Shop | Acme": "Acme", "Alpha Beta": "Alpha Beta", "Acme Inc. rocks": "Acme Inc. rocks", "Acme Group rocks": "Acme", "A :: B": "A", "Red — Blue": "Red"}
    df = spark.createDataFrame([(t,) for t in cases], "title string")
    assert {r.title: r.b for r in df.select("title", C.brand_from_title(F.col("title")).alias("b")).collect()} == cases


def test_phrase_spanning_two_pages_is_not_one_phrase(spark):
    sig = page_signals(pages_of(spark, "<p>a team of</p>", "<p>40 dogs</p>"))
    assert B.size_facts(sig, 2026).first().employees is None


def test_founded_year_tests_only_the_first_match_of_each_pattern(spark):
    sig = page_signals(pages_of(spark, "<p>founded in 1500, founded in 1999. since 1988</p>"))
    assert B.size_facts(sig, 2026).first().founded_year == "1988"
    assert B.size_facts(sig, 1980).first().founded_year is None


def test_running_map_lists_follow_from_first_page(spark):
    sig = page_signals(pages_of(spark, '<a href="https://maps.google.com/1">m</a>', "<p>contact</p>", '<iframe src="https://google.com/maps/2"></iframe><a href="https://maps.google.com/1">m</a>'))
    found = M.all_maps(sig)
    first = {r.map_url: r.first_page for r in M.page_maps(found).collect()}
    assert first == {"https://maps.google.com/1": 0, "https://google.com/maps/2": 2}
    assert M.contact_page_maps(found, P.page_kinds(sig)).count() == 0


def test_about_text_prefers_main_area_and_drops_boilerplate(spark):
    body = "We build very good things for people since long ago. " * 4
    pages = pages_of(spark, f"<body><nav>Navigation words that are long enough</nav><main><p>{body}</p><footer>Footer inside main that is long enough</footer></main></body>",
                     "<body><header>skip me please, header text</header><p>Only a body text that is long enough here.</p></body>", "<p>no body at all here</p>")
    got = {r.page_id: r.about_text for r in D.about_texts(D.parse(pages)).collect()}
    assert got[0] == ". ".join(["We build very good things for people since long ago"] * 4)
    assert got[1] == "Only a body text that is long enough here" and got[2] is None


def test_about_sections_by_id_and_class(spark):
    text = "This company has a story that is worth telling to everybody who listens to it. " * 2
    html = f'<section id="Our-Story">{text}</section><div class="about box">{text}</div><p class="about">{text}</p><div id="about">short</div>'
    rows = D.about_sections(D.parse(pages_of(spark, html))).collect()
    assert sorted(r.selector for r in rows) == [1, 4]
    assert MD.about_fallback(D.about_sections(D.parse(pages_of(spark, html))).withColumn("site_id", F.lit("s"))).first().about_text.count("This company") == 2


def test_regex_links_equal_tree_links(spark, sf):
    from checks import page_checks as PC

    pages = PC.crawl(spark, sf)
    tree = D.discovery_places(D.parse(pages)).select("page_id", "href", "anchor_text")
    from siteweave.operators.signals import anchor_rows
    from siteweave.functions import html as H

    flat = anchor_rows(page_signals(pages)).select("page_id", "href", H.compact_text_of(H.piece_inner(F.col("piece"))).alias("anchor_text"))
    assert tree.exceptAll(flat).count() == 0 and flat.exceptAll(tree).count() == 0


# --- graph against a queue --------------------------------------------------------------------

def queue_crawl(start, edges, cap, max_depth):
    """The queue the operator must agree with: opened one page at a time, capped between pages."""
    known, order, opened, queue = {start: 0}, [start], set(), deque([start])
    while queue and len(known) < cap:
        page = queue.popleft()
        opened.add(page)
        for target in edges.get(page, []):
            if target not in known and known[page] < max_depth:
                known[target] = known[page] + 1
                order.append(target)
                queue.append(target)
    return known, order, opened


@pytest.mark.parametrize("seed,cap,depth", [(1, 10**6, 45), (2, 15, 45), (3, 40, 3), (4, 1, 45), (5, 7, 2)])
def test_reach_equals_queue(spark, seed, cap, depth):
    rnd = random.Random(seed)
    rows, graphs = [], {}
    for site in ("a", "b"):
        graph = {f"u{i}": [f"u{rnd.randrange(60)}" for _ in range(rnd.randrange(5))] for i in range(60)}
        graphs[site] = graph
        rows += [(site, s, t, i) for s, ts in graph.items() for i, t in enumerate(ts)]
    starts = spark.createDataFrame([("a", "u0"), ("b", "u7")], "site_id string, url string")
    edges = spark.createDataFrame(rows, "site_id string, source string, url string, link_seq bigint")
    got = G.reach(starts, edges, cap, depth).collect()
    for site, start in (("a", "u0"), ("b", "u7")):
        known, order, opened = queue_crawl(start, graphs[site], cap, depth)
        mine = [r for r in got if r.site_id == site]
        assert {r.url: r.depth for r in mine} == known
        assert [r.url for r in sorted(mine, key=lambda r: r.position)] == order
        assert {r.url for r in mine if r.processed} == opened


# --- properties -----------------------------------------------------------------------------------

def test_top_k_equals_sorted_prefix_on_a_hot_group(spark):
    rnd = random.Random(0)
    data = [("hot" if i % 3 else f"g{i % 7}", rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, i bigint")
    got = top_k(df, ["g"], [F.col("v"), F.col("i")], 5).collect()
    for g in {d[0] for d in data}:
        want = sorted((v, i) for x, v, i in data if x == g)[:5]
        assert [(r.v, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.rn)] == want


def test_positions_match_row_numbers(spark):
    rows = [(i * 37 % 20000, f"https://{'hot' if i % 3 else 'x' + str(i % 5)}.com/{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("site_id", F.regexp_extract("url", "//([^/]*)", 1))
    got = {r.page_id: r.position for r in P.site_positions(df, ranges=9).collect()}
    sites = {}
    for pid, url in sorted(rows):
        sites.setdefault(url.split("/")[2], []).append(pid)
    assert got == {pid: i for ids in sites.values() for i, pid in enumerate(ids)}


def test_price_extremes_are_sorted_and_small(spark):
    rows = [("s", f"n{i}", float(i % 9), "USD", f"u{i}") for i in range(30)] + [("t", "only", 1.0, "USD", "u")]
    df = spark.createDataFrame(rows, "site_id string, name string, price double, currency string, url string")
    cols = {r.site_id: r for r in PR.product_columns(PR.price_extremes(df)).collect()}
    ranked = sorted(((p, n, u) for s, n, p, c, u in rows if s == "s"))
    assert [(p.price, p.name, p.url) for p in cols["s"].min_products] == ranked[:4]
    assert [(p.price, p.name, p.url) for p in cols["s"].max_products] == ranked[-4:]
    assert len(cols["t"].min_products) == len(cols["t"].max_products) == 1


def test_page_budget_keeps_main_page_first(spark):
    pages = pages_of(spark, *["<p>x</p>"] * 6)
    seeds = spark.createDataFrame([("site.com", "https://www.site.com/p4")], "site_id string, main_url string")
    kept = S.capped_pages(pages, 3, seeds)
    assert sorted(r.page_id for r in kept.collect()) == [0, 1, 4]
    assert S.capped_pages(pages, 100, seeds).count() == 6


def test_scores_stay_in_range(spark, sf):
    from checks import site_checks as SC

    low, high = SC.scores(spark, sf).selectExpr("min(least(firmographic_score, engagement_score, ig_score))", "max(greatest(firmographic_score, engagement_score, ig_score))").first()
    assert 0 <= low and high <= 100


def test_first_links_are_unique(spark, sf):
    from checks import page_checks as PC

    rows = L.first_links(PC.links(spark, sf))
    assert rows.count() == rows.select("site_id", "section", "url").distinct().count()
