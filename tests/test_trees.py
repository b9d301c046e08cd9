"""Contexts, about texts and page records of generated pages against plain versions that know the tree."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import tree
from siteweave.operators import dom as D
from siteweave.operators import maps as M
from siteweave.operators.signals import page_signals
from siteweave.plans import summary as S
from siteweave.sources import sinks
from tests.test_operators import pages_of

BLOCKS = ["div", "section", "article", "main", "nav", "footer", "header", "aside", "li", "span", "b"]
CLASSES = ["content", "about-us", "menu", "entry-content", "company box", "x", "page-content", "our-story"]
IDS = ["content", "about", "mission", "top", "story-1"]
SENTENCES = ["We build stone bridges over quiet rivers", "Our company was founded near the lake", "Subscribe to our newsletter for more news today", "Short one",
             "All rights reserved by the owners of it", "People from the valley work with us here", "What do you need"]


class Node:
    def __init__(self, tag, attrs=(), children=()):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], None
        for c in children:
            if isinstance(c, Node):
                c.parent = self
            elif self.children and isinstance(self.children[-1], str):  # one text
                c = self.children.pop() + c
            self.children.append(c)

    def html(self):
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + "".join(c.html() if isinstance(c, Node) else c for c in self.children) + f"</{self.tag}>"

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def texts(self, without=()):
        if self.tag in without or self.tag in ("script", "style"):
            return []
        return [t for c in self.children for t in (c.texts(without) if isinstance(c, Node) else [c.strip()] if c.strip() else [])]

    def above(self):
        return [] if self.parent is None else [self.parent, *self.parent.above()]


def grown(rng, depth):
    children = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.45 or depth == 0:
            children.append(" " + rng.choice([". ", "! ", "? "]).join(rng.choices(SENTENCES, k=rng.choice([1, 2, 5]))) + ". ")
        elif kind < 0.6:
            children.append(Node("a", {"href": f"/p{rng.randint(0, 9)}"}, [rng.choice(["read", "more about it", ""])]))
        else:
            children.append(grown(rng, depth - 1))
    attrs = {}
    if rng.random() < 0.4:
        attrs["class"] = rng.choice(CLASSES)
    if rng.random() < 0.3:
        attrs["id"] = rng.choice(IDS)
    return Node(rng.choice(BLOCKS), attrs, children)


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(12)
    return [Node("html", (), [Node("body", (), [grown(rng, 4) for _ in range(rng.randint(1, 4))])]) for _ in range(120)]


def collapsed(text):
    return re.sub(r"\s+", " ", text)


def cleaned(raw):
    parts = [s.strip() for s in re.split(r"[.!?]+", collapsed(raw.strip()))]
    joined = ". ".join(s for s in parts if len(s) > 20 and not any(w in s.lower() for w in K.ABOUT_UNWANTED))
    return joined[:2000] + "..." if len(joined) > 2000 else joined


def test_contexts(spark, trees):
    parsed = D.parse(pages_of(spark, *[t.html() for t in trees]))
    got = {}
    for r in D.discovery_places(parsed).orderBy("page_id", "elem_seq").collect():
        got.setdefault(r.page_id, []).append((r.href, r.context))
    shown = {}
    for r in D.clickable_links(parsed).orderBy("page_id", "link_seq").collect():
        shown.setdefault(r.page_id, []).append((r.url.rsplit("/", 1)[1], r.context))
    for i, t in enumerate(trees):
        anchors = [n for n in t.walk() if n.tag == "a"]
        assert got.get(i, []) == [(a.attrs["href"], "".join(a.parent.texts()[:100])[:100]) for a in anchors]
        want = []
        for a in anchors:
            block = next((n for n in a.above() if n.tag in K.CONTEXT_TAGS), None)
            text = " ".join(block.texts()) if block else ""
            want.append((a.attrs["href"][1:], collapsed(text)[:500] + "..." if len(text) > 500 else text))
        assert shown.get(i, []) == want


def test_about_texts(spark, trees):
    parsed = D.parse(pages_of(spark, *[t.html() for t in trees]))
    got = {r.page_id: r.about_text for r in D.about_texts(parsed).collect()}
    areas = 0
    for i, t in enumerate(trees):
        inside = [n for n in t.walk() if not any(x.tag in K.ABOUT_DROP_TAGS for x in [n, *n.above()])]
        found = []
        for tag, css, ident in K.CONTENT_SELECTORS:
            hit = next((n for n in inside if (n.tag == tag if tag else css in n.attrs.get("class", "").split() if css else n.attrs.get("id") == ident)), None)
            if hit is not None:
                found.append(" ".join(hit.texts(K.ABOUT_DROP_TAGS)))
        area = next((x for x in found if len(x) > 100), None)
        areas += area is not None
        body = next(n for n in t.walk() if n.tag == "body")
        want = cleaned(area) if area is not None else cleaned(" ".join(body.texts(K.ABOUT_DROP_TAGS)))[:2000]
        assert got[i] == (want or None), i
    assert 10 < areas < len(trees)


def test_about_sections(spark, trees):
    parsed = D.parse(pages_of(spark, *[t.html() for t in trees]))
    got = sorted((r.page_id, r.selector, r.elem_seq, r.section_text) for r in D.about_sections(parsed).collect())
    want = []
    for i, t in enumerate(trees):
        for k, n in enumerate(t.walk()):
            raw = " ".join(n.texts())
            for j, (tag, attribute, word) in enumerate(K.ABOUT_SECTION_SELECTORS):
                if n.tag == tag and word in n.attrs.get(attribute, "").lower() and len(raw) > 100 and cleaned(raw):
                    want.append((i, j, k, cleaned(raw)))
    assert got == sorted(want) and len({j for _, j, _, _ in got}) > 4


def test_page_records(spark):
    """All 13 fields of SNK2."""
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        title, description = rng.choice(["Plain title", "A &amp; B", None]), rng.choice(["What we do", None])
        metas = [("keywords", "a, b")] * rng.randint(0, 1) + ([("description", description)] if description else [])
        lds = rng.sample(['{"@type":"Organization","name":"X"}', "{broken", "[1, 2]"], k=rng.randint(0, 3))
        found = sorted(rng.sample([f"https://maps.google.com/?q={k}" for k in range(6)], k=rng.randint(0, 3)))
        path = rng.choice(["/contact", "/about-us", "/blog/x", "/shop", f"/p{i}"])
        body = rng.choice(["plain words only", "get in contact with us", "learn about us here"])
        html = "".join(["<html><head>", f"<title>{title}</title>" if title else "", *[f'<meta name="{n}" content="{c}">' for n, c in metas],
                        *[f'<script type="application/ld+json">{x}</script>' for x in lds], "</head><body><p>", body, "</p>",
                        *[f'<a href="{u}">m</a>' for u in found], "</body></html>"])
        url, status, load = f"https://s.com{path}", rng.choice([200, 301]), rng.choice([0.5, 1.25])
        rows.append((i, url, html, status, load))
        text = " ".join(([title.replace("&amp;", "&")] if title else []) + [body] + ["m"] * len(found))
        kind = next((name for name, words in K.PAGE_TYPES if any(w in url.lower() for w in words)), "general")
        want[i] = {
            "url": url, "title": title and title.replace("&amp;", "&"), "description": description, "status_code": status, "load_time": load,
            "word_count": len(text.split()), "page_type": kind, "is_contact_page": "contact" in url or "contact" in text.lower(),
            "is_about_page": any(w in url.lower() for w in K.ABOUT_URL_KEYWORDS) or any(w in text.lower() for w in K.ABOUT_TEXT_PHRASES),
            "depth": 2 if path == "/shop" else 0, "json_ld": [x for x in lds if x != "{broken"], "meta_tags": [{"name": n, "content": c} for n, c in metas],
            "google_maps_found": found}
    signals = page_signals(spark.createDataFrame(rows, "page_id bigint, url string, html string, status_code int, load_time double"))
    reached = spark.createDataFrame([("s.com", "https://s.com/shop", 2)], "site_id string, url string, depth int")
    records = sinks.page_records(signals, M.all_maps(signals), reached)
    got = {r.page_id: r.asDict(recursive=True) for r in records.collect()}
    for i, w in want.items():
        assert {k: got[i][k] for k in w} == w, i
    for r in sinks.page_json(records).collect():
        document = json.loads(r.document)
        assert {k: document.get(k) for k in want[r.page_id]} == want[r.page_id]


def test_master_document_holds_every_field(spark, sf):
    """SNK4 against the record itself."""
    from checks import page_checks as PC

    sites = S.site_summary(PC.crawl(spark, sf).where("page_id < 40"))
    rows = {r.site_id: r.asDict(recursive=True) for r in sites.collect()}
    documents = {r.site_id: json.loads(r.document) for r in sinks.master_json(sites).collect()}
    assert documents.keys() == rows.keys()
    for site, row in rows.items():
        assert documents[site] == {k: v for k, v in row.items() if v is not None}


PIECES = ["<", ">", "</", "&", "&amp;", "&#65;", "&#x41;", "&copy ", "&copy-", "&nope;", "&#", "&#150;", "&#99999999;", "a", "< ", "<p>", "</p >", "</ p>", "</>",
          '<a href="x&amp;y" HREF=z>', "<a href=/z/>", "<A HREF='q' b>", "</a>", "<img/>", "<img src=a/ alt>", '<p a="1"b="2">', "<p a= 'x'>", "<!-- c -->", "<!--", "-- >",
          "<!doctype html>", "<!x>", "<?pi>", "<script>", "</script>", "</SCRIPT >", "<script/>", '<style a="b">', "</style>", "<title>", "</title>", "<div/>", "</div>",
          "<br />", "<template>", "</template>", "<svg:x y=1>", "\n", "\xa0", "\x0b", "\x00", "é"]


def library_columns(html):
    nodes, texts = tree._tree_of(html)
    return (*[[n[name] for n in nodes] for name in ("tag", "attrs", "parent", "anc", "stop", "t0", "t1", "raw")], texts)


def test_plain_pages_are_read_like_the_library_reads_them():
    rng = random.Random(7)
    plain = 0
    for _ in range(20000):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        found = tree._plain_columns(html)
        plain += found is not None
        assert found in (None, library_columns(html)), html
        assert tree._columns_of(html) == library_columns(html), html
    assert plain > 2000


def test_plain_pages_do_not_need_the_library(monkeypatch):
    """One pattern reads an ordinary page; the general parser takes only what that leaves over."""
    page = ('<!DOCTYPE html><html><head><title>A &amp; B</title><script>if (a < b) {}</script></head><body class="x">1 < 2 & 3<br>'
            '<a href="/q?a=1&amp;b=2">go</a><img src=x.png /><!-- no --></body></html>')
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["u", "v"], "html": [page, None]})
    want = library_columns(page)
    monkeypatch.setattr(tree, "_tree_of", None)
    rows = next(tree.parse_batches(iter([batch]))).to_pylist()
    assert [n["tag"] for n in rows[0]["nodes"]] == want[0]
    assert [dict(n["attrs"]) for n in rows[0]["nodes"]] == want[1]
    assert [n["anc"] for n in rows[0]["nodes"]] == want[3]
    assert rows[0]["texts"] == want[8] and rows[1]["nodes"] == [] and rows[1]["texts"] == []
