"""Costly values are made once per row, tables are read once, and tasks do not grow with a table."""

import random
import re

from pyspark.sql import functions as F

from checks import load, tables
from siteweave import constants as K
from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.operators import business as B
from siteweave.operators import contact as C
from siteweave.operators import dom as D
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators.facts import first_hit
from siteweave.operators.signals import page_signals
from siteweave.plans import documents as DOC
from siteweave.plans import summary as S
from siteweave.session import Kept, materialise

HTML = ('<a href="https://maps.google.com/x">m</a><a href="/y/../z">z</a><a>none</a><a href="#top">t</a><a href="/f.pdf">f</a>'
        '<iframe src="https://www.google.com/maps/embed?1"></iframe><script type="application/ld+json">{"@type":"Store","hasMap":"https://goo.gl/maps/1"}</script>')


def signals(spark):
    rows = [(i, f"https://a.com/{i}", HTML) for i in range(3)] + [(9, None, None)]
    return materialise(page_signals(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "signals")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def times(df, part: str) -> int:
    return len(re.findall(re.escape(part), plan(df)))


def test_filters_do_not_make_links_again(spark):
    """Removing signs from a reference is a step that each resolved URL takes once."""
    sig, step = signals(spark), r"[\t\r\n]"
    assert times(L.page_links(sig), step) == 1
    assert times(M.all_maps(sig), step) == 1
    assert sorted((r.page_id, r.link_seq, r.url) for r in L.page_links(sig).collect()) == sorted(
        x for i in range(3) for x in [(i, 0, "https://maps.google.com/x"), (i, 1, "https://a.com/z")])
    found = {(r.method, r.map_url) for r in M.all_maps(sig).collect()}
    assert found == {("direct", "https://maps.google.com/x"), ("iframe", "https://www.google.com/maps/embed?1"), ("javascript", "https://goo.gl/maps/1"),
                     ("structured", "https://goo.gl/maps/1")}


def test_page_maps_read_the_links_once(spark, tmp_path):
    found = spark.createDataFrame([(1, "s", "u"), (1, "s", "u"), (3, "s", "u"), (3, "s", "v"), (4, "t", "u")], "page_id bigint, site_id string, map_url string")
    found.write.parquet(str(tmp_path / "found"))
    got = M.page_maps(spark.read.parquet(str(tmp_path / "found")))
    assert str(tmp_path / "found") not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("site_id", "page_id", "map_url", "hits", "first_page").collect())) == [
        ("s", 1, "u", 2, 1), ("s", 3, "u", 1, 1), ("s", 3, "v", 1, 3), ("t", 4, "u", 1, 4)]


def test_addresses_are_those_of_a_plain_search(spark):
    """A text without the end of an address is told by one short pattern."""
    rng = random.Random(5)
    pieces = ["12", "77", "12345", "90210", "123456", "90210-1234", "Main Street", "CA", "Kent", "a", ",", ", ", " ", " ", ".", "\n", "Ab12345", "١٢٣٤٥"]
    rows = [(i, "s" + str(i), "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    rows += [(5000, "x", None), (5001, "y", "5 Main Street, Springfield, CA 90210"), (5002, "y", "77 High Road, Northtown Kent 40210")]
    texts = spark.createDataFrame(rows, "page_id bigint, site_id string, text string")

    def plain(pattern):
        return T.strip(F.try_element_at(F.filter(T.all_groups(F.col("text"), "(?U)" + pattern), lambda a: a.contains(",")), F.lit(1)))

    want = [tuple(r) for r in texts.select("page_id", F.coalesce(*[plain(p) for p in K.ADDRESS_PATTERNS]).alias("v")).orderBy("page_id").collect()]
    got = [tuple(r) for r in texts.select("page_id", C.address_hit(F.col("text"))["v"].alias("v")).orderBy("page_id").collect()]
    assert got == want and sum(v is not None for _, v in want) > 20
    # once to see whether it matches, once for what it matches; not again for the filter
    assert times(C.addresses(materialise(texts, "texts")), K.ADDRESS_PATTERNS[1][10:40]) == 2


def test_large_tables_have_more_tasks(spark, sf, monkeypatch):
    few = tables.table(spark, sf, "pages").rdd.getNumPartitions()
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 10)
    many = tables.table(spark, sf, "pages")
    assert few == spark.sparkContext.defaultParallelism < many.rdd.getNumPartitions()
    assert many.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_contact_page_maps_read_the_pages_once(spark, sf):
    got = load()["mp6_contact_page_maps"][0](spark, sf)
    assert "pages.parquet" not in got._jdf.queryExecution().executedPlan().toString()


def test_page_records_read_the_pages_once(spark, sf):
    got = load()["snk2_page_records"][0](spark, sf)
    assert "pages.parquet" not in got._jdf.queryExecution().executedPlan().toString()


def test_sections_are_cleaned_once(spark):
    text = "We are a small house with a long and proud tradition of honest work, and we serve the whole city well. " * 2
    pages = spark.createDataFrame([(1, "https://a.com/", f'<section id="about"><p>{text}</p></section>')], "page_id bigint, url string, html string")
    got = D.about_sections(D.parse(pages))
    assert times(got, "[.!?]+") == 1 and got.count() > 0


def test_patterns_are_tried_only_where_they_can_hit(spark):
    """Ends of texts, keyword groups and numbers are told without searching the whole text again."""
    df = spark.createDataFrame([(1, "s", "text", 0.5, False, ["<a>"])], "page_id bigint, site_id string, text string, load_time double, video_marker boolean, anchors array<string>")
    made = plan(S.text_state(df))
    assert "arrays_overlap" not in made and "trim(" in made
    assert "regexp_replace" not in plan(df.select(T.strip(F.col("text"))))


def test_strip_takes_every_white_space(spark):
    signs = [chr(i) for i in range(0x3100)] + ["\U0001f600", "﻿"]
    rows = [(i, a + "x" + a + "é" + a * 3) for i, a in enumerate(signs)] + [(-1, ""), (-2, " \t\xa0　"), (-3, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", T.strip(F.col("t")).alias("new"), F.regexp_replace("t", rf"\A{K.WS}+|{K.WS}+\z", "").alias("old"))
    assert [r.t for r in df.collect() if r.new != r.old] == []


def test_employees_are_those_of_a_plain_search(spark):
    rng = random.Random(11)
    pieces = ["12", "7", "50-90", " ", " ", "employees", "EMPLOYEE", "team of", "ſtaff of", "STAFF  of", "people", "memberſ", "\n", "-", "x", "$5 million"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 8))) for _ in range(2000)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "t", B.employees_hit(F.col("t")).alias("new"), first_hit(F.col("t"), K.EMPLOYEE_PATTERNS, B._employees).alias("old"))
    rows = df.collect()
    assert [r for r in rows if r.new != r.old] == [] and sum(r.new is not None for r in rows) > 200


def test_maps_of_odd_references_are_found(spark):
    """A host may be split by a line break, come from the page's own URL, or be written in capitals."""
    hrefs = ["https://MAPS.google.com/x", "https://goo\n.gl/maps/1", "//www.goo\tgle.com/maps", "/maps/here", "../maps", "a/./../maps?q", "https://goo.gl/x/../maps", "#m", "?q=goo.gl/maps", ""]
    html = "".join(f'<a href="{h}">x</a><iframe src="{h}"></iframe>' for h in hrefs)
    pages = spark.createDataFrame([(1, "https://www.google.com/a/b", html), (2, "https://other.com/a/b", html)], "page_id bigint, url string, html string")
    sig = materialise(page_signals(pages), "signals")
    parts = M.direct(sig).unionByName(M.iframes(sig)).unionByName(M.scripts(sig)).unionByName(M.structured(sig))
    found = sorted(map(tuple, M.all_maps(sig).collect()))
    assert found == sorted(map(tuple, parts.collect())) and len(found) > 10


def test_stored_pages_are_read_in_parts_of_bounded_rows(spark):
    """Pages that compress well lie in several files, so that no task reads most of a table (F4 to F7)."""
    stored = {}

    class Noted(Kept):
        def keep(self, name, build):
            stored[name] = super().keep(name, build)
            return stored[name]

    pages = spark.range(2500).coalesce(1).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://big.com/"), "id").alias("url"), F.lit(HTML).alias("html"),
        F.lit(200).alias("status_code"), F.lit(0.5).alias("load_time"))
    row = S.site_summary(pages, stages=Noted()).first()
    assert (row.pages_analysed, row.total_maps_found) == (2500, 3)
    assert len(stored["signals"].inputFiles()) >= 3


def test_tables_of_short_rows_are_dealt_out_by_rows(spark, tmp_path):
    """A short row makes a whole page too."""
    spark.range(50_000).select(F.lit(1).alias("c")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    dealt = tables.table(spark, str(tmp_path), "customer")
    assert dealt.rdd.getNumPartitions() == 5 > spark.sparkContext.defaultParallelism
    assert dealt.count() == 50_000


def test_text_steps_equal_their_plain_patterns(spark):
    """White space, separators, tags, phones and addresses are told by cheaper looks first, with the same results."""
    rng = random.Random(11)
    bits = ["a", "Zé", " ", "  ", "\t", "\n", " ", " ", "\u0085", "\x1c", "\x01", "<b>", "</b >", '<a href="x>y">', "<i a='>' b>", "<u x=>", "<p", "<", ">", "=", '"', "<!d>",
            "<br/>", "212-555-0100", "mobile: ", "support: 303 555 0177", "911", "٣٤٥٦٧", "12 Main Road, Lyon, CA 90210", ", ", "2125550100"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(18))) for _ in range(600)] + ["", None]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "site_id string, page_id bigint, text string")
    t, gap = F.col("text"), rf"{K.WS}*+{H.SEP}(?:{H.SEP}|{K.WS})*+"
    tag = rf"(?:<[a-zA-Z/!?]{H.ATTRS}>|<[a-zA-Z/!?][^>]*+>)"
    raw = H.decode_entities(F.regexp_replace(t, tag, H.SEP))
    pairs = [(T.collapse(t), F.regexp_replace(t, K.WS + "+", " ")), (F.regexp_replace(t, H.TAG, H.SEP), F.regexp_replace(t, tag, H.SEP)),
             (H.text_of(t), T.strip(F.regexp_replace(raw, gap, " "))), (H.compact_text_of(t), T.strip(F.regexp_replace(raw, gap, "")))]
    got = rows.select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert [(i, texts[n]) for n, r in enumerate(got) for i, v in enumerate(r) if v.a != v.b] == []
    plain = rows.select("page_id", *[C.phones_in(t, k).alias(k) for k in C.PHONE_KINDS]).collect()
    want = {(r.page_id, k, p) for r in plain for k in C.PHONE_KINDS for p in r[k] or []}
    assert {(r.page_id, r.kind, r.phone) for r in C.phone_rows(rows).collect()} == want and len({k for _, k, _ in want}) > 2


def test_sitemap_report_reads_stored_signals(spark, tmp_path, monkeypatch):
    """The given tables are read for the signals and for the trees; map links and videos are made from the signals, once."""
    customers = [(k, f"Customer {k}", 1, 1.0, "BUILDING") for k in (1, 3, 292)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "https://a.com/0", HTML)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    given, summary = {}, S.site_summary
    monkeypatch.setattr(S, "site_summary", lambda pages, **named: given.update(named) or summary(pages, **named))
    rows = {r.site_id: r.content for r in load()["ss6_sitemap_report"][0](spark, str(tmp_path)).collect()}
    for name in ("signals", "found", "videos"):
        assert not [f for f in given[name].inputFiles() if str(tmp_path) in f], name
    assert set(rows) == {"a.com", "shop0.example.com", "shop1.example.com"}
    assert "\n  1. https://goo.gl/maps/1\n  2. https://maps.google.com/x\n" in rows["a.com"]


def test_documents_are_put_together_in_runs(spark):
    """No task sorts every item of a long document; order and gaps are those of a plain join."""
    rng = random.Random(4)
    rows = [(folder, f"{folder}.txt", site, slot, rank, rng.choice([None, "", f"{folder}{site}/{slot}/{rank};"]))
            for folder, site in (("a", "s"), ("a", None), ("b", "t")) for slot in range(4) for rank in range(1 if slot % 2 == 0 else rng.randint(0, 25))]
    want = {}
    for r in sorted(rows, key=lambda r: (r[2] or "", r[3], r[4])):
        want[r[0]] = want.get(r[0], "") + (r[5] or "")
    rng.shuffle(rows)
    pieces = spark.createDataFrame(rows, "folder string, file_name string, site_id string, slot int, rank bigint, text string")
    for block in (1, 7, DOC.BLOCK):
        assert {r.folder: r.content for r in DOC.whole(pieces, block).collect()} == want


def test_ends_are_those_of_a_plain_search(spark):
    urls = [u + e for u in ("", "x", "https://a.com/f") for e in ("", ".pdf", ".PDF", ".pdfx", ".jpeg", "jpeg", ".gz", "z", ".mp4\n", ".\u212apg", "\u0130.gif")] + [None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("u", F.lower("u"))
    got = rows.select("u", T.ends_with_any(F.col("u"), K.EXCLUDED_EXTENSIONS).alias("hit")).collect()
    assert [r.hit for r in got] == [None if r.u is None else r.u.endswith(tuple(K.EXCLUDED_EXTENSIONS)) for r in got]
