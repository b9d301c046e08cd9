"""Text, HTML and URL column functions against hand-made cases and the standard library."""

from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteweave.functions import html as H
from siteweave.functions import text as T
from siteweave.functions.keywords import Keywords
from siteweave.functions import urls as U


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first().r


def many(spark, rows, schema, column):
    data = [(i, *r) for i, r in enumerate(rows)]
    out = spark.createDataFrame(data, "i int, " + schema).select("i", column.alias("r")).orderBy("i").collect()
    return [x.r for x in out]


def test_strip_and_word_count(spark):
    cases = ["  a b ", " x\n\ny\t", "", "   ", "one two  three", "\x1cq\x85"]
    assert many(spark, [(c,) for c in cases], "t string", T.strip(F.col("t"))) == [c.strip() for c in cases]
    assert many(spark, [(c,) for c in cases], "t string", T.word_count(F.col("t"))) == [len(c.split()) for c in cases]


def test_entities_are_decoded_once(spark):
    got = one(spark, H.decode_entities(F.col("t")), t="a&amp;lt;b &copy; &#169;&#xA9; &#150; &nope; &amp &#0; x & y")
    assert got == "a&lt;b © ©© – &nope & \N{REPLACEMENT CHARACTER} x & y"
    assert one(spark, H.decode_entities(F.col("t"), strict=True), t="?a=1&copy=2&amp;b&zzz;") == "?a=1&copy=2&b&zzz;"


def test_visible_text_ignores_hidden_parts(spark):
    page = "<title> A </title><script>var x='</p>';</script><!-- <p>no</p> --><style>p{}</style><p title='a>b'>one<b> two</b>\n&nbsp;</p>1 < 2<template>t</template>"
    assert one(spark, H.text_of(H.visible_html(F.col("h"))), h=page) == "A one two 1 < 2"


def test_attribute_is_not_found_inside_other_values(spark):
    cases = [
        (' title="see href=x" href="/y"', "/y"), (" HREF = '/q?a=1&amp;b=2'", "/q?a=1&b=2"), (" href=plain class=c", "plain"),
        (' data-href="no"', None), (' href=""', ""), (" x='it' href=\"a'b\"", "a'b"), (' alt="a>b" href="/z"', "/z"),
    ]
    got = many(spark, [(c[0],) for c in cases], "a string", H.attr(F.col("a"), "href"))
    assert got == [c[1] for c in cases]


def test_title_needs_text(spark):
    for page, want in [("<title>  X\n y </title>", "X\n y"), ("<title></title>", None), ("<p>", None), ("<title lang=en>A &amp; B</title>", "A & B")]:
        assert one(spark, H.title(H.visible_html(F.col("h"))), h=page) == want


def test_anchor_pieces_and_unclosed_anchor(spark):
    rows = many(spark, [("<a href=1>one<b>!</b></a><abbr>x</abbr><A HREF='2'>two<a href=3>three</a>",)], "h string", H.anchor_pieces(H.visible_html(F.col("h"))))
    assert rows[0] == [" href=1>one<b>!</b>", " HREF='2'>two", " href=3>three"]


SEGMENT = st.sampled_from(["a", "b", "..", ".", "", "c.html", "x y"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(SEGMENT, max_size=4), st.booleans(), st.sampled_from(["", "?q=1", "#f", "?a=../b#c"])), min_size=8, max_size=8))
def test_resolve_equals_urljoin(spark, refs):
    bases = ["http://h.example.com", "https://h.example.com/a/b/c?x=1#y", "http://h.example.com:80/d/"]
    pairs = [(b, ("/" if rooted else "") + "/".join(parts) + tail) for b in bases for parts, rooted, tail in refs]
    # "//" at the start names a host; an empty one is left out here
    pairs = [(b, r) for b, r in pairs if not r.startswith("//")]
    got = many(spark, pairs, "b string, r string", U.resolve(F.col("b"), F.col("r")))
    # urljoin drops an empty query or fragment; none occurs here
    assert got == [urljoin(b, r) if urlparse(b).path or urlparse(r).path else _hostless(b, r) for b, r in pairs]


def _hostless(base, ref):
    return urljoin(base, ref)


def test_resolve_special_forms(spark):
    base = "https://h.example.com/a/b"
    for ref, want in [("//c.org/x", "https://c.org/x"), ("mailto:a@b.c", "mailto:a@b.c"), ("https:rel", "https://h.example.com/a/rel"),
                      ("http://o/../x", "http://o/../x"), ("  /t\n/u", "https://h.example.com/t/u"), ("", base)]:
        assert one(spark, U.resolve(F.col("b"), F.col("r")), b=base, r=ref) == urljoin(base, ref.strip() if ref.startswith(" ") else ref) == want


def test_site_drops_www_anywhere(spark):
    assert one(spark, U.site_of(F.col("u")), u="http://a.www.b.com:80/x") == "a.b.com:80"


def test_keyword_mask_counts_distinct_words(spark):
    df = spark.createDataFrame([("s", "shop shopping"), ("s", "store shop"), ("t", "none")], "site string, t string")
    words = ["shop", "shopping", "store"]
    got = df.select("site", Keywords(words).found("t").alias("f")).select("site", Keywords(words).mask("f", words).alias("m")).groupBy("site").agg(F.bit_count(F.bit_or("m")).alias("n")).collect()
    assert {r.site: r.n for r in got} == {"s": 3, "t": 0}
