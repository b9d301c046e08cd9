"""Queries for sources, pages, links and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as O
from checks import tables as TB
from checks.registry import check
from siteweave import constants as K
from siteweave.constants import WS
from siteweave.functions import urls as U
from siteweave.operators import dom as D
from siteweave.operators import graph as G
from siteweave.operators import links as L
from siteweave.operators import metadata as MD
from siteweave.operators import pages as P
from siteweave.operators.dedup import content_hash, unique_pages
from siteweave.operators.signals import ld_rows, page_signals
from siteweave.session import materialise
from siteweave.sources import readers, sinks


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    return TB.crawl(spark, sf)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return page_signals(crawl(spark, sf))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_links(signals(spark, sf))


def big(df: DataFrame, *names: str) -> DataFrame:
    """Counts and sizes as bigint, the type the reference SQL returns."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


# --- sources -----------------------------------------------------------------------

@check("src1_seeds", f"SELECT DISTINCT {O.site('url')} AS site_id, url AS main_url FROM pages WHERE url IS NOT NULL")
def src1(spark, sf):
    return readers.seeds(TB.table(spark, sf, "pages"))


FETCH_SQL = O.WITH + """
SELECT page_id,
  CASE WHEN status_code = 200 AND length(html) > 1000 THEN 'accept' WHEN status_code IN (403,404,500,503) THEN 'reject' ELSE 'retry' END AS verdict,
  regexp_matches(lower(html), '520: web server is returning an unknown error|just a moment...|not found|access denied|service unavailable|cloudflare|captcha|security check|page not found|404 error') AS has_error,
  regexp_matches(lower(html), 'captcha|security check') AS has_effective_error,
  CASE WHEN contains(html, '520: Web server is returning an unknown error') THEN '520 Unknown Server Error' WHEN contains(html, 'Just a moment...') THEN 'Cloudflare Challenge'
    WHEN contains(html, 'Access Denied') THEN 'Access Denied' WHEN contains(html, 'Service Unavailable') THEN 'Service Unavailable'
    WHEN contains(html, 'Cloudflare') THEN 'Cloudflare Protection' WHEN regexp_matches(lower(html), 'captcha|security check') THEN 'CAPTCHA Challenge'
    WHEN contains(html, 'Not Found') OR contains(html, '404 Error') THEN '404 Not Found' ELSE 'UNKNOWN' END AS error_class,
  status_code IN (429,500,502,503,504) OR regexp_matches(lower(html), '520: web server is returning an unknown error|just a moment...|not found|access denied|service unavailable|cloudflare|captcha|security check|page not found|404 error') AS retryable,
  CASE WHEN status_code = 200 THEN '✅ Good (200 OK)' WHEN status_code IN (301,302) THEN '↗️ Redirect (' || status_code || ')' ELSE '⚠️ Warning (' || status_code || ')' END AS status_label
FROM base"""


@check("src2_pg12_pg13_pg14_pg20_fetch_labels", FETCH_SQL)
def fetch_labels(spark, sf):
    return P.fetch_labels(crawl(spark, sf))


@check("src2_accepted_pages", O.WITH + "SELECT page_id, url FROM base WHERE status_code = 200 AND length(html) > 1000")
def accepted(spark, sf):
    return P.accepted(crawl(spark, sf)).select("page_id", "url")


@check("src3_page_scan", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_length FROM pages")
def src3(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("html_length"))


REPORT_FILES = """
SELECT '/data/site' || CAST(s_suppkey % 40 AS STRING) || '/' || CASE s_suppkey % 3 WHEN 0 THEN 'z' || CAST(s_suppkey AS STRING) || '_comprehensive_summary.txt'
  WHEN 1 THEN 'a' || CAST(s_suppkey AS STRING) || '_summary.txt' ELSE 'b' || CAST(s_suppkey AS STRING) || '.txt' END AS path, s_name AS content FROM supplier
"""


@check("src4_report_pick", f"""
SELECT folder, path, content FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY rank, path) AS rn FROM (
  SELECT path, content, split_part(path, '/', 3) AS folder, CASE WHEN path LIKE '%_comprehensive_summary.txt' THEN 0 ELSE 1 END AS rank
  FROM ({REPORT_FILES}) f WHERE path LIKE '%\\_summary.txt' ESCAPE '\\') a) b WHERE rn = 1""")
def src4(spark, sf):
    return readers.pick_reports(TB.derived(spark, sf, REPORT_FILES, "supplier"))


# --- page projections -----------------------------------------------------------------

@check("pg1_elements", O.WITH + r""", tags AS (SELECT page_id, lower(unnest(regexp_extract_all(
  regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\b[^>]*>|<style\b[^>]*>).*?(</script>|</style>)', '\1\2', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM base)
SELECT page_id, tag, count(*) AS elements FROM tags GROUP BY 1, 2""")
def pg1(spark, sf):
    return D.elements(D.parse(crawl(spark, sf))).groupBy("page_id", "tag").agg(F.count("*").alias("elements"))


@check("pg1_visible_text_of_tree", O.WITH + "SELECT page_id, text FROM texts")
def pg1_text(spark, sf):
    return D.parse(crawl(spark, sf)).select("page_id", F.array_join("texts", " ").alias("text"))


@check("pg2_pg3_text_and_words", O.WITH + r"""SELECT page_id, text, CAST(len(regexp_extract_all(text, '[^' || '""" + WS[1:] + r"""+')) AS BIGINT) AS word_count FROM texts""")
def pg2(spark, sf):
    return P.page_texts(signals(spark, sf))


HEAD_SQL = O.WITH + rf""", heads AS (SELECT page_id, url,
  nullif({O.strip(O.entities("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title,
  regexp_extract(markup, '<meta name="description" content="([^"]*)"', 1) AS d, regexp_extract(markup, '(?i)<meta name="description" content="([^"]*)"', 1) AS di,
  regexp_extract(markup, '(?i)<meta name="keywords" content="([^"]*)"', 1) AS kw,
  regexp_extract(markup, '<link rel="icon" href="([^"]*)"', 1) AS i1, regexp_extract(markup, '<link rel="shortcut icon" href="([^"]*)"', 1) AS i2,
  regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://[^?#]*/') AS folder FROM base),
icons AS (SELECT *, CASE WHEN i1 <> '' THEN i1 WHEN i2 <> '' THEN i2 ELSE '/favicon.ico' END AS icon FROM heads)
SELECT page_id, title, substr({O.collapse('title')}, 1, 200) AS site_title, nullif({O.entities('d')}, '') AS description,
  nullif(substr({O.collapse(O.strip(O.entities('di')))}, 1, 500), '') AS meta_description, nullif(substr({O.collapse(O.strip(O.entities('kw')))}, 1, 300), '') AS meta_keywords,
  CASE WHEN starts_with(icon, '//') THEN 'https:' || icon WHEN starts_with(icon, 'http') THEN icon WHEN starts_with(icon, '/') THEN root || icon ELSE folder || icon END AS favicon_url
FROM icons"""


@check("pg4_pg5_pg6_pg15_heads", HEAD_SQL)
def heads(spark, sf):
    return P.page_heads(signals(spark, sf))


@check("pg7_meta_tags", O.WITH + r"""SELECT page_id, CAST(len(regexp_extract_all(markup, '<meta ')) AS BIGINT) AS metas,
  regexp_extract(markup, '<meta charset="([^"]*)"', 1) AS charset FROM base""")
def pg7(spark, sf):
    metas = signals(spark, sf).select("page_id", P.meta_maps(F.col("metas")).alias("meta_tags"))
    return metas.select("page_id", F.size("meta_tags").cast("bigint").alias("metas"),
                        F.array_max(F.transform("meta_tags", lambda m: F.try_element_at(m, F.lit("charset")))).alias("charset"))


@check("pg8_json_ld", O.LD + """SELECT page_id, json_extract_string(body, '$."@type"') AS kind, json_extract_string(body, '$.name') AS name, count(*) AS docs
FROM ld GROUP BY 1, 2, 3""")
def pg8(spark, sf):
    rows = ld_rows(signals(spark, sf))
    return rows.groupBy("page_id", F.try_variant_get("doc", '$["@type"]', "string").alias("kind"),
                        F.try_variant_get("doc", "$.name", "string").alias("name")).agg(F.count("*").alias("docs"))


KIND_SQL = O.WITH + f"""
SELECT page_id, CASE WHEN {O.any_of('lower(url)', ['about', 'story', 'company'])} THEN 'about' WHEN {O.any_of('lower(url)', ['contact', 'reach', 'touch'])} THEN 'contact'
  WHEN {O.any_of('lower(url)', ['product', 'service', 'solution'])} THEN 'product' WHEN {O.any_of('lower(url)', ['blog', 'news', 'article'])} THEN 'blog'
  WHEN {O.any_of('lower(url)', ['team', 'staff', 'people'])} THEN 'team' ELSE 'general' END AS page_type,
  contains(lower(url), 'contact') OR contains(lower(text), 'contact') AS is_contact_page,
  {O.any_of('lower(url)', K.ABOUT_URL_KEYWORDS)} OR {O.any_of('lower(text)', K.ABOUT_TEXT_PHRASES)} AS is_about_page FROM texts"""


@check("pg9_pg10_pg11_page_kinds", KIND_SQL)
def kinds(spark, sf):
    return P.page_kinds(signals(spark, sf)).drop("site_id")


@check("pg16_logos", O.WITH + r"""SELECT page_id, CASE WHEN contains(html, 'site-logo') AND NOT contains(html, '/img/placeholder') THEN
  regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_extract(html, '<img class="site-logo" alt="x" src="([^"]*)"', 1) END AS logo_url FROM base""")
def pg16(spark, sf):
    return D.logos(D.parse(crawl(spark, sf)))


LOGO_NAMES = """SELECT s_suppkey, 'https://cdn.example.com/' || lower(s_name) || CASE s_suppkey % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '/logo.svg?x=1' WHEN 2 THEN '/Placeholder.png'
  WHEN 3 THEN '.bmp' WHEN 4 THEN '/test/a.jpg' ELSE '.webp' END AS logo FROM supplier"""


@check("pg17_logo_validity", f"""SELECT s_suppkey, regexp_matches(lower(logo), '\\.(png|jpg|jpeg|gif|svg|webp)') AND NOT regexp_matches(lower(logo), 'placeholder|default|sample|test') AS valid
FROM ({LOGO_NAMES}) x""")
def pg17(spark, sf):
    return TB.derived(spark, sf, LOGO_NAMES, "supplier").select("s_suppkey", P.is_logo_url(F.col("logo")).alias("valid"))


@check("pg18_images", O.WITH + r"""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS img_seq, regexp_extract(url, '^[a-z]+://[^/?#]*') || unnest(l) AS image_url
FROM (SELECT page_id, url, regexp_extract_all(markup, '<img [^>]*src="([^"]*)"', 1) AS l FROM base) x""")
def pg18(spark, sf):
    return P.images(signals(spark, sf))


@check("pg19_file_names", O.WITH + rf""", n AS (SELECT page_id, url, site_id, row_number() OVER (PARTITION BY site_id ORDER BY page_id) - 1 AS i,
  replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/', '_') AS p FROM base)
SELECT page_id, CASE WHEN p = '' OR p = site_id THEN site_id || '_page_' || printf('%03d', i) ELSE substr(site_id || '_' || p || '_' || printf('%03d', i), 1, 100) END AS file_name,
  translate(replace(replace(url, 'https://', ''), 'http://', ''), '/:?=&', '_____') AS safe_name FROM n""")
def pg19(spark, sf):
    return P.page_names(crawl(spark, sf))


# --- links --------------------------------------------------------------------------------

@check("lk1_lk4_lk6_lk10_discovered_links", O.WITH + """SELECT page_id, site_id, source_page, link_seq, url, anchor_text, link_type, is_contact, is_about, is_google_maps FROM links""")
def lk1(spark, sf):
    return links(spark, sf).select("page_id", "site_id", "source_page", "link_seq", "url", "anchor_text", "link_type", "is_contact", "is_about", "is_google_maps")


MENU = r"""(CASE WHEN regexp_matches(css, 'quick[-_]?links') THEN 'quicklinks' WHEN regexp_matches(css, 'mobile[-_]?menu') THEN 'mobile'
  WHEN regexp_matches(css, 'sub[-_]?dropdown|grandchild|sub-sub') THEN 'subdropdown' WHEN regexp_matches(css, 'drop[-_]?down|has[-_]?children|sub[-_]?menu|child[-_]?menu') THEN 'dropdown'
  WHEN nav THEN 'header' WHEN foot THEN 'footer' ELSE 'body' END)"""
CLICK_SQL = O.WITH + rf""", place AS (
  SELECT a.*, b.markup, lower({O.collapse("regexp_extract(piece, '(?is)^<a [^>]*?class=\"([^\"]*)\"', 1)")}) AS css,
    a.link_seq < len(regexp_extract_all(split_part(b.markup, '</nav>', 1), '<a ')) AS nav,
    a.link_seq >= len(regexp_extract_all(split_part(b.markup, '<footer', 1), '<a ')) AS foot,
    {O.text_of("regexp_replace(piece, '(?is)^<a[^>]*>|</a>$', '', 'g')")} AS words, {O.strip('href')} AS h
  FROM anchors a JOIN base b USING (page_id)),
t AS (SELECT *, split_part({O.resolve('source_page', 'h')}, '#', 1) AS target FROM place
  WHERE h <> '' AND NOT starts_with(h, 'javascript:') AND NOT starts_with(h, 'mailto:') AND NOT starts_with(h, 'tel:')),
s AS (SELECT *, replace(regexp_extract(target, '^https?://([^/?#]*)', 1), 'www.', '') AS host,
  regexp_matches(lower(target), 'google\.com/maps|goo\.gl/maps|maps\.google\.com|maps\.app\.goo\.gl') AS is_google_maps,
  regexp_matches(lower(target), 'contact|call|reach|email|phone|tel|mail') OR regexp_matches(lower(words), 'contact|call|reach|email|phone|tel|mail') AS is_contact,
  regexp_matches(lower(target), 'about|who we are|our story|our team') OR regexp_matches(lower(words), 'about|who we are|our story|our team') AS is_about
  FROM t WHERE regexp_matches(target, '^https?:'))
SELECT page_id, target AS url, words AS anchor_text, source_page, css AS css_classes, is_google_maps, is_contact, is_about,
  CASE WHEN host = site_id THEN 'internal' WHEN host IN ('facebook.com','twitter.com','instagram.com','linkedin.com','youtube.com','pinterest.com','tumblr.com','reddit.com','snapchat.com','whatsapp.com','t.me','weibo.com','vk.com') THEN 'social'
    WHEN is_google_maps THEN 'maps' WHEN is_contact THEN 'contact' ELSE 'external' END AS link_type,
  CASE WHEN {MENU} = 'body' AND (target = source_page OR target = rtrim(source_page, '/') || '/') THEN 'homepage' ELSE {MENU} END AS menu_type,
  nav OR regexp_matches(css, 'drop[-_]?down|has[-_]?children|sub[-_]?menu|child[-_]?menu') AS is_navigation, foot AS is_footer
FROM s"""


@check("lk2_lk5_lk6_lk8_clickable_links", CLICK_SQL)
def lk2(spark, sf):
    return D.clickable_links(D.parse(crawl(spark, sf))).drop("link_seq", "depth", "context")


HREFS = """SELECT p_partkey, 'http://h.example.com/a/b/c' || CAST(p_partkey AS STRING) || '?x=1#y' AS b, CAST(p_partkey AS STRING) AS k FROM part"""
# reference in -> expected out, by part key; {k} is the key
RESOLVE_CASES = [
    ("../p{k}", "http://h.example.com/a/p{k}"), ("./p{k}", "http://h.example.com/a/b/p{k}"), ("x/../p{k}", "http://h.example.com/a/b/p{k}"),
    ("//cdn.example.com/{k}", "http://cdn.example.com/{k}"), ("?q={k}", "http://h.example.com/a/b/c{k}?q={k}"), ("#f{k}", "http://h.example.com/a/b/c{k}?x=1#f{k}"),
    ("/r/../s/./{k}", "http://h.example.com/s/{k}"), ("../../../z{k}", "http://h.example.com/z{k}"), ("d//e{k}/..", "http://h.example.com/a/b/d/"),
    ("http:rel{k}", "http://h.example.com/a/b/rel{k}"), ("mailto:m{k}@example.com", "mailto:m{k}@example.com"), ("/q//w{k}?a=../b", "http://h.example.com/q//w{k}?a=../b"),
    ("https://o.example.com/../{k}", "https://o.example.com/../{k}"), (".", "http://h.example.com/a/b/"), ("..", "http://h.example.com/a/"), ("", "http://h.example.com/a/b/c{k}?x=1#y"),
]


def _case(i: int) -> str:
    arms = " ".join(f"WHEN {n} THEN '" + c[i].replace("{k}", "' || k || '") + "'" for n, c in enumerate(RESOLVE_CASES))
    return f"CASE p_partkey % {len(RESOLVE_CASES)} {arms} END"


@check("lk3_resolve", f"SELECT p_partkey, {_case(0)} AS href, {_case(1)} AS resolved FROM ({HREFS}) x")
def lk3(spark, sf):
    rows = TB.derived(spark, sf, f"SELECT p_partkey, b, {_case(0)} AS href FROM ({HREFS}) x", "part")
    return rows.select("p_partkey", "href", U.resolve(F.col("b"), F.col("href")).alias("resolved"))


@check("lk4_exact_social_variant", O.WITH + r"""SELECT page_id, link_seq, regexp_matches(host, '(^|\.)(facebook|instagram|twitter|x|linkedin|youtube|tiktok|pinterest)\.com$') AS exact_social FROM links WHERE link_type = 'social'""")
def exact_social(spark, sf):
    return links(spark, sf).where("link_type = 'social'").select("page_id", "link_seq", L.exact_social(F.col("url")).alias("exact_social"))


@check("lk7_link_places", O.WITH + rf""", place AS (SELECT a.page_id, a.anchor_text, a.href, contains(b.markup, 'site-header')
    AND a.link_seq < len(regexp_extract_all(split_part(b.markup, '</nav>', 1), '<a ')) AS is_navigation,
    contains(b.markup, '<footer') AND a.link_seq >= len(regexp_extract_all(split_part(b.markup, '<footer', 1), '<a ')) AS is_footer
  FROM anchors a JOIN base b USING (page_id))
SELECT * FROM place""")
def lk7(spark, sf):
    return D.discovery_places(D.parse(crawl(spark, sf))).select("page_id", "anchor_text", "href", "is_navigation", "is_footer")


@check("lk9_link_context")
def lk9(spark, sf):
    trees = D.parse(crawl(spark, sf))
    return D.discovery_places(trees).select("page_id", "href", "context").unionByName(
        D.clickable_links(trees).select("page_id", F.col("url").alias("href"), "context"))


@check("lk11_site_of_url", O.WITH + "SELECT page_id, site_id FROM base")
def lk11(spark, sf):
    return crawl(spark, sf).select("page_id", U.site_of(F.col("url")).alias("site_id"))


SECTIONS_SQL = """(SELECT site_id, link_type AS section, url, page_id, link_seq, source_page, anchor_text, is_contact, is_about FROM links WHERE link_type IN ('internal','external','social')
  UNION ALL SELECT site_id, 'contact', url, page_id, link_seq, source_page, anchor_text, is_contact, is_about FROM links WHERE is_contact)"""


@check("lk12_first_links", O.WITH + f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site_id, section, url ORDER BY page_id, link_seq) AS rn FROM {SECTIONS_SQL} s) x WHERE rn = 1""")
def lk12(spark, sf):
    return L.first_links(links(spark, sf))


@check("lk13_link_counts", O.WITH + """SELECT site_id, count(*) FILTER (link_type = 'internal') AS internal_links, count(*) FILTER (link_type = 'external') AS external_links,
  count(*) FILTER (link_type = 'social') AS social_links, count(*) FILTER (link_type = 'maps') AS maps_links, count(*) FILTER (is_contact) AS contact_links, count(*) AS total_links FROM links GROUP BY 1""")
def lk13(spark, sf):
    return L.counts(links(spark, sf))


PLACED_SQL = """, placed AS (SELECT l.*, contains(b.markup, 'site-header') AND l.link_seq < len(regexp_extract_all(split_part(b.markup, '</nav>', 1), '<a ')) AS is_navigation,
    contains(b.markup, '<footer') AND l.link_seq >= len(regexp_extract_all(split_part(b.markup, '<footer', 1), '<a ')) AS is_footer
  FROM links l JOIN base b USING (page_id))"""


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return L.placed_links(D.parse(crawl(spark, sf)))


@check("lk1_lk7_placed_links", O.WITH + PLACED_SQL + """ SELECT page_id, site_id, source_page, url, anchor_text, link_type, is_contact, is_about, is_google_maps, is_navigation, is_footer FROM placed""")
def lk1_placed(spark, sf):
    return placed(spark, sf).drop("link_seq", "context")


@check("lk14_internal_buckets", O.WITH + PLACED_SQL + """, b AS (SELECT site_id, url, page_id, link_seq, CASE WHEN is_about THEN 'About Pages' WHEN is_contact THEN 'Contact Pages'
    WHEN is_navigation THEN 'Navigation Links' WHEN is_footer THEN 'Footer Links' ELSE 'General Pages' END AS bucket
  FROM placed WHERE link_type = 'internal'), r AS (SELECT *, row_number() OVER (PARTITION BY site_id, bucket ORDER BY page_id, link_seq) AS rn FROM b)
SELECT site_id, bucket, count(*) AS links, string_agg(url, ' ' ORDER BY rn) FILTER (rn <= 5) AS urls, greatest(count(*) - 5, 0) AS more FROM r GROUP BY 1, 2""")
def lk14(spark, sf):
    return L.internal_buckets(placed(spark, sf)).drop("first").withColumn("urls", F.array_join("urls", " "))


@check("lk15_external_domains", O.WITH + """, d AS (SELECT site_id, regexp_extract(url, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1) AS domain, count(*) AS links, min(page_id * 100000 + link_seq) AS seen
  FROM links WHERE link_type = 'external' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seen) AS rank FROM d)
SELECT site_id, domain, links, rank FROM r WHERE rank <= 10""")
def lk15(spark, sf):
    return L.external_domains(links(spark, sf))


@check("lk16_guarded_pages", O.WITH + """SELECT page_id, count(*) AS links FROM links WHERE page_id NOT IN (SELECT page_id FROM base WHERE
  regexp_matches(lower(html), '520: web server is returning an unknown error|just a moment...|not found|access denied|service unavailable|cloudflare|captcha|security check|404 error')) GROUP BY 1""")
def lk16(spark, sf):
    return L.page_links(page_signals(L.guarded(crawl(spark, sf)))).groupBy("page_id").agg(F.count("*").alias("links"))


GRAPH_SQL = O.WITH + """, edges AS (SELECT DISTINCT site_id, source_page AS source, url FROM links WHERE link_type = 'internal')"""


#: the depth at which the reference SQL of the walk stops; the walk itself needs no bound
SQL_DEPTH = 45


def reached(spark: SparkSession, sf: str, stored: DataFrame | None = None, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Depths and links; from ``stored`` signals, where a query has them.  Every page that links lead to, unless ``max_depth`` is stated."""
    pages = crawl(spark, sf) if stored is None else stored
    every = L.page_links(page_signals(pages) if stored is None else stored)
    starts = L.main_pages(pages).select("site_id", F.col("main_url").alias("url"))
    return G.reach(starts, G.site_edges(every), max_depth=max_depth), every


BFS_SQL = """, bfs(site_id, url, depth) AS (
  SELECT site_id, main_url, 0 FROM mains UNION
  SELECT e.site_id, e.url, b.depth + 1 FROM bfs b JOIN edges e ON e.site_id = b.site_id AND e.source = b.url WHERE b.depth < 45),
near AS (SELECT site_id, url, min(depth) AS depth FROM bfs GROUP BY 1, 2)"""


@check("lk17_reachability", GRAPH_SQL.replace("WITH crawl", "WITH RECURSIVE crawl", 1) + BFS_SQL + " SELECT site_id, url, CAST(depth AS BIGINT) AS depth FROM near")
def lk17(spark, sf):
    return big(reached(spark, sf, max_depth=SQL_DEPTH)[0].select("site_id", "url", "depth"), "depth")


@check("lk18_lk19_crawl_stats", GRAPH_SQL.replace("WITH crawl", "WITH RECURSIVE crawl", 1) + BFS_SQL + """, n AS (SELECT site_id, source_page AS url, count(*) AS links FROM links GROUP BY 1, 2)
SELECT site_id, count(*) AS total_pages, CAST(sum(coalesce(links, 0)) AS BIGINT) AS total_links, CAST(coalesce(max(depth) FILTER (links IS NOT NULL), 0) AS BIGINT) AS max_depth,
  CASE WHEN count(*) >= 50 THEN 'Complex' WHEN count(*) >= 20 THEN 'Moderate' WHEN count(*) >= 6 THEN 'Simple' ELSE 'Basic' END AS complexity
FROM near LEFT JOIN n USING (site_id, url) GROUP BY 1""")
def lk18(spark, sf):
    return G.crawl_stats(*reached(spark, sf, max_depth=SQL_DEPTH))


CAP = 25


@check("lk17_capped_walk", GRAPH_SQL.replace("WITH crawl", "WITH RECURSIVE crawl", 1) + f""", firsts AS (SELECT site_id, source_page AS source, url, min(link_seq) AS seq FROM links WHERE link_type = 'internal' GROUP BY 1, 2, 3),
adj AS (SELECT site_id, source, list(url ORDER BY seq, url) AS l FROM firsts GROUP BY 1, 2),
q(site_id, queue, depths, opened) AS (SELECT site_id, [main_url], [0], 0 FROM mains
  UNION ALL SELECT site_id, list_concat(queue, new), list_concat(depths, list_transform(new, lambda u: depths[opened + 1] + 1)), opened + 1
  FROM (SELECT q.*, list_filter(coalesce(l, []), lambda u: NOT list_contains(queue, u)) AS new FROM q LEFT JOIN adj ON adj.site_id = q.site_id AND adj.source = queue[opened + 1]
    WHERE opened < len(queue) AND len(queue) < {CAP}) x),
f AS (SELECT site_id, arg_max(queue, opened) AS queue, arg_max(depths, opened) AS depths, max(opened) AS opened FROM q GROUP BY 1)
SELECT site_id, queue[i] AS url, CAST(depths[i] AS BIGINT) AS depth, i AS position, i <= opened AS processed FROM (SELECT *, unnest(range(1, len(queue) + 1)) AS i FROM f) x""")
def lk17_capped(spark, sf):
    """A queue that stops opening pages once 25 URLs of the site are known; the pages that were not opened are known all the same."""
    pages = crawl(spark, sf)
    every = L.page_links(page_signals(pages))
    starts = L.main_pages(pages).select("site_id", F.col("main_url").alias("url"))
    return big(G.reach(starts, G.site_edges(every), max_urls=CAP), "depth")


TREE_SQL = """SELECT p_brand AS site_id, CAST(p_partkey AS STRING) AS source, CAST(p_partkey % 7 * 31 + p_size AS STRING) AS url, p_partkey AS link_seq FROM part"""


@check("lk17_part_graph", f"""WITH RECURSIVE edges AS ({TREE_SQL}), starts AS (SELECT DISTINCT site_id, '1' AS url FROM edges UNION SELECT DISTINCT site_id, '33' FROM edges WHERE 1 = 0),
e AS (SELECT DISTINCT site_id, CAST(CAST(source AS INT) % 60 AS STRING) AS source, CAST(CAST(url AS INT) % 60 AS STRING) AS url FROM edges),
bfs(site_id, url, depth) AS (SELECT site_id, url, 0 FROM starts UNION SELECT e.site_id, e.url, b.depth + 1 FROM bfs b JOIN e ON e.site_id = b.site_id AND e.source = b.url WHERE b.depth < 45)
SELECT site_id, url, CAST(min(depth) AS BIGINT) AS depth FROM bfs GROUP BY 1, 2""")
def lk17_parts(spark, sf):
    edges = TB.derived(spark, sf, TREE_SQL, "part")
    node = lambda c: (F.col(c).cast("int") % 60).cast("string").alias(c)
    starts = edges.select("site_id", F.lit("1").alias("url")).distinct()
    return big(G.reach(starts, edges.select("site_id", node("source"), node("url"), "link_seq"), max_depth=45).select("site_id", "url", "depth"), "depth")


@check("lk18_stored_structure", O.WITH + """, u AS (SELECT site_id, main_url AS url FROM mains UNION SELECT site_id, url FROM links WHERE link_type = 'internal'),
n AS (SELECT site_id, count(*) AS total_pages FROM u GROUP BY 1), t AS (SELECT site_id, count(*) AS total_links FROM links GROUP BY 1)
SELECT site_id, total_pages, coalesce(total_links, 0) AS total_links, CASE WHEN total_pages >= 50 THEN 'Complex' WHEN total_pages >= 20 THEN 'Moderate' WHEN total_pages >= 6 THEN 'Simple' ELSE 'Basic' END AS complexity
FROM n LEFT JOIN t USING (site_id)""")
def lk18_stored(spark, sf):
    pages = crawl(spark, sf)
    return L.site_structure(pages, L.page_links(page_signals(pages)))


@check("lk19_complexity", """SELECT c_nationkey, count(*) AS customers, CASE WHEN count(*) >= 50 THEN 'Complex' WHEN count(*) >= 20 THEN 'Moderate' WHEN count(*) >= 6 THEN 'Simple' ELSE 'Basic' END AS complexity
FROM customer GROUP BY 1""")
def lk19(spark, sf):
    n = TB.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.withColumn("complexity", L.complexity(F.col("customers")))


@check("lk20_pages_to_analyse", O.WITH + """, u AS (SELECT site_id, url, min(later) AS later FROM (SELECT site_id, main_url AS url, 0 AS later FROM mains
  UNION ALL SELECT site_id, url, 1 FROM links WHERE link_type = 'internal') x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY later, url) AS position FROM u) SELECT site_id, url, position FROM r WHERE position <= 1000""")
def lk20(spark, sf):
    pages = crawl(spark, sf)
    return L.pages_to_analyse(pages, L.page_links(page_signals(pages)))


@check("lk21_unprocessed", O.WITH + """, done AS (SELECT DISTINCT url FROM base WHERE status_code = 200)
SELECT min(page_id) AS page_id, url FROM base WHERE url NOT IN (SELECT url FROM done) GROUP BY url""")
def lk21(spark, sf):
    pages = crawl(spark, sf)
    return L.unprocessed(pages, pages.where("status_code = 200")).select("page_id", "url")


# --- documents: deduplication, titles ---------------------------------------------------------

@check("dd1_unique_pages", "SELECT min(doc_id) AS page_id, source AS url, CAST(length(text) AS BIGINT) AS n FROM documents GROUP BY source, lang, text")
def dd1(spark, sf):
    docs = TB.table(spark, sf, "documents").selectExpr("doc_id AS page_id", "source AS url", "lang AS title", "text AS content", "cast(null as array<map<string,string>>) AS meta")
    return unique_pages(content_hash(docs)).select("page_id", "url", F.length("content").cast("bigint").alias("n"))


@check("snk8_unique_page_json", "SELECT source AS file_name, count(DISTINCT lang || '|' || text) AS pages FROM documents GROUP BY 1")
def snk8(spark, sf):
    docs = TB.table(spark, sf, "documents").selectExpr("doc_id AS page_id", "'https://' || source AS url", "lang AS title", "text AS content", "cast(null as array<map<string,string>>) AS meta")
    return sinks.unique_page_json(docs).groupBy("file_name").agg(F.count_distinct("document").alias("pages"))


@check("snk8_unique_page_documents", """SELECT source AS file_name, text AS content, lang AS title, 'https://' || source AS url, count(*) AS documents
FROM (SELECT source, lang, text FROM documents GROUP BY ALL) x GROUP BY ALL""")
def snk8_documents(spark, sf):
    """Every document, read back field by field."""
    docs = TB.table(spark, sf, "documents").selectExpr("doc_id AS page_id", "'https://' || source AS url", "lang AS title", "text AS content", "cast(null as array<map<string,string>>) AS meta")
    back = sinks.unique_page_json(docs).select("file_name", F.from_json("document", "content string, title string, url string").alias("d"))
    return back.groupBy("file_name", "d.content", "d.title", "d.url").agg(F.count("*").alias("documents"))


@check("md1_page_titles", O.WITH + f"""SELECT site_id, page_id, t AS title FROM (SELECT site_id, page_id, {O.strip(O.entities("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS t FROM base) x WHERE t <> ''""")
def md1(spark, sf):
    return MD.page_titles(signals(spark, sf))


# --- raw sinks ------------------------------------------------------------------------------------

@check("snk1_sitemap_parts", O.WITH + PLACED_SQL + f""", s AS {SECTIONS_SQL.replace('is_about FROM links', 'is_about, is_navigation, is_footer FROM placed')},
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, section, url ORDER BY page_id, link_seq) AS rn FROM s)
SELECT site_id, section, url, anchor_text, source_page, is_navigation, is_footer, is_contact, is_about FROM r WHERE rn = 1""")
def snk1(spark, sf):
    """The entries of all parts, read back from their JSON."""
    entry = "array<struct<url:string,anchor_text:string,source_page:string,is_navigation:boolean,is_footer:boolean,is_contact:boolean,is_about:boolean>>"
    parts = sinks.sitemap_parts(placed(spark, sf))
    return parts.select("site_id", "section", F.explode(F.from_json("entries", entry)).alias("e")).select("site_id", "section", "e.*")


@check("snk2_page_metadata_json", O.WITH + f""", h AS (SELECT *, nullif({O.strip(O.entities("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title FROM texts), k AS ({KIND_SQL[len(O.WITH):]})
SELECT page_id, site_id, '{{"url":' || CAST(to_json(url) AS VARCHAR) || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || CAST(to_json(title) AS VARCHAR) END || ',"status_code":' || status_code || ',"load_time":' || load_time
  || ',"page_type":"' || page_type || '","is_about_page":' || is_about_page || ',"is_contact_page":' || is_contact_page || '}}' AS document FROM h JOIN k USING (page_id)""")
def snk2(spark, sf):
    return sinks.page_metadata_json(signals(spark, sf))


@check("snk2_page_records")
def snk2_records(spark, sf):
    from siteweave.operators import maps as M

    # records, map links and the walk read the signals, so they are stored
    sig = materialise(signals(spark, sf), "signals")
    rows = sinks.page_records(sig, M.all_maps(sig), reached(spark, sf, sig)[0])
    return rows.withColumn("meta_tags", F.to_json("meta_tags")).withColumn("json_ld", F.to_json("json_ld")).withColumn(
        "google_maps_found", F.to_json("google_maps_found"))


@check("snk3_html_files", O.WITH + r""", n AS (SELECT page_id, url, site_id, html, row_number() OVER (PARTITION BY site_id ORDER BY page_id) - 1 AS i,
  replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/', '_') AS p FROM base)
SELECT site_id, CASE WHEN p = '' OR p = site_id THEN site_id || '_page_' || printf('%03d', i) ELSE substr(site_id || '_' || p || '_' || printf('%03d', i), 1, 100) END AS file_name,
  CAST(length(html) AS BIGINT) AS html_length FROM n""")
def snk3(spark, sf):
    return sinks.html_files(crawl(spark, sf)).select("site_id", "file_name", F.length("html").cast("bigint").alias("html_length"))
