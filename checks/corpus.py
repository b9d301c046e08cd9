"""Web pages derived from the given tables, as SQL both Spark and DuckDB run.

The corpus is the ``pages`` table plus one built page per customer.  A third
of the built pages belong to one site, so every per-site operator meets a hot
group.  Built pages link to other built pages of their site, which gives the
link graph its depth.  The SQL avoids quotes and backslashes inside literals,
so the same text means the same in both engines.
"""

from __future__ import annotations

BASE_ID = 1000000  # built pages are numbered after the given ones


def path(k: str) -> str:
    """Path of the built page of customer ``k``."""
    return (
        f"(CASE ({k}) % 7 WHEN 0 THEN '/home/' WHEN 1 THEN '/about-us/' WHEN 2 THEN '/contact/' "
        f"WHEN 3 THEN '/product/' WHEN 4 THEN '/blog/' WHEN 5 THEN '/team/' ELSE '/item/' END "
        f"|| CAST(({k}) AS STRING))"
    )


SITE_NO = "CASE WHEN k % 3 = 0 THEN 0 ELSE k % 97 END"
HOST = "('https://www.shop' || CAST(site_no AS STRING) || '.example.com')"
# links inside a site: a binary tree in the hot site, chains in the others
NEXT_A = "(CASE WHEN site_no = 0 AND k % 3 = 0 THEN k * 2 ELSE k + 291 END)"
NEXT_B = "(CASE WHEN site_no = 0 AND k % 3 = 0 THEN k * 2 + 3 ELSE k + 291 END)"
ROOT = "(CASE WHEN k % 3 = 0 THEN 0 WHEN (k % 97) % 3 = 0 THEN k % 97 + 97 ELSE k % 97 END)"


def _pick(n: int, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"(CASE k % {n} {cases} ELSE {values[-1]} END)"


S = "CAST(k AS STRING)"
P4 = "lpad(CAST(k % 10000 AS STRING), 4, '0')"

TITLE = _pick(7, [
    "'  Shop ' || seg || ' Co. | Home  '",
    "'Maison ' || k_s || ' - Official Site'",
    "'Cream Serum ' || k_s || ' &ndash; Brand ' || seg",
    "'Plain   title ' || k_s",
    "'House &amp; Garden ' || k_s || ' :: Start'",
    "'Atelier ' || seg || ': Store ' || k_s",
    "''",
])
META = (
    "'<meta name=\"' || CASE WHEN k % 4 = 0 THEN 'Description' ELSE 'description' END || '\" content=\"Description of "
    "'  || seg || ' shop   number ' || k_s || ', we sell &quot;fine&quot; goods\">' || "
    "CASE WHEN k % 3 <> 1 THEN '<meta name=\"keywords\" content=\"shoes, hats, ab, ' || lower(seg) || ', key ' || CAST(k % 40 AS STRING) || '\">' ELSE '' END"
)
ICON = _pick(5, [
    "'<link rel=\"icon\" href=\"/fav' || k_s || '.ico\">'",
    "'<link rel=\"shortcut icon\" href=\"//cdn.example.com/f.ico\">'",
    "'<link href=\"https://cdn.example.com/i' || k_s || '.png\" rel=\"apple-touch-icon\"><link rel=\"icon\" href=\"img/x.png\">'",
    "'<link rel=\"stylesheet\" href=\"/s.css\">'",
    "''",
])
OFFER = "'{\"@type\":\"Offer\",\"price\":\"' || price_s || '\",\"priceCurrency\":\"USD\"}'"
LD = _pick(6, [
    "'<script type=\"application/ld+json\">{\"@type\":\"Organization\",\"name\":\" Org ' || k_s || ' \",\"hasMap\":\"https://goo.gl/maps/org' || CAST(k % 50 AS STRING) || '\"}</script>'",
    "'<script type=\"application/ld+json\"> {\"@type\":\"Product\",\"name\":\"Widget ' || CAST(k % 300 AS STRING) || '\",\"offers\":' || " + OFFER + " || '} </script>'",
    "'<script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"Gadget ' || k_s || '\",\"url\":\"https://shop.example.com/g' || k_s || '\",\"offers\":[' || " + OFFER + " || ',{\"@type\":\"Offer\",\"price\":19.5,\"priceCurrency\":\"EUR\"},{\"@type\":\"AggregateOffer\",\"price\":1}]}</script>'",
    "'<script type=\"application/ld+json\">{broken ' || k_s || '}</script><script type=\"application/ld+json\">{\"@type\":\"WebSite\",\"name\":\"Site ' || k_s || '\"}</script>'",
    "'<script type=\"application/ld+json\">{\"@type\":\"Store\",\"location\":{\"geo\":{\"latitude\":\"' || CAST(k % 90 AS STRING) || '\",\"longitude\":\"7\"}}}</script>'",
    "'<script type=\"application/ld+json\">{\"@type\":\"Store\",\"address\":{\"streetAddress\":\"' || k_s || ' Main Street\",\"addressLocality\":\"Springfield\",\"postalCode\":\"12345\"}}</script>'",
])
SCRIPT = (
    "'<script>var m=\"https://www.google.com/maps/embed?pb=' || CAST(k % 30 AS STRING) || '\";</script>'"
)
NAV = (
    "'<header class=\"site-header\"><nav id=\"main-menu\"><ul><li class=\"has-children\"><a class=\"' || "
    + _pick(4, ["'menu-item sub-menu'", "'btn quick-links'", "'mobile-menu'", "''"])
    + " || '\" href=\"' || root_path || '\"> Home\n <b>page</b></a></li><li><a href=\"' || "
    + path("next_a") + " || '\">About us</a></li><li><a href=\"' || " + path("next_b")
    + " || '\">Next</a></li></ul></nav><img class=\"site-logo\" alt=\"x\" src=\"/img/' || "
    + _pick(3, ["'logo'", "'placeholder'", "'brand'"]) + " || k_s || '.png\"></header>'"
)
SOCIAL = _pick(8, [
    "'<a href=\"https://www.facebook.com/shop' || k_s || '?ref=x\">Facebook</a>'",
    "'<a href=\"https://instagram.com/insta' || k_s || '/\">Insta</a>'",
    "'<a href=\"https://www.tiktok.com/@t' || k_s || '\">TikTok</a>'",
    "'<a href=\"https://www.linkedin.com/company/c' || k_s || '\">In</a>'",
    "'<a href=\"https://twitter.com/tw' || k_s || '\">Tw</a>'",
    "'<a href=\"https://www.netflix.com/title/' || k_s || '\">Film</a>'",
    "'<a href=\"https://www.pinterest.com/p' || k_s || '/\">Pin</a>'",
    "'<a href=\"https://www.youtube.com/watch?v=' || k_s || '\">Video</a>'",
])
MAPS = _pick(9, [
    "'<a href=\"https://maps.google.com/place/shop' || CAST(k % 60 AS STRING) || '\">Map</a>'",
    "'<iframe src=\"https://www.google.com/maps/embed?id=' || CAST(k % 20 AS STRING) || '\"></iframe>'",
    "'<a href=\"https://maps.app.goo.gl/' || k_s || '\">Find us</a>'",
    "'<iframe src=\"https://www.youtube.com/embed/' || CAST(k % 80 AS STRING) || '\"></iframe>'",
    "'<video data-src=\"https://vimeo.com/' || k_s || '\"></video>'",
    "'<a href=\"/files/price' || k_s || '.PDF\">Prices</a>'",
    "'<a href=\"#top\">Top</a><a href=\"javascript:void(0)\">Go</a><a href=\"\">Empty</a><a href=\"tel:123\">Call</a>'",
    "'<a href=\"https://partner' || CAST(k % 40 AS STRING) || '.example.org/ref?x=1#frag\">Partner</a>'",
    "'<a href=\"//cdn.example.com/asset\">Asset</a><a href=\"sub/page?x=1\">Sub</a><a href=\"../up' || k_s || '\">Up</a>'",
])
MAIL = _pick(5, [
    "'<a href=\"mailto:info' || k_s || '@shop.example.com?subject=Hi\">Mail</a>'",
    "'<p>Write to sales' || k_s || '@shop.example.com or icon@2x.png.</p>'",
    "'<a href=\"MAILTO:not-an-address\">Mail</a>'",
    "'<p>help@desk' || k_s || '.example.org</p>'",
    "''",
])
PHONE_BITS = _pick(6, [
    "'<p>Mobile: 212-555-' || p4 || '</p>'",
    "'<p>Headquarters: 415.555.' || p4 || ' Main: 911-555-' || p4 || '</p>'",
    "'<p>Customer Service: 303 555 ' || p4 || '</p>'",
    "'<p>Call 718-911-' || p4 || ' today</p>'",
    "'<p>Cell: 646555' || p4 || ' Support: 646-555-' || p4 || '</p>'",
    "''",
])
ADDRESS = _pick(8, [
    "'<p>' || k_s || ' Main Street, Springfield, CA 90210</p>'",
    "'<p>77 High Road Northtown Kent 40210</p>'",
    "'<p>12 Rue Longue, Vieux Port, Marseille 13002</p>'",
    "''", "''", "''", "''", "''",
])
FACTS = (
    _pick(7, [
        "'<p>Founded in 1' || CAST(k % 10 AS STRING) || '99 by friends</p>'",
        "'<p>Established 2001. A team of ' || k_s || '</p>'",
        "'<p>Since 1750 we had 10-50 employees</p>'",
        "'<p>Annual revenue: $' || CAST(k % 900 + 1 AS STRING) || ',500.00 million</p>'",
        "'<p>We serve 300 people; started in 1985; $5 B</p>'",
        "'<p>staff of 12 members</p>'",
        "''",
    ])
    + " || '<p>Our ' || lower(seg) || ' shop offers ' || "
    + _pick(11, [
        "'software platform analytics'", "'fashion clothing accessories, buy now'", "'seo branding campaign by an influencer'",
        "'clinic doctor therapy'", "'insurance loan tax'", "'course tutorial academy'", "'beauty salon spa'",
        "'coffee bakery menu'", "'hotel travel booking'", "'yoga gym fitness'", "'apartment property rental'",
    ])
    + " || ' for ' || "
    + _pick(5, ["'enterprise and luxury'", "'business growth'", "'basic starter'", "'a free lite plan'", "'everyone'"])
    + " || '. Subscribe to our newsletter &amp; blog.</p>'"
)
ABOUT = (
    "CASE WHEN k % 4 = 1 THEN '<section id=\"about-us\"><p>About us: we are a small house with a long and proud tradition of "
    "honest work. Contact us today. Number ' || k_s || ' is one of many shops that serve the city well!</p></section>' ELSE '' END"
)
PRODUCTS = _pick(6, [
    "'<div itemscope itemtype=\"http://schema.org/Product\"><span itemprop=\"name\">Micro ' || k_s || '</span><span itemprop=\"price\" content=\"' || price_s || '\">x</span><meta itemprop=\"priceCurrency\" content=\"EUR\"><a itemprop=\"url\" href=\"/m/' || k_s || '\">m</a></div>'",
    "'<div class=\"card product-card\"><h3>Card ' || k_s || '</h3><span class=\"product-price\">$' || price_s || '</span><a href=\"/c/' || k_s || '\">c</a></div>'",
    "'<ul><li class=\"grid__item\"><a href=\"/k/' || k_s || '\"><h2>Grid ' || k_s || '</h2></a><b class=\"price__regular\">10.00-20.00</b></li></ul>'",
    "'<div class=\"product-item\"><p class=\"product-title\">Free</p></div>'",
    "''",
    "''",
])
FOOTER = (
    "'<div class=\"ad banner\">Ad < 5 &amp; more&nbsp;</div><footer class=\"page-footer\">&copy; shop <a href=\"/privacy?x=' || "
    "CAST(k % 5 AS STRING) || '\">Privacy policy</a> <a href=\"https://x.com/shop' || k_s || '\">X</a></footer>'"
)
ERRORS = "CASE WHEN k % 50 = 7 THEN '<p>Please solve the CAPTCHA</p>' WHEN k % 50 = 9 THEN '<p>404 Error</p>' WHEN k % 50 = 11 THEN '<p>Access Denied</p>' ELSE '' END"

BODY = " || ".join([
    "'<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\">'",
    "CASE WHEN k % 5 <> 0 THEN '<meta name=\"viewport\" content=\"width=device-width\">' ELSE '' END",
    f"'<title>' || {TITLE} || '</title>'", META, ICON, LD, "'<style>p{color:red}</style>'", SCRIPT,
    f"'<!-- <a href=\"/hidden\">no</a> --></head><body>' || {NAV}", "'<main><h1>Shop ' || k_s || '</h1>'",
    ABOUT, FACTS, PHONE_BITS, MAIL, ADDRESS, PRODUCTS, SOCIAL, MAPS, ERRORS, f"'</main>' || {FOOTER} || '</body></html>'",
])

BUILT_SQL = f"""
SELECT page_id, url, {BODY} AS html FROM (
  SELECT page_id, k, seg, price_s, site_no, k_s, p4, next_a, next_b,
         host || {path('k')} AS url, {path('root')} AS root_path
  FROM (
    SELECT {BASE_ID} + k AS page_id, k, seg, price_s, site_no, {S} AS k_s, {P4} AS p4, {HOST} AS host,
           {NEXT_A} AS next_a, {NEXT_B} AS next_b, {ROOT} AS root
    FROM (
      SELECT c_custkey AS k, c_mktsegment AS seg,
             CAST(c_custkey * 37 % 5000 + 1 AS STRING) || '.50' AS price_s,
             {SITE_NO.replace('k %', 'c_custkey %')} AS site_no
      FROM customer
    ) a
  ) b
) c
"""

CORPUS_SQL = f"SELECT page_id, url, html FROM pages UNION ALL {BUILT_SQL}"

# the fetch facts the page table does not hold
CRAWL_SQL = f"""
SELECT page_id, url, html,
       CAST(CASE page_id % 9 WHEN 1 THEN 301 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 500
            WHEN 6 THEN 503 ELSE 200 END AS INT) AS status_code,
       CAST(page_id % 16 AS DOUBLE) * 0.25 AS load_time
FROM ({CORPUS_SQL}) corpus
"""
