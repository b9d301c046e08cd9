"""DuckDB building blocks for the reference SQL of the registered queries.

They read the same HTML with plain regular expressions, apart from the engine.
"""

from __future__ import annotations

from checks import corpus as C
from siteweave.constants import WS

TAG = r"<[a-zA-Z/!?][^>]*>"
SITE = r"replace(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1), 'www.', '')"


def site(u: str) -> str:
    return SITE.format(u=u)


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+', ' ', 'g')"


def entities(x: str) -> str:
    for name, char in [("copy", "©"), ("middot", "·"), ("quot", '"'), ("nbsp", "' || chr(160) || '"), ("ndash", "–"), ("amp", "&")]:
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def text_of(x: str, sep: str = " ") -> str:
    raw = entities(rf"regexp_replace({x}, '{TAG}', chr(1), 'g')")
    return strip(rf"regexp_replace({raw}, '{WS}*\x01(?:\x01|{WS})*', '{sep}', 'g')")


def resolve(b: str, h: str) -> str:
    root = rf"regexp_extract({b}, '^[a-z]+://[^/?#]*')"
    folder = rf"regexp_extract({b}, '^[a-z]+://[^?#]*/')"
    return rf"""(CASE WHEN {h} = '' THEN {b} WHEN regexp_matches({h}, '^[A-Za-z]+:') THEN {h}
      WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^[a-z]+:') || {h}
      WHEN starts_with({h}, '#') THEN split_part({b}, '#', 1) || {h}
      WHEN starts_with({h}, '../') THEN regexp_replace({folder}, '[^/]*/$', '') || substr({h}, 4)
      WHEN starts_with({h}, '/') THEN {root} || {h} ELSE {folder} || {h} END)"""


def attr(piece: str, name: str) -> str:
    return rf"""nullif(replace(regexp_extract({piece}, '(?is)^[^>]*?\s{name}="([^"]*)"', 1), '&amp;', '&'), '')"""


CLEAN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', chr(1), 'g')"

WITH = rf"""
WITH crawl AS ({C.CRAWL_SQL}),
base AS (SELECT *, {site('url')} AS site_id, {CLEAN} AS markup FROM crawl),
texts AS (SELECT page_id, url, site_id, status_code, load_time, html, markup, {text_of('markup')} AS text FROM base),
pieces AS (
  SELECT page_id, url, site_id, unnest(l) AS piece, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS link_seq
  FROM (SELECT page_id, url, site_id, regexp_extract_all(markup, '(?is)<a\s[^>]*>.*?</a>') AS l FROM base) x),
anchors AS (
  SELECT page_id, url AS source_page, site_id, link_seq, piece,
         replace(regexp_extract(piece, '(?is)^<a\s[^>]*?href="([^"]*)"', 1), '&amp;', '&') AS href,
         {text_of("regexp_replace(piece, '(?is)^<a[^>]*>|</a>$', '', 'g')", '')} AS anchor_text
  FROM pieces),
links0 AS (
  SELECT page_id, source_page, site_id, link_seq, {resolve('source_page', 'href')} AS url, anchor_text, piece
  FROM anchors WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')),
links1 AS (
  SELECT *, replace(regexp_extract(url, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1), 'www.', '') AS host FROM links0
  WHERE NOT regexp_matches(lower(url), '\.(pdf|docx?|xlsx?|pptx?|zip|rar|tar|gz|jpe?g|png|gif|webp|svg|mp4|avi|mov|mp3)$')),
links2 AS (
  SELECT *, CASE WHEN host = site_id THEN 'internal'
      WHEN regexp_matches(host, 'facebook\.com|instagram\.com|twitter\.com|x\.com|linkedin\.com|youtube\.com|tiktok\.com|pinterest\.com') THEN 'social'
      WHEN contains(url, 'maps.google.com') OR contains(url, 'google.com/maps') THEN 'maps' ELSE 'external' END AS link_type FROM links1),
links AS (
  SELECT *, link_type = 'internal' AND regexp_matches(lower(url), 'contact|about|team|staff|location|office|reach|touch|support|help|customer-service') AS is_contact,
         link_type = 'internal' AND contains(lower(url), 'about') AS is_about, link_type = 'maps' AS is_google_maps FROM links2),
mains AS (SELECT site_id, min(page_id) AS page_id, arg_min(url, page_id) AS main_url FROM base GROUP BY 1)
"""

SCRIPTS = r"regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>(.*?)</script>', 1)"
LD = WITH + r""", ld0 AS (
  SELECT page_id, site_id, url, unnest(l) AS body FROM (
    SELECT page_id, site_id, url, regexp_extract_all(html, '(?is)<script type="application/ld\+json">(.*?)</script>', 1) AS l FROM base) x),
ld AS (SELECT page_id, site_id, url, trim(body) AS body FROM ld0 WHERE json_valid(trim(body)))
"""

MAPS = LD + rf""", maps AS (
  SELECT page_id, site_id, url AS source_page, 'javascript' AS method, u AS map_url FROM (
    SELECT DISTINCT page_id, site_id, url, unnest(regexp_extract_all(s, '(?i)https?://(?:(?:www\.)?google\.com/maps|(?:www\.)?maps\.google\.com|goo\.gl/maps/|maps\.app\.goo\.gl/)[^\s"<>]*')) AS u
    FROM (SELECT page_id, site_id, url, unnest({SCRIPTS}) AS s FROM base) y) z
  UNION ALL
  SELECT page_id, site_id, source_page, 'direct', {resolve('source_page', 'href')} FROM anchors
  WHERE regexp_matches(lower({resolve('source_page', 'href')}), 'maps\.google\.com|google\.com/maps|goo\.gl/maps|maps\.app\.goo\.gl')
  UNION ALL
  SELECT page_id, site_id, url, 'iframe', s FROM (
    SELECT page_id, site_id, url, unnest(regexp_extract_all(markup, '<iframe src="([^"]*)"', 1)) AS s FROM base) i
  WHERE regexp_matches(lower(s), 'maps\.google\.com|google\.com/maps')
  UNION ALL
  SELECT page_id, site_id, url, 'structured', u FROM (
    SELECT page_id, site_id, url, coalesce(json_extract_string(body, '$.hasMap'),
      'https://www.google.com/maps?q=' || json_extract_string(body, '$.location.geo.latitude') || ',' || json_extract_string(body, '$.location.geo.longitude'),
      CASE WHEN json_extract(body, '$.address') IS NOT NULL THEN 'https://www.google.com/maps/search/' || replace(concat_ws(', ',
        json_extract_string(body, '$.address.streetAddress'), json_extract_string(body, '$.address.addressLocality'),
        json_extract_string(body, '$.address.addressRegion'), json_extract_string(body, '$.address.postalCode')), ' ', '+') END) AS u
    FROM ld) s WHERE u IS NOT NULL)
"""

PRODUCTS = LD + rf""", offers AS (
  SELECT page_id, site_id, url, body, CASE WHEN json_type(body, '$.offers') = 'ARRAY' THEN unnest(CAST(json_extract(body, '$.offers') AS JSON[]))
         ELSE NULL END AS o FROM ld WHERE json_extract_string(body, '$."@type"') = 'Product' AND json_type(body, '$.offers') = 'ARRAY'
  UNION ALL
  SELECT page_id, site_id, url, body, json_extract(body, '$.offers') FROM ld
  WHERE json_extract_string(body, '$."@type"') = 'Product' AND json_type(body, '$.offers') = 'OBJECT'),
ld_products AS (
  SELECT site_id, page_id, 'json-ld' AS src, json_extract_string(body, '$.name') AS name, TRY_CAST(json_extract_string(o, '$.price') AS DOUBLE) AS price,
         json_extract_string(o, '$.priceCurrency') AS currency, coalesce(json_extract_string(body, '$.url'), url) AS url
  FROM offers WHERE json_extract_string(o, '$."@type"') = 'Offer'),
markup_products AS (
  SELECT site_id, page_id, 'microdata' AS src, regexp_extract(html, 'itemprop="name">([^<]*)<', 1) AS name,
         CAST(regexp_extract(html, 'itemprop="price" content="([^"]*)"', 1) AS DOUBLE) AS price, 'EUR' AS currency,
         regexp_extract(url, '^https://[^/]*') || regexp_extract(html, 'itemprop="url" href="([^"]*)"', 1) AS url
  FROM base WHERE contains(html, 'schema.org/Product')
  UNION ALL
  SELECT site_id, page_id, 'card', regexp_extract(html, '<h3>([^<]*)</h3>', 1),
         CAST(regexp_extract(html, 'product-price">\$([0-9.]*)<', 1) AS DOUBLE), '$',
         regexp_extract(url, '^https://[^/]*') || regexp_extract(html, 'href="(/c/[^"]*)"', 1)
  FROM base WHERE contains(html, 'product-card')),
products AS (SELECT * FROM ld_products WHERE price IS NOT NULL UNION ALL SELECT * FROM markup_products)
"""
