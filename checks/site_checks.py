"""Queries for maps, contact, business, products, marketing, features, metadata and site summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as O
from checks import tables as TB
from checks.page_checks import KIND_SQL, big, crawl, links, signals
from checks.registry import check
from siteweave import constants as K
from siteweave.operators import business as B
from siteweave.operators import contact as CT
from siteweave.operators import dom as D
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators import marketing as MK
from siteweave.operators import metadata as MD
from siteweave.operators import products as PR
from siteweave.operators.facts import first_values
from siteweave.operators.signals import page_signals
from siteweave.plans import documents as DOC
from siteweave.plans import reports as R
from siteweave.plans import summary as S
from siteweave.session import materialise

# --- maps -------------------------------------------------------------------------------

for method, fn in [("direct", M.direct), ("iframe", M.iframes), ("javascript", M.scripts), ("structured", M.structured)]:
    number = {"direct": 1, "iframe": 2, "javascript": 3, "structured": 4}[method]

    def _one(spark, sf, fn=fn):
        return fn(signals(spark, sf)).select("page_id", "site_id", "map_url")

    check(f"mp{number}_{method}_maps", O.MAPS + f"SELECT page_id, site_id, map_url FROM maps WHERE method = '{method}'")(_one)

PRIORITY = "CASE " + " ".join(f"WHEN contains(lower(map_url), '{p}') THEN {i}" for i, p in enumerate(K.MAP_PRIORITY)) + " ELSE 6 END"
SITE_MAPS = O.MAPS + f""", s AS (SELECT site_id, count(*) FILTER (method = 'direct') AS direct_links, count(*) FILTER (method = 'iframe') AS iframe_embeds,
  count(*) FILTER (method = 'javascript') AS javascript_maps, count(*) FILTER (method = 'structured') AS structured_data_maps, count(DISTINCT map_url) AS total_maps_found FROM maps GROUP BY 1),
p AS (SELECT site_id, map_url AS primary_maps_link FROM (SELECT site_id, map_url, row_number() OVER (PARTITION BY site_id ORDER BY {PRIORITY}, map_url) AS rn FROM maps) x WHERE rn = 1)
SELECT m.site_id, coalesce(direct_links, 0) AS direct_links, coalesce(iframe_embeds, 0) AS iframe_embeds, coalesce(javascript_maps, 0) AS javascript_maps,
  coalesce(structured_data_maps, 0) AS structured_data_maps, coalesce(total_maps_found, 0) AS total_maps_found, primary_maps_link,
  CASE WHEN total_maps_found > 0 THEN 'Integrated' ELSE 'Not Found' END AS status FROM mains m LEFT JOIN s USING (site_id) LEFT JOIN p USING (site_id)"""


@check("mp5_mp7_site_maps", SITE_MAPS)
def mp5(spark, sf):
    pages = crawl(spark, sf)
    return M.site_maps(L.main_pages(pages), M.all_maps(page_signals(pages)))


@check("mp6_page_maps", O.MAPS + """SELECT site_id, page_id, map_url, count(*) AS hits, min(min(page_id)) OVER (PARTITION BY site_id, map_url) AS first_page FROM maps GROUP BY 1, 2, 3""")
def mp6(spark, sf):
    return M.page_maps(M.all_maps(signals(spark, sf)))


@check("mp6_contact_page_maps", O.MAPS + f""", k AS ({KIND_SQL[len(O.WITH):]})
SELECT site_id, count(*) AS contact_page_maps FROM (SELECT DISTINCT site_id, page_id, map_url FROM maps) m JOIN k USING (page_id) WHERE is_contact_page GROUP BY 1""")
def mp6_contact(spark, sf):
    from siteweave.operators import pages as P

    # links and kinds of pages read the signals each, so what they read is stored
    sig = materialise(signals(spark, sf).select("page_id", "site_id", "url", "text", "anchors", "iframes", "script_maps", "ld"), "signals")
    return M.contact_page_maps(M.all_maps(sig), P.page_kinds(sig))


# --- contact ------------------------------------------------------------------------------

TITLE = O.strip(O.entities("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title>', 1)"))
# the nine title patterns as capture lists, first match decides
_P = r"""regexp_extract(t, '(?i){p}', ['a', 'b'])"""
_SEP = "[-–—|:]"
_HAS = "regexp_matches(lower({x}), 'product|item|shop|store|cream|serum|solution|collection')"


def _two(p: str) -> str:
    a, b = (O.strip(f"regexp_extract(t, '(?i){p}', {i})") for i in (1, 2))
    return f"""CASE WHEN {_HAS.format(x=a)} AND NOT {_HAS.format(x=b)} THEN coalesce(nullif({b}, ''), {a})
      WHEN {_HAS.format(x=b)} AND NOT {_HAS.format(x=a)} THEN coalesce(nullif({a}, ''), {b}) ELSE {a} END"""


P1 = rf"(.+?)\s*{_SEP}\s*(.+?)(?: Co\.| Inc\.| Ltd\.| LLC\.| Corp\.| Group)?$"
P3 = r"^(.*?)\s*(?:Co\.|Inc\.|Ltd\.|LLC\.|Corp\.|Group)\b"
TITLE_BRAND = f"CASE WHEN regexp_matches(t, '(?i){P1}') THEN {_two(P1)} WHEN regexp_matches(t, '(?i){P3}') THEN {O.strip(f'regexp_extract(t, {chr(39)}(?i){P3}{chr(39)}, 1)')} ELSE t END"
HOST_BRAND = "array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) for w in string_split(replace(split_part(site_id, '.', 1), '-', ' '), ' ')], ' ')"
LD_NAMES = """, names AS (SELECT site_id, trim(n) AS ld_brand FROM (SELECT site_id, json_extract_string(body, '$.name') AS n, row_number() OVER (PARTITION BY site_id ORDER BY page_id) AS rn
  FROM ld WHERE json_extract_string(body, '$."@type"') IN ('Organization', 'WebSite') AND json_extract_string(body, '$.name') <> '') x WHERE rn = 1)"""


def mains_with_title(pages: DataFrame, sig: DataFrame) -> DataFrame:
    return L.main_pages(pages).join(sig.select("page_id", "title"), "page_id")


@check("ct1_brand_names", O.LD + LD_NAMES + f""", t AS (SELECT m.site_id, nullif({TITLE}, '') AS t FROM mains m JOIN base b USING (page_id))
SELECT site_id, coalesce(ld_brand, {TITLE_BRAND}, {HOST_BRAND}) AS brand_name FROM t LEFT JOIN names USING (site_id)""")
def ct1(spark, sf):
    pages = crawl(spark, sf)
    sig = page_signals(pages)
    return CT.brands(mains_with_title(pages, sig), CT.ld_brand(sig))


@check("ct1_title_brands", O.WITH + f"SELECT page_id, {TITLE_BRAND} AS brand FROM (SELECT page_id, {TITLE} AS t FROM base) x WHERE t <> ''")
def ct1_titles(spark, sf):
    return signals(spark, sf).where("title is not null").select("page_id", CT.brand_from_title(F.col("title")).alias("brand"))


SEP_CUT = "CASE " + " ".join(f"WHEN contains(t, '{s}') THEN trim(split_part(t, '{s}', 1))" for s in K.TITLE_SEPARATORS) + " ELSE t END"


@check("ct1_older_brand_names", O.LD + f""", names AS (SELECT site_id, n FROM (SELECT site_id, json_extract_string(body, '$.name') AS n, row_number() OVER (PARTITION BY site_id ORDER BY page_id) AS rn
  FROM ld WHERE json_extract_string(body, '$.name') <> '') x WHERE rn = 1), t AS (SELECT m.site_id, nullif({TITLE}, '') AS t FROM mains m JOIN base b USING (page_id))
SELECT site_id, coalesce({SEP_CUT}, n) AS brand_name FROM t LEFT JOIN names USING (site_id)""")
def ct1_older(spark, sf):
    pages = crawl(spark, sf)
    sig = page_signals(pages)
    return CT.older_brands(mains_with_title(pages, sig), sig)


PHONE = r"(\+?1?[-.\s]?[2-9]\d{2}[-.\s]?[2-9]\d{2}[-.\s]?\d{4})"


def _phone_sql(kind: str) -> str:
    if kind == "general":
        return rf"regexp_extract_all(text, '(?i)\b{PHONE}\b', 1)"
    return "list_concat(" + ", ".join(rf"regexp_extract_all(text, '(?i){label}[:\s]*{PHONE}', 1)" for label in K.PHONE_LABELS[kind]) + ", [])"


PHONES = O.WITH + ", found AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{k}' AS kind, regexp_replace(unnest({_phone_sql(k)}), '[^0-9]', '', 'g') AS d FROM texts" for k in CT.PHONE_KINDS) + r"""),
valid AS (SELECT DISTINCT site_id, kind, '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7) AS phone FROM found
  WHERE regexp_matches(d, '^[2-9][0-9]{2}[2-9][0-9]{6}$') AND substr(d, 1, 3) <> '911' AND substr(d, 4, 3) <> '911'),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY phone) AS rn FROM valid)
SELECT site_id, kind, string_agg(phone, ', ' ORDER BY phone) AS phones FROM r WHERE rn <= 3 GROUP BY 1, 2"""


@check("ct2_phones", PHONES)
def ct2(spark, sf):
    return CT.phones(signals(spark, sf))


DIGITS = "SELECT o_orderkey, CAST(2000000000 + (o_orderkey * 7919 + o_custkey * 104729) % 7999999999 AS STRING) AS d FROM orders"


@check("ct3_phone_validity", f"SELECT o_orderkey, length(d) = 10 AND substr(d, 1, 1) >= '2' AND substr(d, 4, 1) >= '2' AND substr(d, 1, 3) <> '911' AND substr(d, 4, 3) <> '911' AS valid FROM ({DIGITS}) x")
def ct3(spark, sf):
    return TB.derived(spark, sf, DIGITS, "orders").select("o_orderkey", CT.phone_is_valid(F.col("d")).alias("valid"))


EMAIL_OK = r"length({e}) <= 254 AND NOT regexp_matches(lower({e}), '\.(png|jpg|jpeg|gif|webp|css|js)') AND regexp_matches({e}, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$')"
EMAILS = O.WITH + rf""", m AS (SELECT page_id, site_id, link_seq, split_part(replace(href, 'mailto:', ''), '?', 1) AS e, row_number() OVER (PARTITION BY page_id ORDER BY link_seq) AS rn FROM anchors WHERE starts_with(lower(href), 'mailto:')),
first AS (SELECT site_id, arg_min(e, page_id) AS mailto_email FROM m WHERE rn = 1 AND {EMAIL_OK.format(e='e')} GROUP BY 1),
t AS (SELECT site_id, min(e) AS text_email FROM (SELECT site_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,7}}\b')) AS e FROM texts) x WHERE {EMAIL_OK.format(e='e')} GROUP BY 1)
SELECT site_id, mailto_email, text_email, coalesce(mailto_email, text_email) AS email FROM mains LEFT JOIN first USING (site_id) LEFT JOIN t USING (site_id)"""


@check("ct4_ct5_emails", EMAILS)
def ct4(spark, sf):
    return CT.emails(signals(spark, sf))


MAILS = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'a.b+c' ELSE lower(c_mktsegment) END || CASE c_custkey % 5 WHEN 0 THEN '@x.co.uk' WHEN 1 THEN '@pic2x.PNG' WHEN 2 THEN '@@y.com' WHEN 3 THEN '@no-dot' ELSE '@z-1.example' END AS e FROM customer"""


@check("ct6_email_validity", f"SELECT c_custkey, {EMAIL_OK.format(e='e')} AS valid FROM ({MAILS}) x")
def ct6(spark, sf):
    return TB.derived(spark, sf, MAILS, "customer").select("c_custkey", CT.email_is_valid(F.col("e")).alias("valid"))


ADDR1 = r"\b(\d{1,5}\s[\w\s]{3,30},\s*[\w\s]{3,20},\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?)\b"
ADDR2 = r"\b(\d{1,5}\s[\w\s]{3,30},?\s*[\w\s]{3,20},?\s*[A-Za-z]{2,15}\s*\d{5,10})\b"


@check("ct7_ct8_addresses", O.WITH + rf""", hits AS (SELECT site_id, page_id, 0 AS p, generate_subscripts(l, 1) AS i, unnest(l) AS a FROM (SELECT site_id, page_id, regexp_extract_all(text, '{ADDR1}', 1) AS l FROM texts) x
  UNION ALL SELECT site_id, page_id, 1, generate_subscripts(l, 1), unnest(l) FROM (SELECT site_id, page_id, regexp_extract_all(text, '{ADDR2}', 1) AS l FROM texts) x),
best AS (SELECT site_id, trim(a) AS address FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY p, page_id, i) AS rn FROM hits WHERE contains(a, ',')) y WHERE rn = 1)
SELECT site_id, address, trim(regexp_extract(address, '([^,]+),\s*([A-Z]{{2}})\s*\d{{5}}', 1)) AS city, regexp_extract(address, '([^,]+),\s*([A-Z]{{2}})\s*\d{{5}}', 2) AS state FROM best""")
def ct7(spark, sf):
    return CT.addresses(signals(spark, sf))


SOCIAL = O.WITH + """, plat(domain, platform) AS (VALUES """ + ", ".join(f"('{d}', '{p}')" for d, p in K.SOCIAL_PLATFORMS) + r"""),
soc AS (SELECT site_id, platform, rtrim(split_part(href, '?', 1), '/') AS profile, row_number() OVER (PARTITION BY site_id, platform ORDER BY page_id, link_seq) AS rn
  FROM anchors JOIN plat ON contains(lower(href), domain)),
social AS (SELECT site_id, platform, profile FROM soc WHERE rn = 1)"""


@check("ct9_social_profiles", SOCIAL + " SELECT * FROM social")
def ct9(spark, sf):
    return CT.social_profiles(signals(spark, sf))


SOCIAL_COLS = ", ".join(f"max(profile) FILTER (platform = '{p}') AS {p}" for p in K.SOCIAL_NAMES)


@check("ct9_ct10_social_columns", SOCIAL + f" SELECT site_id, {SOCIAL_COLS} FROM social GROUP BY 1")
def ct10(spark, sf):
    return CT.social_columns(CT.social_profiles(signals(spark, sf)))


# --- business -----------------------------------------------------------------------------

def industry_sql(groups: dict[str, list[str]], src: str, key: str, text: str) -> str:
    scores = ", ".join("(" + " + ".join(f"max(CAST(contains(low, '{w}') AS INT))" for w in words) + f") AS s{i}" for i, words in enumerate(groups.values()))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(groups))) + ")"
    pick = " ".join(f"WHEN s{i} = {top} THEN '{name}'" for i, name in enumerate(groups))
    return f"SELECT {key} AS site_id, CASE WHEN {top} = 0 THEN 'Unknown' {pick} END AS industry FROM (SELECT {key}, {scores} FROM (SELECT {key}, lower({text}) AS low FROM {src}) x GROUP BY 1) y"


@check("bz1_industry", O.WITH + industry_sql(K.INDUSTRY_KEYWORDS, "texts", "site_id", "text"))
def bz1(spark, sf):
    return B.industries(signals(spark, sf))


DOC_TEXTS = "SELECT source || '-' || lang AS site_id, doc_id AS page_id, text || CASE doc_id % 9 WHEN 0 THEN ' cloud software' WHEN 1 THEN ' yoga' WHEN 2 THEN ' tax loan' ELSE '' END AS text FROM documents"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return TB.derived(spark, sf, DOC_TEXTS, "documents")


@check("bz1_industry_of_documents", industry_sql(K.INDUSTRY_KEYWORDS, f"({DOC_TEXTS}) d", "site_id", "text"))
def bz1_documents(spark, sf):
    return B.industries(documents(spark, sf))


@check("bz1_industry_older_dictionary", O.WITH + industry_sql(B.SHORT_INDUSTRIES, "texts", "site_id", "text"))
def bz1_older(spark, sf):
    return B.industries(signals(spark, sf), B.SHORT_INDUSTRIES)


def _first_sql(i: int, expr: str, cond: str) -> str:
    return f"SELECT site_id, page_id, {i} AS p, {expr} AS v FROM texts WHERE regexp_matches(text, '{cond}')"


def _best(name: str, arms: list[str]) -> str:
    return f"{name} AS (SELECT site_id, v FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY p, page_id) AS rn FROM ({' UNION ALL '.join(arms)}) x) y WHERE rn = 1)"


EMP = [_first_sql(0, rf"regexp_extract(text, '(?i){K.EMPLOYEE_PATTERNS[0]}', 1) || CASE WHEN regexp_extract(text, '(?i){K.EMPLOYEE_PATTERNS[0]}', 2) <> '' THEN '-' || regexp_extract(text, '(?i){K.EMPLOYEE_PATTERNS[0]}', 2) ELSE '' END",
                  "(?i)" + K.EMPLOYEE_PATTERNS[0])] + [
    _first_sql(i, f"regexp_extract(text, '(?i){p}', 1)", "(?i)" + p) for i, p in enumerate(K.EMPLOYEE_PATTERNS) if i > 0]
REV = [_first_sql(i, f"'$' || regexp_extract(text, '(?i){p}', 1)", "(?i)" + p) for i, p in enumerate(K.REVENUE_PATTERNS)]
YEARS = " UNION ALL ".join(
    f"SELECT site_id, {i} AS p, arg_min(regexp_extract(text, '(?i){p}', 1), page_id) AS y FROM texts WHERE regexp_matches(text, '(?i){p}') GROUP BY 1"
    for i, p in enumerate(K.FOUNDED_PATTERNS))
SIZES = ", " + _best("emp", EMP) + ", " + _best("rev", REV) + f", yr AS (SELECT site_id, arg_min(y, p) AS v FROM ({YEARS}) x WHERE CAST(y AS INT) BETWEEN 1800 AND 2026 GROUP BY 1)"


@check("bz2_bz3_bz4_size_facts", O.WITH + SIZES + """ SELECT site_id, emp.v AS employees, rev.v AS annual_revenue, yr.v AS founded_year
FROM (SELECT DISTINCT site_id FROM texts) s LEFT JOIN emp USING (site_id) LEFT JOIN rev USING (site_id) LEFT JOIN yr USING (site_id)""")
def bz2(spark, sf):
    return B.size_facts(signals(spark, sf), 2026)


@check("bz5_json_ld_products", O.PRODUCTS + "SELECT * FROM ld_products WHERE price IS NOT NULL")
def bz5(spark, sf):
    return PR.ld_products(signals(spark, sf))


@check("bz6_bz7_markup_products", O.PRODUCTS + "SELECT * FROM markup_products")
def bz6(spark, sf):
    return PR.markup_products(crawl(spark, sf))


@check("bz8_cheapest_offers", O.PRODUCTS + """SELECT site_id, url, name, price, currency FROM (SELECT *, row_number() OVER (PARTITION BY site_id, url, name ORDER BY price, currency) AS rn FROM products) x WHERE rn = 1""")
def bz8(spark, sf):
    pages = crawl(spark, sf)
    return PR.cheapest_offers(PR.all_products(page_signals(pages), pages))


PART_PRODUCTS = """SELECT p_brand AS site_id, p_name AS name, p_retailprice + (p_partkey % 5) * 100 AS price, 'USD' AS currency, 'https://shop.example.com/' || CAST(p_partkey % 400 AS STRING) AS url FROM part"""


@check("bz8_bz9_price_extremes", f"""WITH u AS (SELECT site_id, name, url, currency, min(price) AS price FROM ({PART_PRODUCTS}) x GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY price, name, url) AS lo, count(*) OVER (PARTITION BY site_id) AS n FROM u)
SELECT site_id, name, price, currency, url, 'min' AS side, lo AS rank FROM r WHERE lo <= 4 UNION ALL
SELECT site_id, name, price, currency, url, 'max', lo - greatest(n - 4, 0) FROM r WHERE lo > n - 4""")
def bz9(spark, sf):
    return big(PR.price_extremes(PR.cheapest_offers(TB.derived(spark, sf, PART_PRODUCTS, "part"))), "rank")


FACT_ROWS = """SELECT CAST(c_custkey AS STRING) AS site_id, CASE WHEN c_custkey % 2 = 0 THEN 'https://s.example.com' ELSE 'http://s.example.com' END AS main_url,
  CASE WHEN c_custkey % 3 = 0 THEN 'f' END AS facebook, CASE WHEN c_custkey % 4 = 0 THEN 'i' END AS instagram, CASE WHEN c_custkey % 5 < 3 THEN 't' END AS tiktok,
  CASE WHEN c_custkey % 7 < 4 THEN 'l' END AS linkedin, CASE WHEN c_custkey % 2 = 1 THEN 'w' END AS twitter, CASE WHEN c_custkey % 11 < 5 THEN 'p' END AS pinterest, CASE WHEN c_custkey % 6 = 0 THEN 'y' END AS youtube,
  CASE WHEN c_custkey % 4 <> 1 THEN 'a@b.co' END AS email, CASE WHEN c_custkey % 5 = 0 THEN '(212) 555-0000' END AS general_phone, CASE WHEN c_custkey % 9 = 0 THEN '(212) 555-0001' END AS mobile_phone,
  CASE WHEN c_custkey % 3 = 1 THEN '1 Main' END AS address, CASE WHEN c_custkey % 8 = 0 THEN 'm' END AS primary_maps_link, c_custkey % 3 AS contact_links,
  CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS brand_name, CASE WHEN c_custkey % 6 = 5 THEN 'Unknown' ELSE c_mktsegment END AS industry, CASE WHEN c_custkey % 7 = 2 THEN '1999' END AS founded_year,
  CASE WHEN c_custkey % 13 < 6 THEN '50' END AS employees, CASE WHEN c_custkey % 12 < 3 THEN '$5' END AS annual_revenue, c_custkey * 37 % 12001 AS total_words, c_custkey % 30 AS total_pages,
  CASE WHEN c_custkey % 8 = 0 THEN 'Integrated' ELSE 'Not Found' END AS maps_status, CASE WHEN c_custkey % 4 = 0 THEN '@i' END AS instagram_handle, c_custkey % 5 = 2 AS worked_with_creators,
  c_custkey % 15 AS video_count, CASE c_custkey % 4 WHEN 0 THEN 'Complex' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Simple' ELSE 'Basic' END AS complexity, c_custkey % 7 AS social_links FROM customer"""
_N = "(" + " + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in K.SOCIAL_NAMES) + ")"
SCORES = f"""WITH f AS ({FACT_ROWS}), g AS (SELECT *, {_N} AS n, CAST(email IS NOT NULL AS INT) + CAST(general_phone IS NOT NULL OR mobile_phone IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT)
  + CAST(primary_maps_link IS NOT NULL AS INT) + CAST(contact_links > 0 AS INT) AS ways FROM f),
s AS (SELECT site_id, CASE WHEN n >= 5 THEN 'Strong' WHEN n >= 3 THEN 'Moderate' WHEN n >= 1 THEN 'Basic' ELSE 'Limited' END AS digital_presence,
  CASE WHEN ways >= 4 THEN 'Excellent' WHEN ways >= 2 THEN 'Good' WHEN ways >= 1 THEN 'Basic' ELSE 'Limited' END AS contact_accessibility,
  CAST(10 * (CAST(brand_name IS NOT NULL AS INT) + CAST(industry <> 'Unknown' AS INT) + CAST(founded_year IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT) + CAST(email IS NOT NULL AS INT)
    + CAST(general_phone IS NOT NULL AS INT) + CAST(n > 0 AS INT)) + 15 * (CAST(employees IS NOT NULL AS INT) + CAST(annual_revenue IS NOT NULL AS INT)) AS BIGINT) AS firmographic_score,
  CAST(least(30, n * 5) + CASE WHEN total_words > 10000 THEN 25 WHEN total_words > 5000 THEN 20 WHEN total_words > 1000 THEN 15 ELSE 0 END
    + CASE WHEN total_pages > 20 THEN 25 WHEN total_pages > 10 THEN 20 WHEN total_pages > 5 THEN 15 ELSE 0 END + CASE WHEN maps_status = 'Integrated' THEN 10 ELSE 0 END
    + CASE WHEN starts_with(main_url, 'https://') THEN 10 ELSE 0 END AS BIGINT) AS engagement_score,
  CAST(CASE WHEN instagram_handle IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN worked_with_creators THEN 20 ELSE 0 END + least(20, video_count * 2) + least(20, n * 3)
    + CASE WHEN complexity IN ('Complex', 'Moderate') THEN 15 ELSE 0 END AS BIGINT) AS ig_score,
  CASE WHEN social_links > 3 THEN 75 ELSE 50 END AS points, facebook, instagram, tiktok, linkedin, twitter, pinterest, youtube FROM g)
"""


@check("bz10_bz11_bz12_bz13_bz16_mk4_scores", SCORES + "SELECT site_id, digital_presence, contact_accessibility, firmographic_score, engagement_score, ig_score FROM s")
def scores(spark, sf):
    rows = B.scores(TB.derived(spark, sf, FACT_ROWS, "customer")).withColumn("ig_score", MK.ig_score())
    return big(rows.select("site_id", "digital_presence", "contact_accessibility", "firmographic_score", "engagement_score", "ig_score"),
               "firmographic_score", "engagement_score", "ig_score")


@check("mk5_engagement_map", SCORES + "SELECT site_id, concat_ws(',', " + ", ".join(f"CASE WHEN {p} IS NOT NULL THEN '{p}=' || points END" for p in sorted(K.SOCIAL_NAMES)) + ") AS engagement FROM s")
def mk5(spark, sf):
    rows = TB.derived(spark, sf, FACT_ROWS, "customer").select("site_id", F.map_entries(MK.engagement_map()).alias("m"))
    return rows.select("site_id", F.array_join(F.array_sort(F.transform("m", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("engagement"))


@check("ss3_narrative", SCORES + """SELECT site_id, CASE WHEN engagement_score > 70 THEN 'high' WHEN engagement_score > 40 THEN 'moderate' ELSE 'low' END AS engagement_tier,
  CASE WHEN firmographic_score > 70 THEN 'Strong' WHEN firmographic_score > 40 THEN 'Moderate' ELSE 'Limited' END AS completeness_tier,
  CASE WHEN engagement_score > 70 THEN 'a sophisticated' ELSE 'a developing' END AS operation FROM s""")
def ss3(spark, sf):
    return S.narrative(B.scores(TB.derived(spark, sf, FACT_ROWS, "customer")))


@check("bz14_budget_segment", O.WITH + f"""SELECT site_id, CASE WHEN bool_or({O.any_of('lower(text)', K.BUDGET_KEYWORDS['High-End'])}) THEN 'High-End'
  WHEN bool_or({O.any_of('lower(text)', K.BUDGET_KEYWORDS['Mid-Budget'])}) THEN 'Mid-Budget' ELSE 'Unknown' END AS segmentation FROM texts GROUP BY 1""")
def bz14(spark, sf):
    return B.budget(signals(spark, sf))


BUDGET_OLD = industry_sql(K.BUDGET_KEYWORDS, "texts", "site_id", "text")


@check("bz15_older_budget_segment", O.WITH + SIZES + f""", b AS ({BUDGET_OLD}), e AS (SELECT site_id, TRY_CAST(split_part(v, '-', 1) AS BIGINT) AS n FROM emp)
SELECT site_id, CASE WHEN industry <> 'Unknown' THEN industry WHEN n > 100 THEN 'High-End' WHEN n > 20 THEN 'Mid-Budget' WHEN n IS NOT NULL THEN 'Low-End' ELSE 'Unknown' END AS segmentation FROM b LEFT JOIN e USING (site_id)""")
def bz15(spark, sf):
    sig = signals(spark, sf)
    return B.older_budget(sig, B.size_facts(sig, 2026))


# --- marketing and features ---------------------------------------------------------------------

@check("mk1_instagram_handles", SOCIAL + r""" SELECT site_id, '@' || nullif(regexp_extract(profile, 'instagram\.com/([^/?]+)', 1), '') AS instagram_handle FROM social WHERE platform = 'instagram'""")
def mk1(spark, sf):
    return CT.social_profiles(signals(spark, sf)).where("platform = 'instagram'").select("site_id", MK.instagram_handle(F.col("profile")).alias("instagram_handle"))


@check("mk2_creator_sites", O.WITH + f"SELECT site_id, bool_or({O.any_of('lower(text)', K.CREATOR_KEYWORDS)}) AS worked_with_creators FROM texts GROUP BY 1")
def mk2(spark, sf):
    return MK.creator_sites(signals(spark, sf))


VIDEOS = O.WITH + rf""", v AS (SELECT site_id, page_id, 0 AS part, i, coalesce({O.attr("'<x ' || e", 'src')}, {O.attr("'<x ' || e", 'data-src')}) AS video_url FROM (
    SELECT site_id, page_id, generate_subscripts(l, 1) AS i, unnest(l) AS e FROM (SELECT site_id, page_id, regexp_extract_all(markup, '(?is)<(?:video|iframe)( [^>]*>)', 1) AS l FROM base) x) y
  UNION ALL SELECT site_id, page_id, 1, link_seq, href FROM anchors WHERE regexp_matches(href, 'youtube\.com/watch|vimeo\.com/|tiktok\.com/')),
videos AS (SELECT * FROM v WHERE part = 1 OR regexp_matches(video_url, 'youtube|vimeo|tiktok|instagram'))"""


@check("mk3_videos", VIDEOS + " SELECT site_id, video_url, min(page_id) AS first_page FROM videos GROUP BY 1, 2")
def mk3(spark, sf):
    return MK.videos(signals(spark, sf))


@check("mk3_older_first_videos", VIDEOS + """ SELECT site_id, rank, video_url FROM (SELECT site_id, video_url, row_number() OVER (PARTITION BY site_id ORDER BY page_id, part, i) AS rank FROM videos) x WHERE rank <= 10""")
def mk3_older(spark, sf):
    return MK.first_videos(signals(spark, sf))


@check("ft1_ft3_features", O.WITH + "SELECT site_id, " + ", ".join(
    f"bool_or({O.any_of('lower(text)', w)}) AS {n}" for n, w in {**K.FEATURE_KEYWORDS, "social_in_text": K.SOCIAL_TEXT_KEYWORDS}.items())
    + f", bool_or({O.any_of('lower(html)', K.VIDEO_MARKERS)}) AS video_presence FROM texts GROUP BY 1")
def ft1(spark, sf):
    return MK.features(signals(spark, sf))


@check("ft2_social_presence", O.WITH + "SELECT site_id, bool_or(link_type = 'social') AS social_media_presence FROM links GROUP BY 1")
def ft2(spark, sf):
    return MK.social_presence(links(spark, sf))


@check("ft4_main_page_features", O.WITH + "SELECT m.site_id, starts_with(main_url, 'https://') AS ssl_secure, contains(lower(html), 'viewport') AS mobile_responsive FROM mains m JOIN base USING (page_id)")
def ft4(spark, sf):
    pages = crawl(spark, sf)
    return MK.main_page_features(L.main_pages(pages).join(page_signals(pages).select("page_id", "viewport"), "page_id"))


# --- metadata -------------------------------------------------------------------------------------

ABOUT_PAGES = O.WITH + f""", k AS ({KIND_SQL[len(O.WITH):]}), named AS (SELECT DISTINCT site_id, url FROM links WHERE is_about),
c AS (SELECT t.site_id, t.page_id, t.url, length(text) AS n FROM texts t JOIN k USING (page_id) WHERE is_about_page OR (t.site_id, t.url) IN (SELECT site_id, url FROM named))
SELECT site_id, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, page_id) AS rn FROM c) x WHERE rn = 1"""


@check("md2_about_pages", ABOUT_PAGES)
def md2(spark, sf):
    sig = signals(spark, sf)
    return MD.about_pages(sig, L.page_links(sig))


@check("md3_about_texts")
def md3(spark, sf):
    return D.about_texts(D.parse(crawl(spark, sf)))


@check("md4_about_sections")
def md4(spark, sf):
    return D.about_sections(D.parse(crawl(spark, sf)))


@check("md2_md3_md4_md5_about")
def md_about(spark, sf):
    pages = crawl(spark, sf)
    sig = page_signals(pages)
    return MD.about(pages, sig, L.page_links(sig))


SECTIONS = "SELECT source AS site_id, doc_id AS page_id, 0 AS selector, 0 AS elem_seq, text AS section_text FROM documents"


@check("md5_about_fallback", f"""WITH s AS (SELECT site_id, lower(section_text) AS low, min(page_id) AS page_id, arg_min(section_text, page_id) AS section_text FROM ({SECTIONS}) x WHERE length(section_text) > 50 GROUP BY 1, 2)
SELECT site_id, substr(string_agg(section_text, chr(10) || chr(10) ORDER BY page_id), 1, 3000) AS about_text FROM s GROUP BY 1""")
def md5(spark, sf):
    return MD.about_fallback(TB.derived(spark, sf, SECTIONS, "documents"))


UNWANTED = "|".join(K.ABOUT_UNWANTED)


@check("md6_clean_text", f"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array({O.collapse(O.strip('text'))}, '[.!?]+') AS l FROM documents) x),
g AS (SELECT doc_id, i, {O.strip('s')} AS s FROM s), j AS (SELECT doc_id, string_agg(s, '. ' ORDER BY i) AS t FROM g WHERE length(s) > 20 AND NOT regexp_matches(lower(s), '{UNWANTED}') GROUP BY 1)
SELECT doc_id, coalesce(CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '...' ELSE t END, '') AS cleaned FROM documents LEFT JOIN j USING (doc_id)""")
def md6(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", D.clean_about(F.col("text")).alias("cleaned"))


KEYWORDS = O.WITH + """, kw AS (SELECT DISTINCT site_id, trim(unnest(string_split(regexp_extract(markup, '(?i)<meta name="keywords" content="([^"]*)"', 1), ','))) AS w FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY w) AS rn FROM kw WHERE length(w) > 2)"""


@check("md7_keywords", KEYWORDS + " SELECT site_id, string_agg(w, ', ' ORDER BY w) AS keywords FROM r WHERE rn <= 20 GROUP BY 1")
def md7(spark, sf):
    return MD.keywords(signals(spark, sf))


# --- top-k of the given tables ----------------------------------------------------------------------

@check("facts_first_values", """WITH d AS (SELECT DISTINCT c_mktsegment AS site_id, c_name FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY c_name) AS rn FROM d)
SELECT site_id, string_agg(c_name, ', ' ORDER BY c_name) AS joined FROM r WHERE rn <= 3 GROUP BY 1""")
def first_names(spark, sf):
    rows = TB.table(spark, sf, "customer").selectExpr("c_mktsegment AS site_id", "c_custkey AS page_id", "c_name")
    return first_values(rows, "c_name", ["site_id"], 3)


# --- site summary --------------------------------------------------------------------------------------

@check("ss2_totals", O.WITH + rf"""SELECT site_id, CAST(sum(len(regexp_extract_all(text, '[^{O.WS[1:]}+'))) AS BIGINT) AS total_words, avg(load_time) AS avg_load_time, count(*) AS pages_analysed FROM texts GROUP BY 1""")
def ss2(spark, sf):
    return S.totals(signals(spark, sf))


@check("ss5_batch_outcome", O.WITH + f""", s AS (SELECT DISTINCT {O.site('url')} AS site_id, url FROM base), ok AS (SELECT DISTINCT site_id FROM base WHERE status_code = 200 AND length(html) > 1000)
SELECT count(*) FILTER (site_id IN (SELECT site_id FROM ok)) AS completed, count(*) FILTER (site_id NOT IN (SELECT site_id FROM ok)) AS failed FROM s""")
def ss5(spark, sf):
    from siteweave.operators import pages as P
    from siteweave.sources import readers

    pages = crawl(spark, sf)
    return S.batch_outcome(readers.seeds(pages), L.main_pages(P.accepted(pages)))


OUTCOMES_SQL = O.WITH + f""", p AS (SELECT {O.site('url')} AS site_id, url, status_code, html, coalesce(status_code = 200 AND length(html) > 1000, FALSE) AS kept FROM base),
c AS (SELECT *, CASE WHEN contains(html, '520: Web server is returning an unknown error') THEN '520 Unknown Server Error' WHEN contains(html, 'Just a moment...') THEN 'Cloudflare Challenge'
  WHEN contains(html, 'Access Denied') THEN 'Access Denied' WHEN contains(html, 'Service Unavailable') THEN 'Service Unavailable' WHEN contains(html, 'Cloudflare') THEN 'Cloudflare Protection'
  WHEN {" OR ".join(f"contains(lower(html), '{p}')" for p in K.EFFECTIVE_ERROR_PHRASES)} THEN 'CAPTCHA Challenge'
  WHEN contains(html, 'Not Found') OR contains(html, '404 Error') THEN '404 Not Found' WHEN status_code <> 200 THEN 'status ' || status_code ELSE 'body of 1000 characters or less' END AS why FROM p),
r AS (SELECT site_id, why, count(*) AS n FROM c WHERE NOT kept GROUP BY 1, 2), w AS (SELECT site_id, why, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, why) AS rn FROM r),
t AS (SELECT site_id, count(*) AS pages, count(*) FILTER (NOT kept) AS refused FROM c GROUP BY 1)
SELECT s.site_id, s.url AS main_url, CASE WHEN pages > refused THEN 'completed' ELSE 'failed' END AS outcome, CASE WHEN pages = refused THEN why END AS reason, pages, refused
FROM (SELECT DISTINCT site_id, url FROM p) s JOIN t USING (site_id) LEFT JOIN w ON w.site_id = s.site_id AND rn = 1"""


@check("ss5_site_outcomes", OUTCOMES_SQL)
def ss5_sites(spark, sf):
    """Why sites have no summary."""
    from siteweave.operators import pages as P
    from siteweave.sources import readers

    pages = crawl(spark, sf)
    return S.site_outcomes(readers.seeds(pages), pages, L.main_pages(P.accepted(pages)))


@check("lk20_capped_pages", O.WITH + """, r AS (SELECT b.page_id, b.url, row_number() OVER (PARTITION BY b.site_id ORDER BY b.page_id <> m.page_id, b.url, b.page_id) AS rn FROM base b JOIN mains m USING (site_id))
SELECT page_id, url FROM r WHERE rn <= 100""")
def capped_100(spark, sf):
    return S.capped_pages(crawl(spark, sf), 100).select("page_id", "url")


SUMMARY_SQL = O.MAPS + LD_NAMES + SIZES + f""", t AS (SELECT m.site_id, m.main_url, b.status_code, nullif({TITLE}, '') AS t FROM mains m JOIN base b USING (page_id)),
br AS (SELECT site_id, main_url, status_code, coalesce(ld_brand, {TITLE_BRAND}, {HOST_BRAND}) AS brand_name FROM t LEFT JOIN names USING (site_id)),
ind AS ({industry_sql(K.INDUSTRY_KEYWORDS, "texts", "site_id", "text")}),
wd AS (SELECT site_id, count(*) AS pages_analysed, CAST(sum(len(regexp_extract_all(text, '[^{O.WS[1:]}+'))) AS BIGINT) AS total_words FROM texts GROUP BY 1),
lc AS (SELECT site_id, count(*) FILTER (link_type = 'internal') AS internal_links, count(*) FILTER (link_type = 'social') AS social_links, count(*) AS total_links FROM links GROUP BY 1),
mc AS (SELECT site_id, count(DISTINCT map_url) AS total_maps_found FROM maps GROUP BY 1)
SELECT site_id, main_url, brand_name, CAST(status_code AS INT) AS main_status, industry, emp.v AS employees, rev.v AS annual_revenue, yr.v AS founded_year, pages_analysed, total_words,
  coalesce(internal_links, 0) AS internal_links, coalesce(social_links, 0) AS social_links, coalesce(total_links, 0) AS total_links, coalesce(total_maps_found, 0) AS total_maps_found
FROM br LEFT JOIN ind USING (site_id) LEFT JOIN emp USING (site_id) LEFT JOIN rev USING (site_id) LEFT JOIN yr USING (site_id) LEFT JOIN wd USING (site_id) LEFT JOIN lc USING (site_id) LEFT JOIN mc USING (site_id)"""


@check("ss1_site_summary", SUMMARY_SQL)
def ss1(spark, sf):
    return S.site_summary(crawl(spark, sf)).select(
        "site_id", "main_url", "brand_name", "main_status", "industry", "employees", "annual_revenue", "founded_year", "pages_analysed", "total_words",
        "internal_links", "social_links", "total_links", "total_maps_found")


@check("ss4_snk5_summary_csv")
def ss4(spark, sf):
    return S.flatten(S.site_summary(crawl(spark, sf), analysis_date="2026-01-02 03:04:05"))


@check("ss7_snk7_business_report")
def ss7(spark, sf):
    return R.business_report(S.site_summary(crawl(spark, sf), analysis_date="2026-01-02 03:04:05"))


@check("ss6_sitemap_report")
def ss6(spark, sf):
    pages = crawl(spark, sf)
    # the summary and the lists of the report read these, some of them several times
    sig = materialise(signals(spark, sf), "signals")
    found, videos = materialise(M.all_maps(sig), "map_links"), materialise(MK.videos(sig), "videos")
    sites = S.site_summary(pages, analysis_date="2026-01-02 03:04:05", signals=sig, found=found, videos=videos, lists=False)
    whole = DOC.whole(DOC.sitemap_text(sites, L.placed_links(D.parse(pages)), DOC.site_lists(found, videos)))
    return whole.withColumnRenamed("folder", "site_id")


@check("snk4_master_json")
def snk4(spark, sf):
    from siteweave.sources import sinks

    return sinks.master_json(S.site_summary(crawl(spark, sf)))


@check("snk1_sitemap_head")
def snk1_head(spark, sf):
    from siteweave.sources import sinks

    return sinks.sitemap_head(S.site_summary(crawl(spark, sf)))
