"""Queries for the report compiler and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as O
from checks import tables as TB
from checks.registry import CHECKS, check
from siteweave import constants as K
from siteweave.plans import compiler as CP
from siteweave.session import shared_folder
from siteweave.streaming import intake

# A report per supplier, in both engines' SQL; some values are missing on purpose.
k = "CAST(s_suppkey AS STRING)"


def _opt(n: int, r: int, value: str, missing: str = "'Not found'") -> str:
    return f"CASE WHEN s_suppkey % {n} = {r} THEN {missing} ELSE {value} END"


def _mark(n: int) -> str:
    return f"CASE WHEN s_suppkey % {n} = 0 THEN '✅ Yes' ELSE '❌ No' END"


RULE = "'" + "=" * 80 + "'"
ADDRESS = f"""CASE s_suppkey % 7 WHEN 0 THEN '12 Main Street, Springfield, CA 90210' WHEN 1 THEN '5 Rue Longue, Lyon, Rhone, fr' WHEN 2 THEN 'Toronto, Canada'
  WHEN 3 THEN 'Austin, tx' WHEN 4 THEN '1 Road, Somewhere, ZZ 11111' WHEN 5 THEN 'Lisbon, Lisboa' ELSE 'Not found' END"""
PHONE = "'(212) 555-' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0')"
LINES = [
    "'Generated: 2026-01-02 03:04:05'", f"CASE WHEN s_suppkey % 10 = 3 THEN 'No label here' ELSE 'Domain: site' || {k} || '.example.com' END", "''",
    f"'• Company Name: ' || {_opt(6, 1, 's_name', chr(39) + 'Unknown' + chr(39))}", f"'• Company Title: Title ' || {k}",
    "'• Industry: Real Estate'", f"'• Website: https://site' || {k} || '.example.com'", "'• Website Status: ✅ Good (200 OK)'",
    f"'• Founded Year: ' || {_opt(4, 0, chr(39) + '1999' + chr(39), chr(39) + 'Unknown' + chr(39))}", "''",
    f"'• Total Pages Discovered: ' || {k}", "'• Total Links Found: 77'", "'• Maximum Crawl Depth: 4'", "'• Website Structure Complexity: Simple'",
    f"'• Total Word Count: 12,' || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0')", "'• Average Load Time: 1.25s'", RULE,
    f"'• Site Title:   Title   ' || {k}", f"'• Meta Description: ' || {_opt(3, 0, chr(39) + 'We sell many   fine goods at ' + chr(39) + ' || s_name')}",
    "'• Meta Keywords: a, b'", f"'• Keywords Compilation: ' || {_opt(5, 0, chr(39) + 'alpha, beta ' + chr(39) + ' || ' + k)}", f"'• Logo URL: ' || {_opt(2, 0, chr(39) + '//cdn.example.com/l.png' + chr(39))}",
    "'• Favicon URL: cdn.example.com/f.ico'", "''", "'• About Us URL: Not found'", "'• About Us Text: '",
    f"CASE s_suppkey % 3 WHEN 0 THEN 'We have been a small company since the year one. And   we' || chr(10) || '  go on for ' || {k} WHEN 1 THEN 'No about us information found' ELSE 'Short' END", "''", RULE, "'📇 CONTACT INFORMATION'",
    f"'• Mobile Phone: ' || {_opt(4, 1, PHONE + ' || ' + chr(39) + ', (212) 555-0000' + chr(39))}", f"'• Corporate Phone: ' || {_opt(4, 2, chr(39) + '+1-303-555-0101' + chr(39))}",
    "'• Support Phone: Not found'", f"'• Company Phone: ' || {PHONE}", f"'• Email: info' || {k} || '@example.com'", f"'• Address: ' || {ADDRESS}", "'• Company City: Springfield'", "'• Company State: CA'", "''",
    f"'📍 Maps Integration Status: ' || {_opt(5, 2, chr(39) + 'Integrated' + chr(39))}", "'🔍 Total Google Maps Links Found: 2'",
    f"'🎯 Primary Google Maps Link: ' || {_opt(4, 3, chr(39) + 'https://maps.google.com/' + chr(39) + ' || ' + k)}", "''", "'📋 Complete Google Maps Discovery:'",
    f"CASE WHEN s_suppkey % 4 = 3 THEN '  No Google Maps links discovered across entire website' ELSE '  1. https://maps.google.com/' || {k} || chr(10) || '  2. https://goo.gl/maps/' || {k} END", "''",
    "'• Direct Links: 1 found'", "'• Iframe Embeds: 0 found'", "'• JavaScript Maps: 1 found'", "'• Structured Data Maps: 0 found'", "'• Contact Page Maps: 2 found'", "''",
    f"'• Facebook: https://facebook.com/' || {k}", "'• Instagram: Not found'", f"'• TikTok: tiktok.com/@' || {k}", "'• LinkedIn: Not found'", "'• Twitter: Not found'", "'• Pinterest: Not found'", "'• YouTube: Not found'",
    f"'• Employees: ' || {k} || '-500'", "'• Annual Revenue: $5'", "'• Segmentation: High-End (Budget Classification)'", f"'• Firmographic Score: ' || CAST(s_suppkey % 101 AS STRING) || '/100'", "'• Engagement Score: 55/100'",
    "'• Digital Presence Strength: Basic'", "'• Contact Accessibility: Good'", f"'• Instagram Handle: @h' || {k}", "'• IG Score: 33/100'", f"'• Worked With Creators: ' || {_mark(3)}", "'• Integrated Video Links: 1 found'", "''",
    "'📹 Video Content:'", f"CASE WHEN s_suppkey % 2 = 0 THEN '  1. https://vimeo.com/' || {k} || chr(10) || '  2. https://youtu.be/' || {k} ELSE '  No video content found' END", "''",
    "'• 4 Minimum Price Products:'", f"CASE WHEN s_suppkey % 3 = 2 THEN '  No minimum price products found.' ELSE '  • Thing (big) ' || {k} || ' ($' || {k} || '.50) - https://s.example.com/p' || {k} || chr(10) || '  • Other (EUR7.25) - https://s.example.com/q' END",
    "'• 4 Maximum Price Products:'", f"CASE WHEN s_suppkey % 3 = 2 THEN '  No maximum price products found.' ELSE '  • Best ' || {k} || ' (€99.00) - https://s.example.com/b' END", "''", RULE,
] + [f"'{K.REPORT_FIELDS[f][0]}: ' || {_mark(i + 2)}" for i, f in enumerate(K.BOOLEAN_REPORT_FIELDS[:10])] + [
    f"'• SSL Secure: ' || {_mark(2)}", "'• Mobile Responsive: maybe'", "'• Internal Links: 10'", "'• External Links: 3'", "'• Social Media Links: 2'", "'• Contact-Related Links: 1'", "''",
    "'🔍 Complete Website Mapping Results:'", f"'This analysis saw ' || {k} || ' pages'", "'over many levels.'", "''", "'🗺️ more'", RULE, "'🎯 ENHANCED ANALYSIS NOTES FOR SDR'", RULE, "''", "'📊 Key Insights:'",
    f"'• First note ' || {k}", "'• Second note'", "''", "'end'",
]
REPORTS_SQL = f"SELECT 'site' || {k} AS folder, array_to_string_placeholder AS content FROM supplier".replace(
    "array_to_string_placeholder", " || chr(10) || ".join(f"({line})" for line in LINES))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return TB.derived(spark, sf, REPORTS_SQL, "supplier")


def drop_fillers(x: str) -> str:
    return O.strip(f"replace(replace({x}, 'Not found', ''), 'Unknown', '')")


def field(name: str) -> str:
    label, tail = K.REPORT_FIELDS[name]
    return drop_fillers(O.strip(f"regexp_extract(content, '(?im){label}:{tail}', 1)"))


def block(p: str, g: int = 1) -> str:
    return f"regexp_extract(content, '(?s){p}', {g})"


BASE = f"WITH r AS ({REPORTS_SQL})"
RC1_FIELDS = list(K.REPORT_FIELDS)


@check("rc1_sections", BASE + " SELECT folder, " + ", ".join(f"{field(n)} AS {n}" for n in RC1_FIELDS) + " FROM r")
def rc1(spark, sf):
    return reports(spark, sf).select("folder", *[CP.section_field(n) for n in RC1_FIELDS])


DOMAIN = rf"coalesce(nullif({drop_fillers(O.strip(chr(39).join(['regexp_extract(content, ', r'Domain:\s*(.+?)(?:\n|$)', ', 1)'])))}, ''), folder)"
DATE = O.strip(r"regexp_extract(content, 'Generated:\s*(.+?)(?:\n|$)', 1)")


@check("rc2_domain_and_date", BASE + f" SELECT folder, {DOMAIN} AS domain, {DATE} AS analysis_date FROM r")
def rc2(spark, sf):
    return reports(spark, sf).select("folder", CP.domain(), CP.analysis_date())


ABOUT = f"substr({O.collapse(O.strip(block(chr(92).join(['About Us Text:', 's*', 'n(.*?)(?:', 'n', 'n|', 'n=|📇 CONTACT INFORMATION)']))))}, 1, 2000)"
MAP_LINKS = rf"regexp_extract_all({block(r'📋 Complete Google Maps Discovery:(.*?)(?:\n\n|\n🔍)')}, '\d+\.\s*(https?://\S+)', 1)"
PRIMARY = O.strip(r"regexp_extract(content, '🎯 Primary Google Maps Link:\s*(.+?)(?:\n|$)', 1)")
VIDEO = rf"array_to_string(regexp_extract_all({block(r'📹 Video Content:(.*?)(?:\n\n|\n=)')}, 'https?://\S+'), '; ')"
NOTES = O.strip(block(r"🎯 ENHANCED ANALYSIS NOTES FOR SDR\s*\n=+\s*\n(.*?)(?:\n\n|\n=)"))
NOTES = rf"substr(regexp_replace(regexp_replace({NOTES}, '\n\s*[•·]\s*', ' | ', 'g'), '\n\s*', ' ', 'g'), 1, 1000)"
DISCOVERY = rf"substr(regexp_replace({O.strip(block(r'🔍 Complete Website Mapping Results:(.*?)(?:\n\n|\n🗺️)'))}, '\n\s*', ' ', 'g'), 1, 500)"


@check("rc3_about_text", BASE + f" SELECT folder, {ABOUT} AS about_us_text FROM r")
def rc3(spark, sf):
    return reports(spark, sf).select("folder", CP.about_text())


@check("rc4_rc5_map_links", BASE + f" SELECT folder, array_to_string({MAP_LINKS}, '; ') AS links, CAST(len({MAP_LINKS}) AS BIGINT) AS n, CASE WHEN {PRIMARY} = 'Not found' THEN '' ELSE {PRIMARY} END AS google_map FROM r")
def rc4(spark, sf):
    return reports(spark, sf).select("folder", F.array_join(CP.map_links(), "; ").alias("links"), F.size(CP.map_links()).cast("bigint").alias("n"), CP.primary_map())


@check("rc6_video_links", BASE + f" SELECT folder, {VIDEO} AS video_links FROM r")
def rc6(spark, sf):
    return reports(spark, sf).select("folder", CP.video_links())


@check("rc7_rc9_notes_and_discovery", BASE + f" SELECT folder, {NOTES} AS notes_for_sdr, {DISCOVERY} AS discovery_summary FROM r")
def rc7(spark, sf):
    return reports(spark, sf).select("folder", CP.sales_notes(), CP.discovery_summary())


SHORT = """CASE WHEN length(m) > 20 THEN substr(m, 1, 200) WHEN length(a) > 20 THEN CASE WHEN length(split_part(a, '.', 1)) > 20 AND length(split_part(a, '.', 1)) < 200 THEN split_part(a, '.', 1) || '.'
  ELSE substr(a, 1, 200) || '...' END ELSE '' END"""


@check("rc8_short_description", BASE + f" SELECT folder, {SHORT} AS short_description FROM (SELECT folder, {ABOUT} AS a, {field('meta_description')} AS m FROM r) x")
def rc8(spark, sf):
    return reports(spark, sf).select("folder", CP.about_text(), CP.section_field("meta_description")).select("folder", CP.short_description())


def items(side: str) -> str:
    p = r"• 4 Minimum Price Products:\s*\n(.*?)\n• 4 Maximum Price Products:" if side == "min" else r"• 4 Maximum Price Products:\s*\n(.*?)(?:\n\n|\n=)"
    return f"string_split({block(p)}, chr(10))"


LINE = r"•\s*(.+?)\s*\(([^\d\n]*?)([\d.]+)\)\s*-\s*(https?://\S+)"
ITEMS = BASE + ", i AS (" + " UNION ALL ".join(
    f"SELECT folder, '{s}' AS side, unnest({items(s)}) AS l, generate_subscripts({items(s)}, 1) AS n FROM r" for s in ("min", "max")) + rf"""),
p AS (SELECT folder, side, row_number() OVER (PARTITION BY folder, side ORDER BY n) AS rank, regexp_extract(l, '{LINE}', 1) AS name, regexp_extract(l, '{LINE}', 2) AS currency,
  TRY_CAST(regexp_extract(l, '{LINE}', 3) AS DOUBLE) AS price, regexp_extract(l, '{LINE}', 4) AS url FROM i WHERE regexp_matches(l, '{LINE}'))"""


@check("rc10_product_lines", ITEMS + " SELECT * FROM p")
def rc10(spark, sf):
    rows = reports(spark, sf)
    one = lambda s: rows.select("folder", F.lit(s).alias("side"), F.posexplode(CP.product_items(s)).alias("pos", "i")).select(
        "folder", "side", (F.col("pos") + 1).cast("bigint").alias("rank"), "i.*")
    return one("min").unionByName(one("max"))


@check("rc11_product_columns", ITEMS + " SELECT r.folder, " + ", ".join(
    f"coalesce(max(CAST({c} AS VARCHAR)) FILTER (side = '{s}' AND rank = {i}), '') AS {s}_price_product_{i}_{c}" for s in ("min", "max") for i in (1, 2, 3, 4) for c in ("name", "price", "url"))
    + " FROM r LEFT JOIN p USING (folder) GROUP BY 1")
def rc11(spark, sf):
    rows = reports(spark, sf).select("folder", CP.product_items("min").alias("min_items"), CP.product_items("max").alias("max_items"))
    return rows.select("folder", *CP.product_columns())


def url_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' OR starts_with({x}, 'http') THEN {x} WHEN starts_with({x}, '//') THEN 'https:' || {x} ELSE 'https://' || {x} END"


@check("rc12_rc13_rc14_cleaned_fields", BASE + f""" SELECT folder, {url_sql(field('logo_url'))} AS logo_url, {url_sql(field('favicon_url'))} AS favicon_url, {url_sql(field('tiktok_url'))} AS tiktok_url,
  regexp_replace({field('total_word_count')}, '[^0-9.]', '', 'g') AS total_word_count, trim(split_part({field('mobile_phone')}, ',', 1)) AS mobile_phone,
  CASE WHEN {field('worked_with_creators')} = '✅ Yes' THEN 'True' ELSE 'False' END AS worked_with_creators,
  {O.strip(f"replace({drop_fillers(ABOUT)}, 'No about us information found', '')")} AS about_us_text FROM r""")
def rc12(spark, sf):
    return CP.parse_reports(reports(spark, sf)).select("folder", "logo_url", "favicon_url", "tiktok_url", "total_word_count", "mobile_phone", "worked_with_creators", "about_us_text")


US, INTL, SIMPLE = K.US_ADDRESS, K.INTL_ADDRESS, K.SIMPLE_ADDRESS
STATES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in K.US_STATES.items()) + "}"
LANDS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in K.COUNTRIES.items()) + "}"


def _g(p: str, i: int) -> str:
    return f"trim(regexp_extract(a, '{p}', {i}))"


@check("rc15_rc16_address_parts", f"""WITH r AS (SELECT s_suppkey, {ADDRESS} AS a FROM supplier), m AS (SELECT *, {STATES} AS st, {LANDS} AS la FROM r)
SELECT s_suppkey, CASE WHEN regexp_matches(a, '{US}') THEN {_g(US, 2)} WHEN regexp_matches(a, '{INTL}') THEN {_g(INTL, 2)} WHEN regexp_matches(a, '{SIMPLE}') THEN {_g(SIMPLE, 1)} ELSE '' END AS city,
  CASE WHEN regexp_matches(a, '{US}') THEN coalesce(st[{_g(US, 3)}], '') WHEN regexp_matches(a, '{INTL}') THEN {_g(INTL, 3)}
    WHEN regexp_matches(a, '{SIMPLE}') THEN coalesce(st[upper({_g(SIMPLE, 2)})], CASE WHEN la[lower({_g(SIMPLE, 2)})] IS NULL THEN {_g(SIMPLE, 2)} ELSE '' END) ELSE '' END AS state,
  CASE WHEN regexp_matches(a, '{US}') THEN CASE WHEN st[{_g(US, 3)}] IS NULL THEN '' ELSE 'United States' END WHEN regexp_matches(a, '{INTL}') THEN coalesce(la[lower({_g(INTL, 4)})], {_g(INTL, 4)})
    WHEN regexp_matches(a, '{SIMPLE}') THEN CASE WHEN st[upper({_g(SIMPLE, 2)})] IS NOT NULL THEN 'United States' ELSE coalesce(la[lower({_g(SIMPLE, 2)})], '') END ELSE '' END AS country FROM m""")
def rc15(spark, sf):
    rows = TB.derived(spark, sf, f"SELECT s_suppkey, {ADDRESS} AS a FROM supplier", "supplier")
    return rows.select("s_suppkey", CP.address_parts(F.col("a")).alias("p")).select("s_suppkey", "p.*")


FLAGS = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '✅ Yes' WHEN 1 THEN '❌ No' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' WHEN 4 THEN '1' WHEN 5 THEN 'yes' WHEN 6 THEN '' WHEN 7 THEN p_name ELSE 'False' END AS v FROM part"


@check("rc17_booleans", f"SELECT p_partkey, CASE WHEN lower(v) IN ('true', '✅ yes', 'yes', '1') THEN 'True' ELSE 'False' END AS flag FROM ({FLAGS}) x")
def rc17(spark, sf):
    return TB.derived(spark, sf, FLAGS, "part").select("p_partkey", CP.to_boolean(F.col("v")).alias("flag"))


@check("rc18_maps_status", BASE + f""" SELECT folder, CASE WHEN {field('google_maps_integration_status')} <> '' THEN {field('google_maps_integration_status')}
  WHEN {field('primary_google_maps_link')} <> '' OR len({MAP_LINKS}) > 0 THEN 'Integrated' ELSE 'Not Found' END AS status FROM r""")
def rc18(spark, sf):
    rows = reports(spark, sf).select("folder", CP.section_field("google_maps_integration_status"), CP.section_field("primary_google_maps_link"), F.array_join(CP.map_links(), "; ").alias("every"))
    return rows.select("folder", CP.maps_status(F.col("google_maps_integration_status"), F.col("primary_google_maps_link"), F.col("every")).alias("status"))


@check("rc19_rc20_snk6_compiled_rows", BASE + f""" SELECT {DOMAIN} AS domain, {field('company_name')} AS company_name, {O.collapse(field('site_title'))} AS site_title, {O.collapse(field('meta_description'))} AS meta_description,
  {field('keywords_compilation')} AS keywords, '{K.REPORT_STATUS}' AS status, regexp_replace({field('total_word_count')}, '[^0-9.]', '', 'g') AS total_word_count, {field('avg_load_time')} AS avg_load_time,
  array_to_string({MAP_LINKS}, '; ') AS all_google_maps_links, CAST(len({MAP_LINKS}) AS VARCHAR) AS google_maps_links_count, {VIDEO} AS video_links, CASE WHEN {field('ssl_secure')} = '✅ Yes' THEN 'True' ELSE 'False' END AS ssl_secure,
  'False' AS mobile_responsive, {field('segmentation')} AS segmentation, {field('firmographic_score')} AS firmographic_score FROM r""")
def rc19(spark, sf):
    return CP.compile_reports(reports(spark, sf)).select(
        "domain", "company_name", "site_title", "meta_description", "keywords", "status", "total_word_count", "avg_load_time", "all_google_maps_links",
        "google_maps_links_count", "video_links", "ssl_secure", "mobile_responsive", "segmentation", "firmographic_score")


MESSY = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CAST(NULL AS STRING) ELSE '  ' || text || chr(13) || chr(10) || ' ' END AS v FROM documents"


@check("rc20_sanitised_values", f"SELECT doc_id, coalesce({O.strip(O.collapse('v'))}, '') AS v FROM ({MESSY}) x")
def rc20(spark, sf):
    return TB.derived(spark, sf, MESSY, "documents").select("doc_id", CP.sanitise(F.col("v")).alias("v"))


# what the compiler does to a column, spelled out here
NUMBERS = set("""contact_page_maps_found direct_maps_links_found engagement_score firmographic_score google_maps_links_count iframe_maps_embeds_found ig_score
  integrated_video_links_count javascript_maps_found structured_data_maps_found total_google_maps_found total_links_found total_pages_discovered total_word_count""".split())
PROSE = {"about_us_text", "discovery_summary", "notes_for_sdr", "short_description"}
FLAG_COLUMNS = set("""d2c_presence ecommerce_presence social_media_presence video_presence saas_platform blog_presence cta_presence product_listings contact_forms
  newsletter_signup ssl_secure mobile_responsive worked_with_creators""".split())
PLACE = {"address_city": "city", "address_state": "state", "address_country": "country"}


def cleaned(name: str, x: str) -> str:
    x = drop_fillers(x)
    x = f"CASE {x} WHEN '✅ Yes' THEN 'True' WHEN '❌ No' THEN 'False' ELSE {x} END"
    if "phone" in name:
        x = O.strip(f"split_part({O.collapse(x)}, ',', 1)")
    if "url" in name:
        x = url_sql(f"({x})")
    if name in NUMBERS:
        x = f"regexp_replace({x}, '[^0-9.]', '', 'g')"
    if name in PROSE:
        x = O.collapse(O.strip(x))
        for phrase in ("No information available", "No about us information found"):
            x = O.strip(f"replace({x}, '{phrase}', '')")
    return x


def compiled(name: str) -> str:
    if name in PLACE:
        x = f"place.{PLACE[name]}"
    elif name == "keywords":
        x = "c.keywords_compilation"
    elif name == "status":
        x = f"'{K.REPORT_STATUS}'"
    elif name == "google_maps_integration_status":
        x = ("CASE WHEN c.google_maps_integration_status <> '' THEN c.google_maps_integration_status "
             "WHEN c.primary_google_maps_link <> '' OR c.all_google_maps_links <> '' THEN 'Integrated' ELSE 'Not Found' END")
    elif name in FLAG_COLUMNS:
        x = f"CASE WHEN lower(c.{name}) IN ('true', '✅ yes', 'yes', '1') THEN 'True' ELSE 'False' END"
    else:
        x = f"c.{name}"
    return O.strip(O.collapse(f"coalesce({x}, '')"))


def _rc(name: str) -> str:
    return f"({CHECKS[name][1]})"


DERIVED = ["domain", "analysis_date", "about_us_text", "all_google_maps_links", "google_maps_links_count", "video_links", "notes_for_sdr", "discovery_summary",
           "short_description"]
PRICES = [f"{s}_price_product_{i}_{c}" for s in ("min", "max") for i in (1, 2, 3, 4) for c in ("name", "price", "url")]
ALL_SQL = f"""WITH f AS {_rc('rc1_sections')}, dd AS {_rc('rc2_domain_and_date')}, ab AS {_rc('rc3_about_text')},
ml AS (SELECT folder, links AS all_google_maps_links, CAST(n AS VARCHAR) AS google_maps_links_count FROM {_rc('rc4_rc5_map_links')} x),
v AS {_rc('rc6_video_links')}, nd AS {_rc('rc7_rc9_notes_and_discovery')}, sd AS {_rc('rc8_short_description')}, pc AS {_rc('rc11_product_columns')},
ad AS (SELECT 'site' || {k} AS folder, p.* FROM supplier JOIN {_rc('rc15_rc16_address_parts')} p USING (s_suppkey)),
w AS (SELECT * FROM f JOIN dd USING (folder) JOIN ab USING (folder) JOIN ml USING (folder) JOIN v USING (folder) JOIN nd USING (folder) JOIN sd USING (folder) JOIN pc USING (folder)),
c AS (SELECT folder, {', '.join(f'{cleaned(n, n)} AS {n}' for n in [*RC1_FIELDS, *DERIVED, *PRICES])} FROM w)
SELECT {', '.join(f'{compiled(n)} AS {n}' for n in K.COMPILED_COLUMNS)} FROM c JOIN ad AS place USING (folder)"""


@check("rc_all_compiled_columns", ALL_SQL)
def rc_all(spark, sf):
    return CP.compile_reports(reports(spark, sf))


# --- streams -------------------------------------------------------------------------------------

STREAM_SCHEMA = "page_id bigint, url string, html string"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The page table as a stream, whether it is one file or a folder of files: a pattern may stand for either, a plain path only for a folder."""
    return spark.readStream.schema(STREAM_SCHEMA).parquet(f"{sf}/pages.parque[t]")


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


@check("st1_each_url_once", "SELECT DISTINCT url FROM pages")
def st1(spark, sf):
    out = _folder(spark)
    fresh = intake.each_url_once(_stream(spark, sf)).select("url")
    fresh.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url string").parquet(f"{out}/data")


@check("st2_running_link_counts", O.WITH + " SELECT site_id, link_type, count(*) AS links FROM links WHERE page_id IN (SELECT page_id FROM pages) GROUP BY 1, 2")
def st2(spark, sf):
    out = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    counts = intake.running_link_counts(_stream(spark, sf))
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("site_id string, link_type string, links bigint").parquet(f"{out}/data")
