"""Whole site records against reference SQL put together from the SQL of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import page_checks, site_checks  # noqa: F401  their SQL is used here
from checks.page_checks import crawl
from checks.site_checks import FACT_ROWS, SCORES
from checks.registry import CHECKS, check
from siteweave.plans import summary as S
from siteweave.sources import sinks


def part(name: str) -> str:
    """The reference SQL of a registered query, as a table."""
    return f"({CHECKS[name][1]})"


PLATFORMS = {"Facebook": "facebook", "Instagram": "instagram", "TikTok": "tiktok", "LinkedIn": "linkedin", "Twitter": "twitter", "Pinterest": "pinterest", "YouTube": "youtube"}
FEATURES = {"D2C Presence": "d2c_presence", "E-Commerce Presence": "ecommerce_presence", "Integrated Videos (Feature)": "video_presence", "SaaS / Platform": "saas_platform",
            "Blog / Content": "blog_presence", "CTA Presence": "cta_presence", "Product Listings": "product_listings", "Contact Forms": "contact_forms",
            "Newsletter Signup": "newsletter_signup"}
PHONES = {"Mobile Phone": "mobile", "Corporate Phone": "corporate", "Support Phone": "support", "Company Phone": "general"}


def yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END"


RECORD = f"""WITH st AS {part('lk18_stored_structure')}, su AS {part('ss1_site_summary')}, mains AS (SELECT site_id, min(page_id) AS page_id FROM {part('pg19_file_names').replace('SELECT page_id, CASE', 'SELECT site_id, page_id, CASE')} x GROUP BY 1),
hd AS (SELECT m.site_id, h.* FROM mains m JOIN {part('pg4_pg5_pg6_pg15_heads')} h USING (page_id)), lo AS (SELECT m.site_id, l.logo_url FROM mains m JOIN {part('pg16_logos')} l USING (page_id)),
seg AS {part('bz14_budget_segment')}, tot AS {part('ss2_totals')}, kw AS {part('md7_keywords')},
ph AS (SELECT site_id, {', '.join(f"max(phones) FILTER (kind = '{k}') AS {k}_phone" for k in PHONES.values())} FROM {part('ct2_phones')} p GROUP BY 1),
em AS (SELECT site_id, email FROM {part('ct4_ct5_emails')} e), ad AS {part('ct7_ct8_addresses')}, mp AS {part('mp5_mp7_site_maps')},
am AS (SELECT site_id, string_agg(DISTINCT map_url, ', ' ORDER BY map_url) AS all_maps FROM {part('mp6_page_maps')} a GROUP BY 1), cm AS {part('mp6_contact_page_maps')},
soc AS {part('ct9_ct10_social_columns')}, ih AS {part('mk1_instagram_handles')}, cr AS {part('mk2_creator_sites')},
vid AS (SELECT site_id, string_agg(video_url, ', ' ORDER BY video_url) AS videos, count(*) AS video_count FROM {part('mk3_videos')} v GROUP BY 1), ft AS {part('ft1_ft3_features')}, sp AS {part('ft2_social_presence')},
f4 AS {part('ft4_main_page_features')}, lc AS {part('lk13_link_counts')},
off AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY price, name, url) AS lo, count(*) OVER (PARTITION BY site_id) AS n FROM {part('bz8_cheapest_offers')} o),
pe AS (SELECT site_id, {', '.join(f"max(CASE WHEN side = '{s}' AND rank = {i} THEN {c} END) AS {s}{i}_{c}" for s in ('min', 'max') for i in (1, 2, 3, 4) for c in ('name', 'price', 'url'))}
  FROM (SELECT site_id, name, price, url, 'min' AS side, lo AS rank FROM off WHERE lo <= 4 UNION ALL SELECT site_id, name, price, url, 'max', lo - greatest(n - 4, 0) FROM off WHERE lo > n - 4) e GROUP BY 1),
facts AS (SELECT site_id, su.main_url, facebook, instagram, tiktok, linkedin, twitter, pinterest, youtube, email, general_phone, mobile_phone, address, primary_maps_link,
  coalesce(contact_links, 0) AS contact_links, brand_name, industry, founded_year, employees, annual_revenue, su.total_words, st.total_pages, coalesce(mp.status, 'Not Found') AS maps_status,
  instagram_handle, worked_with_creators, coalesce(video_count, 0) AS video_count, complexity, coalesce(su.social_links, 0) AS social_links
  FROM su JOIN st USING (site_id) LEFT JOIN soc USING (site_id) LEFT JOIN em USING (site_id) LEFT JOIN ph USING (site_id) LEFT JOIN ad USING (site_id) LEFT JOIN mp USING (site_id)
  LEFT JOIN lc USING (site_id) LEFT JOIN ih USING (site_id) LEFT JOIN cr USING (site_id) LEFT JOIN vid USING (site_id)),
sc AS ({SCORES.replace(FACT_ROWS, 'SELECT * FROM facts')} SELECT site_id, digital_presence, contact_accessibility, firmographic_score, engagement_score, ig_score FROM s)
"""
JOINED = " FROM su JOIN st USING (site_id)" + "".join(f" LEFT JOIN {t} USING (site_id)" for t in "hd lo sc seg tot kw ph em ad mp am cm soc ih cr vid ft sp f4 pe".split())
SUMMARY_COLUMNS = {
    "Domain": "site_id", "Main URL": "su.main_url", "Analysis Date": "'2026-01-02 03:04:05'", "Company Name": "su.brand_name", "Industry": "su.industry",
    "Segmentation": "seg.segmentation", "Website Status": "su.main_status", "Founded Year": "su.founded_year", "Employees": "su.employees",
    "Annual Revenue": "su.annual_revenue", "Firmographic Score": "sc.firmographic_score", "Engagement Score": "sc.engagement_score",
    "Total Pages Discovered": "st.total_pages", "Total Links Found": "st.total_links", "Max Crawl Depth": "0", "Website Structure Complexity": "st.complexity",
    "Total Word Count": "tot.total_words", "Average Load Time (s)": "tot.avg_load_time", "Site Title": "hd.site_title", "Meta Description": "hd.meta_description",
    "Meta Keywords": "hd.meta_keywords", "Keywords Compilation": "coalesce(kw.keywords, '')", "Logo URL": "lo.logo_url", "Favicon URL": "hd.favicon_url",
    **{label: f"ph.{k}_phone" for label, k in PHONES.items()}, "Email": "em.email", "Address": "ad.address", "Company City": "ad.city", "Company State": "ad.state",
    "Google Maps Integration Status": "coalesce(mp.status, 'Not Found')", "Primary Google Maps Link": "mp.primary_maps_link", "All Google Maps Links": "coalesce(am.all_maps, '')",
    **{f"{label} URL": f"soc.{c}" for label, c in PLATFORMS.items()}, "Instagram Handle": "ih.instagram_handle", "IG Score": "sc.ig_score",
    "Worked With Creators": yes("cr.worked_with_creators"), "Integrated Video Links": "coalesce(vid.videos, '')",
    **{label: yes(f"ft.{c}") for label, c in FEATURES.items()}, "Social Media Presence (Feature)": yes("sp.social_media_presence"),
    "SSL Secure": yes("f4.ssl_secure"), "Mobile Responsive": yes("f4.mobile_responsive"),
    **{f"{s.title()} Price Product {i} {n}": f"pe.{s}{i}_{n.lower()}" for s in ("min", "max") for i in (1, 2, 3, 4) for n in ("Name", "Price", "URL")},
}
ABOUT = ("About Us URL", "About Us Text (Snippet)")


@check("ss4_snk5_summary_columns", RECORD + "SELECT " + ", ".join(f'{sql} AS "{label}"' for label, sql in SUMMARY_COLUMNS.items()) + JOINED)
def ss4_columns(spark, sf):
    """82 of the 84 columns; the two about columns have no SQL form."""
    return S.flatten(S.site_summary(crawl(spark, sf), analysis_date="2026-01-02 03:04:05")).drop(*ABOUT)


HEAD_FIELDS = {
    "domain": "site_id", "main_url": "su.main_url", "total_pages": "st.total_pages", "total_links": "st.total_links", "crawl_depth_reached": "0",
    "website_structure_complexity": "st.complexity", "direct_links": "coalesce(mp.direct_links, 0)", "iframe_embeds": "coalesce(mp.iframe_embeds, 0)",
    "javascript_maps": "coalesce(mp.javascript_maps, 0)", "structured_data_maps": "coalesce(mp.structured_data_maps, 0)",
    "contact_page_maps": "coalesce(cm.contact_page_maps, 0)", "all_maps_links": "coalesce(am.all_maps, '')", "primary_maps_link": "mp.primary_maps_link",
    "maps_integration_status": "coalesce(mp.status, 'Not Found')", "total_maps_found": "coalesce(mp.total_maps_found, 0)",
}


@check("snk1_sitemap_head_fields", RECORD + "SELECT " + ", ".join(f"CAST({sql} AS VARCHAR) AS {label}" for label, sql in HEAD_FIELDS.items()) + JOINED)
def snk1_head_fields(spark, sf):
    """The head document read back field by field."""
    head = sinks.sitemap_head(S.site_summary(crawl(spark, sf)))
    top = ["domain", "main_url", "total_pages", "total_links", "crawl_depth_reached", "website_structure_complexity"]
    info = [f for f in HEAD_FIELDS if f not in top and f != "all_maps_links"]
    every = F.array_join(F.from_json(F.get_json_object("document", "$.google_maps_info.all_maps_links"), "array<string>"), ", ")
    return head.select(*[F.get_json_object("document", f"$.{f}").alias(f) for f in top],
                       *[F.get_json_object("document", f"$.google_maps_info.{f}").alias(f) for f in info], every.alias("all_maps_links"))
