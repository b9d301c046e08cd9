"""Word lists, patterns, thresholds and labels.

Everything in this module must have exactly these values for results to be
right, so it is stated as plain data.  Patterns are written once and used by
Spark (Java regex); ``WS`` and the simple ones are also valid RE2.
"""

# --- fixed values: limits -------------------------------------------------
MIN_HTML_LENGTH = 1000
MAX_PAGES_PER_SITE = 1000
MAX_CRAWL_DEPTH = 45
TERMINAL_STATUS = [403, 404, 500, 503]
RETRYABLE_STATUS = [429, 500, 502, 503, 504]

# --- fixed values: white space as str.strip() and re \s see it -------------
WS = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# the same signs, one by one
WS_SIGNS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: page errors ----------------------------------------------
ERROR_PHRASES = [
    "520: Web server is returning an unknown error",
    "Just a moment...",
    "Not Found",
    "Access Denied",
    "Service Unavailable",
    "Cloudflare",
    "captcha",
    "security check",
    "Page Not Found",
    "404 Error",
    "503 Service Unavailable",
]
# all-lower-case patterns, the only ones that can hit lower-cased html
EFFECTIVE_ERROR_PHRASES = ["captcha", "security check"]

# --- fixed values: page types by url keyword ---------------------------------
PAGE_TYPES = [
    ("about", ["about", "story", "company"]),
    ("contact", ["contact", "reach", "touch"]),
    ("product", ["product", "service", "solution"]),
    ("blog", ["blog", "news", "article"]),
    ("team", ["team", "staff", "people"]),
]
ABOUT_URL_KEYWORDS = [
    "about", "about-us", "about_us", "aboutus", "story", "our-story",
    "company", "history", "mission", "vision", "team", "who-we-are",
    "our-company", "background", "overview", "profile",
]
ABOUT_TEXT_PHRASES = ["about us", "our story", "our company", "who we are", "our mission"]

# --- fixed values: links -----------------------------------------------------
EXCLUDED_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".tar", ".gz", ".jpg", ".jpeg", ".png",
    ".gif", ".webp", ".svg", ".mp4", ".avi", ".mov", ".mp3",
]
DISCOVERY_SOCIAL = [
    "facebook.com", "instagram.com", "twitter.com", "x.com",
    "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com",
]
DISCOVERY_CONTACT_KEYWORDS = [
    "contact", "about", "team", "staff", "location", "office",
    "reach", "touch", "support", "help", "customer-service",
]
CLICKABLE_SOCIAL = [
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "pinterest.com", "tumblr.com", "reddit.com",
    "snapchat.com", "whatsapp.com", "t.me", "weibo.com", "vk.com",
]
CLICKABLE_CONTACT_KEYWORDS = [
    "contact", "call us", "call", "reach us", "reach", "email", "phone", "tel", "mail", "contact us",
]
CLICKABLE_ABOUT_KEYWORDS = [
    "about", "about us", "about the company", "about our",
    "who we are", "our story", "our team", "about the team",
]
NAV_INDICATORS = ["nav", "menu", "header", "navbar", "navigation"]
FOOTER_INDICATORS = ["footer", "bottom", "copyright"]
CONTEXT_TAGS = ["p", "div", "li", "section", "article", "main", "header", "footer"]
MENU_CLASS_PATTERNS = [
    ("header", r"header|top[-_]?menu|main[-_]?nav|primary[-_]?menu|menu[-_]?primary[-_]?navigation"
               r"|genesis[-_]?nav[-_]?menu|slideout[-_]?menu[-_]?toggle"),
    ("footer", r"footer|bottom[-_]?menu"),
    ("dropdown", r"drop[-_]?down|has[-_]?children|sub[-_]?menu|child[-_]?menu"),
    ("subdropdown", r"sub[-_]?dropdown|grandchild|sub-sub"),
    ("mobile", r"mobile[-_]?menu"),
    ("quicklinks", r"quick[-_]?links"),
]
COMPLEXITY_TIERS = [(50, "Complex"), (20, "Moderate"), (6, "Simple"), (0, "Basic")]

# --- fixed values: maps ------------------------------------------------------
MAP_HOSTS = ["maps.google.com", "google.com/maps", "goo.gl/maps", "maps.app.goo.gl"]
MAP_IFRAME_HOSTS = ["maps.google.com", "google.com/maps"]
# each of the two lists' entries holds one of these, which lie in one segment of a URL
MAP_TOKENS = ["google.com", "goo.gl"]
MAP_SCRIPT_PATTERNS = [
    r"""https?://(?:www\.)?google\.com/maps[^\s"'<>]*""",
    r"""https?://(?:www\.)?maps\.google\.com[^\s"'<>]*""",
    r"""https?://goo\.gl/maps/[^\s"'<>]*""",
    r"""https?://maps\.app\.goo\.gl/[^\s"'<>]*""",
]
MAP_PRIORITY = [
    "maps.google.com/place/", "google.com/maps/place/",
    "maps.google.com/dir/", "google.com/maps/dir/",
    "maps.google.com", "google.com/maps",
]
ADDRESS_KEYS = ["streetAddress", "addressLocality", "addressRegion", "postalCode"]

# --- fixed values: contact ---------------------------------------------------
PHONE_CORE = r"[2-9]\d{2}[-.\s]?[2-9]\d{2}[-.\s]?\d{4}"
PHONE = rf"(\+?1?[-.\s]?{PHONE_CORE})"
PHONE_LABELS = {
    "mobile": ["mobile", "cell"],
    "corporate": ["corporate", "headquarters", "main"],
    "support": ["support", r"customer\s*service", "help"],
}
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
EMAIL_VALID = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
EMAIL_ASSET_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".css", ".js"]
ADDRESS_PATTERNS = [
    r"\b(\d{1,5}\s[\w\s]{3,30},\s*[\w\s]{3,20},\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?)\b",
    r"\b(\d{1,5}\s[\w\s]{3,30},?\s*[\w\s]{3,20},?\s*[A-Za-z]{2,15}\s*\d{5,10})\b",
]
CITY_STATE = r"([^,]+),\s*([A-Z]{2})\s*\d{5}"
SOCIAL_PLATFORMS = [
    ("facebook.com", "facebook"), ("instagram.com", "instagram"), ("tiktok.com", "tiktok"),
    ("linkedin.com", "linkedin"), ("twitter.com", "twitter"), ("x.com", "twitter"),
    ("pinterest.com", "pinterest"), ("youtube.com", "youtube"),
]
SOCIAL_NAMES = ["facebook", "instagram", "tiktok", "linkedin", "twitter", "pinterest", "youtube"]
BRAND_TITLE_PATTERNS = [
    r"(.+?)\s*[-–—|:]\s*(.+?)(?: Co\.| Inc\.| Ltd\.| LLC\.| Corp\.| Group)?$",
    r"(.+?)\s*[-–—|:]\s*(.+?)$",
    r"^(.*?)\s*(?:Co\.|Inc\.|Ltd\.|LLC\.|Corp\.|Group)\b",
    r"^(.*?)\s*-\s*Official Site$",
    r"^(.*?)\s*\|\s*Official Site$",
    r"^(.*?)\s*\|\s*Home$",
    r"^(.*?)\s*\|\s*Products$",
    r"^(.*?)\s*\|\s*Services$",
    r"^(.*?)\s*\|\s*Shop$",
]
PRODUCT_WORDS = ["product", "item", "shop", "store", "cream", "serum", "solution", "collection"]
TITLE_SEPARATORS = [" | ", " - ", " :: ", " — "]

# --- fixed values: business --------------------------------------------------
INDUSTRY_KEYWORDS = {
    "Technology / SaaS": [
        "software", "saas", "platform", "api", "cloud", "tech", "digital", "app", "application",
        "system", "solution", "automation", "ai", "artificial intelligence", "machine learning",
        "big data", "analytics", "cybersecurity"],
    "E-commerce / Retail": [
        "ecommerce", "retail", "shop", "store", "marketplace", "selling", "products", "merchandise",
        "commerce", "shopping", "dropshipping", "fashion", "clothing", "apparel", "accessories"],
    "Marketing / Advertising": [
        "marketing", "advertising", "campaign", "brand", "promotion", "social media", "influencer",
        "content", "ugc", "creator", "seo", "ppc", "branding", "public relations", "communications"],
    "Healthcare / Medical": [
        "healthcare", "medical", "health", "clinic", "hospital", "doctor", "patient", "treatment",
        "therapy", "nurse", "surgery", "pharmacy", "dentist", "mental health"],
    "Financial Services": [
        "finance", "banking", "investment", "insurance", "loan", "credit", "payment", "fintech",
        "trading", "accounting", "tax"],
    "Education / Training": [
        "education", "training", "course", "learning", "school", "university", "academy", "tutorial",
        "certification", "elearning", "edtech"],
    "Beauty / Skincare": [
        "skincare", "beauty", "cosmetics", "makeup", "wellness", "personal care", "dermatology",
        "skin health", "hair care", "fragrance", "spa", "salon", "nail", "esthetician"],
    "Food & Beverage / Restaurant": [
        "restaurant", "dining", "cafe", "coffee", "tea", "bakery", "bar", "pub", "bistro", "pizzeria",
        "fast food", "takeout", "food truck", "catering", "menu", "chef", "kitchen"],
    "Hospitality / Travel": [
        "hotel", "resort", "hostel", "airbnb", "vacation rental", "travel", "tourism", "tours", "guide",
        "hospitality", "accommodation", "lodging", "guesthouse", "cruise", "booking"],
    "Fitness / Sports": [
        "fitness", "gym", "workout", "yoga", "pilates", "exercise", "training", "personal trainer",
        "sports", "athletics", "bodybuilding", "martial arts", "crossfit"],
    "Real Estate": [
        "real estate", "property", "housing", "apartment", "condo", "broker", "realtor", "mortgage",
        "land", "estate agent", "rental"],
}
# the older, shorter dictionary of six industries
SHORT_INDUSTRY_KEYWORDS = {
    "Technology / SaaS": [
        "software", "saas", "platform", "api", "cloud", "tech", "digital", "app", "application", "system",
        "solution", "automation"
    ],
    "E-commerce / Retail": [
        "ecommerce", "retail", "shop", "store", "marketplace", "selling", "products", "merchandise",
        "commerce", "shopping"
    ],
    "Marketing / Advertising": [
        "marketing", "advertising", "campaign", "brand", "promotion", "social media", "influencer",
        "content", "ugc", "creator"
    ],
    "Healthcare / Medical": [
        "healthcare", "medical", "health", "clinic", "hospital", "doctor", "patient", "treatment", "therapy"
    ],
    "Financial Services": [
        "finance", "banking", "investment", "insurance", "loan", "credit", "payment", "fintech", "trading"
    ],
    "Education / Training": [
        "education", "training", "course", "learning", "school", "university", "academy", "tutorial",
        "certification"
    ],
}
BUDGET_KEYWORDS = {
    "High-End": ["enterprise", "premium", "luxury", "high-end", "exclusive", "custom", "bespoke",
                 "white-glove", "concierge"],
    "Mid-Budget": ["professional", "business", "standard", "pro", "plus", "advanced", "growth", "scale", "team"],
    "Low-End": ["basic", "starter", "free", "budget", "affordable", "small business", "individual",
                "personal", "lite"],
}
EMPLOYEE_PATTERNS = [
    r"(\d+)[-\s]*(\d+)?\s*employees?",
    r"team\s*of\s*(\d+)",
    r"(\d+)\s*people",
    r"staff\s*of\s*(\d+)",
    r"(\d+)\s*members?",
]
# each of the patterns above holds one of these
EMPLOYEE_WORDS = ["employee", "team", "people", "staff", "member"]
REVENUE_PATTERNS = [
    r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)\s*(?:million|M|billion|B)",
    r"revenue[:\s]*\$(\d+(?:,\d{3})*(?:\.\d{2})?)\s*(?:million|M|billion|B)?",
    r"annual\s*revenue[:\s]*\$(\d+(?:,\d{3})*(?:\.\d{2})?)",
]
FOUNDED_PATTERNS = [
    r"founded\s*(?:in\s*)?(\d{4})",
    r"established\s*(?:in\s*)?(\d{4})",
    r"since\s*(\d{4})",
    r"started\s*(?:in\s*)?(\d{4})",
]
MICRODATA_PRODUCT = "http://schema.org/Product"
CARD_CLASSES = ["product-card", "product-item", "grid__item"]
CARD_TITLE_CLASSES = ["product-title", "product__title", "product-card__title"]
CARD_TITLE_TAGS = ["h2", "h3"]
CARD_PRICE_CLASSES = ["product-price", "price__regular", "price-item--regular"]
CURRENCY_SYMBOLS = "[$€£¥]"

# --- fixed values: marketing and features --------------------------------------
CREATOR_KEYWORDS = [
    "influencer", "creator", "collaboration", "partnership",
    "sponsored", "brand ambassador", "ugc", "user generated",
]
VIDEO_EMBED_PLATFORMS = ["youtube", "vimeo", "tiktok", "instagram"]
VIDEO_ANCHOR_PARTS = ["youtube.com/watch", "vimeo.com/", "tiktok.com/"]
VIDEO_MARKERS = ["<video", "youtube.com/embed", "vimeo.com", "video-js", "tiktok.com"]
FEATURE_KEYWORDS = {
    "d2c_presence": ["d2c", "direct to consumer", "shop", "buy now", "cart", "checkout"],
    "ecommerce_presence": ["shopify", "woocommerce", "shop", "ecommerce", "online store"],
    "saas_platform": ["dashboard", "platform", "analytics", "api", "subscription"],
    "blog_presence": ["blog", "post", "article", "read more", "news"],
    "cta_presence": ["signup", "sign up", "register", "get started", "subscribe"],
    "product_listings": ["our products", "catalog", "featured items", "shop now"],
    "contact_forms": ["contact form", "get in touch", "send message", "form"],
    "newsletter_signup": ["newsletter", "subscribe", "email updates", "mailing list"],
}
SOCIAL_TEXT_KEYWORDS = ["instagram", "facebook", "tiktok", "twitter", "linkedin"]

# --- fixed values: metadata ------------------------------------------------------
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp"]
LOGO_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"]
LOGO_GENERIC_TERMS = ["placeholder", "default", "sample", "test"]
FAVICON_RELS = ["icon", "shortcut icon", "apple-touch-icon"]
ABOUT_DROP_TAGS = ["nav", "footer", "header", "aside", "script", "style"]
# selectors of the main content area: (tag, class, id), first non-null wins
CONTENT_SELECTORS = [
    ("main", None, None), ("article", None, None), (None, "content", None), (None, None, "content"),
    (None, "main-content", None), (None, "about-content", None), (None, "page-content", None),
    (None, "entry-content", None),
]
# about sections: (tag, attribute, substring)
ABOUT_SECTION_SELECTORS = [
    ("section", "id", "about"), ("div", "class", "about"),
    ("section", "class", "about"), ("div", "id", "about"),
    ("section", "id", "story"), ("div", "class", "story"),
    ("section", "id", "mission"), ("div", "class", "mission"),
    ("section", "id", "company"), ("div", "class", "company"),
]
ABOUT_UNWANTED = [
    "home", "contact us", "privacy policy", "terms of service", "copyright", "©",
    "all rights reserved", "follow us", "subscribe", "newsletter", "social media",
]

# --- fixed values: address lookup --------------------------------------------------
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
COUNTRIES = {
    "usa": "United States", "united states": "United States", "us": "United States",
    "uk": "United Kingdom", "united kingdom": "United Kingdom", "canada": "Canada", "ca": "Canada",
    "australia": "Australia", "au": "Australia", "germany": "Germany", "de": "Germany",
    "france": "France", "fr": "France", "japan": "Japan", "jp": "Japan", "india": "India", "in": "India",
    "china": "China", "cn": "China", "brazil": "Brazil", "br": "Brazil", "mexico": "Mexico", "mx": "Mexico",
}
US_ADDRESS = r"(.+),\s*([^,]+),\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)?"
INTL_ADDRESS = r"(.+),\s*([^,]+),\s*([^,]+),\s*([^,]+)"
SIMPLE_ADDRESS = r"([^,]+),\s*([^,]+)"

# --- fixed values: report labels and their line patterns --------------------------------
REPORT_LINE = r"\s*(.+?)(?:\n|$)"
REPORT_INT = r"\s*(\d+)"
REPORT_YES_NO = r"\s*(✅ Yes|❌ No)"
REPORT_PHONE = r"\s*(\+?1?[-.\s]?\(?[2-9]\d{2}\)?[-.\s]?[2-9]\d{2}[-.\s]?\d{4})"
REPORT_FIELDS = {
    "company_name": ("Company Name", REPORT_LINE),
    "industry": ("Industry", REPORT_LINE),
    "website": ("Website", REPORT_LINE),
    "founded_year": ("Founded Year", REPORT_LINE),
    "website_status": ("Website Status", REPORT_LINE),
    "total_pages_discovered": ("Total Pages Discovered", REPORT_INT),
    "total_links_found": ("Total Links Found", REPORT_INT),
    "max_crawl_depth": ("Maximum Crawl Depth", REPORT_INT),
    "website_structure_complexity": ("Website Structure Complexity", REPORT_LINE),
    "total_word_count": ("Total Word Count", r"\s*([\d,]+)"),
    "avg_load_time": ("Average Load Time", r"\s*([\d.]+)s"),
    "site_title": ("Site Title", REPORT_LINE),
    "meta_description": ("Meta Description", REPORT_LINE),
    "meta_keywords": ("Meta Keywords", REPORT_LINE),
    "keywords_compilation": ("Keywords Compilation", REPORT_LINE),
    "logo_url": ("Logo URL", REPORT_LINE),
    "favicon_url": ("Favicon URL", REPORT_LINE),
    "about_us_url": ("About Us URL", REPORT_LINE),
    "google_maps_integration_status": ("Maps Integration Status", REPORT_LINE),
    "total_google_maps_found": ("Total Google Maps Links Found", REPORT_INT),
    "primary_google_maps_link": ("Primary Google Maps Link", REPORT_LINE),
    "direct_maps_links_found": ("Direct Links", r"\s*(\d+)\s*found"),
    "iframe_maps_embeds_found": ("Iframe Embeds", r"\s*(\d+)\s*found"),
    "javascript_maps_found": ("JavaScript Maps", r"\s*(\d+)\s*found"),
    "structured_data_maps_found": ("Structured Data Maps", r"\s*(\d+)\s*found"),
    "contact_page_maps_found": ("Contact Page Maps", r"\s*(\d+)\s*found"),
    "mobile_phone": ("Mobile Phone", REPORT_PHONE),
    "corporate_phone": ("Corporate Phone", REPORT_PHONE),
    "support_phone": ("Support Phone", REPORT_PHONE),
    "company_phone": ("Company Phone", REPORT_PHONE),
    "email": ("Email", REPORT_LINE),
    "address": ("Address", REPORT_LINE),
    "company_city": ("Company City", REPORT_LINE),
    "company_state": ("Company State", REPORT_LINE),
    "facebook_url": ("Facebook", REPORT_LINE),
    "instagram_url": ("Instagram", REPORT_LINE),
    "tiktok_url": ("TikTok", REPORT_LINE),
    "linkedin_url": ("LinkedIn", REPORT_LINE),
    "twitter_url": ("Twitter", REPORT_LINE),
    "pinterest_url": ("Pinterest", REPORT_LINE),
    "youtube_url": ("YouTube", REPORT_LINE),
    "employees": ("Employees", REPORT_LINE),
    "annual_revenue": ("Annual Revenue", REPORT_LINE),
    "segmentation": ("Segmentation", r"\s*(.+?)(?:\s*\(|(?:\n|$))"),
    "firmographic_score": ("Firmographic Score", r"\s*(\d+)/100"),
    "engagement_score": ("Engagement Score", r"\s*(\d+)/100"),
    "digital_presence_strength": ("Digital Presence Strength", REPORT_LINE),
    "contact_accessibility": ("Contact Accessibility", REPORT_LINE),
    "instagram_handle": ("Instagram Handle", REPORT_LINE),
    "ig_score": ("IG Score", r"\s*(\d+)/100"),
    "worked_with_creators": ("Worked With Creators", REPORT_YES_NO),
    "integrated_video_links_count": ("Integrated Video Links", r"\s*(\d+)\s*found"),
    "d2c_presence": ("D2C Presence", REPORT_YES_NO),
    "ecommerce_presence": ("E-Commerce Presence", REPORT_YES_NO),
    "social_media_presence": ("Social Media Presence", REPORT_YES_NO),
    "video_presence": ("Integrated Videos", REPORT_YES_NO),
    "saas_platform": ("SaaS / Platform", REPORT_YES_NO),
    "blog_presence": ("Blog / Content", REPORT_YES_NO),
    "cta_presence": ("CTA Presence", REPORT_YES_NO),
    "product_listings": ("Product Listings", REPORT_YES_NO),
    "contact_forms": ("Contact Forms", REPORT_YES_NO),
    "newsletter_signup": ("Newsletter Signup", REPORT_YES_NO),
    "ssl_secure": ("SSL Secure", REPORT_YES_NO),
    "mobile_responsive": ("Mobile Responsive", REPORT_YES_NO),
    "internal_links_count": ("Internal Links", REPORT_INT),
    "external_links_count": ("External Links", REPORT_INT),
    "social_links_count": ("Social Media Links", REPORT_INT),
    "contact_links_count": ("Contact-Related Links", REPORT_INT),
}
NUMERIC_REPORT_FIELDS = [
    "total_word_count", "total_pages_discovered", "total_links_found", "total_google_maps_found",
    "google_maps_links_count", "direct_maps_links_found", "iframe_maps_embeds_found",
    "javascript_maps_found", "structured_data_maps_found", "contact_page_maps_found",
    "integrated_video_links_count", "firmographic_score", "engagement_score", "ig_score",
]
TEXT_REPORT_FIELDS = ["about_us_text", "short_description", "notes_for_sdr", "discovery_summary"]
BOOLEAN_REPORT_FIELDS = [
    "d2c_presence", "ecommerce_presence", "social_media_presence", "video_presence", "saas_platform",
    "blog_presence", "cta_presence", "product_listings", "contact_forms", "newsletter_signup",
    "ssl_secure", "mobile_responsive", "worked_with_creators",
]
REPORT_STATUS = "Active - Enhanced Analysis v3.0"
COMPILED_COLUMNS = (
    ["domain", "company_name", "industry", "website", "founded_year", "analysis_date", "website_status",
     "total_pages_discovered", "total_links_found", "max_crawl_depth", "website_structure_complexity",
     "total_word_count", "avg_load_time", "site_title", "meta_description", "meta_keywords",
     "keywords_compilation", "logo_url", "favicon_url", "about_us_url", "short_description",
     "google_maps_integration_status", "total_google_maps_found", "primary_google_maps_link",
     "all_google_maps_links", "google_maps_links_count", "direct_maps_links_found",
     "iframe_maps_embeds_found", "javascript_maps_found", "structured_data_maps_found",
     "contact_page_maps_found", "mobile_phone", "corporate_phone", "support_phone", "company_phone",
     "email", "address", "company_city", "company_state", "address_city", "address_state",
     "address_country", "facebook_url", "instagram_url", "tiktok_url", "linkedin_url", "twitter_url",
     "pinterest_url", "youtube_url", "employees", "annual_revenue", "segmentation",
     "firmographic_score", "engagement_score", "digital_presence_strength", "contact_accessibility",
     "instagram_handle", "ig_score", "worked_with_creators", "integrated_video_links_count", "video_links"]
    + [f"{side}_price_product_{i}_{part}" for side in ("min", "max") for i in (1, 2, 3, 4)
       for part in ("name", "price", "url")]
    + ["d2c_presence", "ecommerce_presence", "social_media_presence", "video_presence", "saas_platform",
       "blog_presence", "cta_presence", "product_listings", "contact_forms", "newsletter_signup",
       "ssl_secure", "mobile_responsive", "internal_links_count", "external_links_count",
       "social_links_count", "contact_links_count", "about_us_text", "keywords", "notes_for_sdr",
       "discovery_summary", "status"]
)

# fixed value: an attribute that may name an about section
ABOUT_MARKER = r"""(?:id|class)\s*=\s*["'][^"']*(?:about|story|mission|company)"""

# --- fixed values: blocks and lines of a text report, and its filler phrases -------------
REPORT_PATTERNS = {
    "domain": r"Domain:\s*(.+?)(?:\n|\z)",
    "generated": r"Generated:\s*(.+?)(?:\n|\z)",
    "about": r"About Us Text:\s*\n(.*?)(?:\n\n|\n=|📇 CONTACT INFORMATION)",
    "maps": r"📋 Complete Google Maps Discovery:(.*?)(?:\n\n|\n🔍)",
    "map_line": r"\d+\.\s*(https?://\S+)",
    "primary_map": r"🎯 Primary Google Maps Link:\s*(.+?)(?:\n|\z)",
    "videos": r"📹 Video Content:(.*?)(?:\n\n|\n=)",
    "video_line": r"https?://\S+",
    "notes": r"🎯 ENHANCED ANALYSIS NOTES FOR SDR\s*\n=+\s*\n(.*?)(?:\n\n|\n=)",
    "discovery": r"🔍 Complete Website Mapping Results:(.*?)(?:\n\n|\n🗺️)",
    "min_products": r"• 4 Minimum Price Products:\s*\n(.*?)(?=\n• 4 Maximum Price Products:|\n\n)",
    "max_products": r"• 4 Maximum Price Products:\s*\n(.*?)(?=\n\n|\n=)",
    "product_line": r"•\s*(.+?)\s*\(([^\d\n]*?)([\d.]+)\)\s*-\s*(https?://\S+)",
}
REPORT_FILLERS = ["No information available", "No about us information found"]
