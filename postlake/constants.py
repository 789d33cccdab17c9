"""Values that must stay equal to the behaviour being matched.

Everything in this module is a fixed value: word lists, lookup tables,
thresholds and patterns.  No logic lives here.
"""

from __future__ import annotations

# --- text normalisation (fixed values) -------------------------------------

CITY_ALIASES = {
    "bengaluru": "bangalore",
    "bombay": "mumbai",
    "calcutta": "kolkata",
    "madras": "chennai",
    "new delhi": "delhi",
    "gurugram": "gurgaon",
}

TITLE_NOISE = [
    "senior", "sr.", "sr ", "junior", "jr.", "jr ",
    "lead", "staff", "principal", "associate",
    "mid-level", "mid level", "entry level", "entry-level",
    "intern", "internship", "trainee",
    "(remote)", "(hybrid)", "(on-site)", "(onsite)",
    "remote", "hybrid",
    "full time", "full-time", "part time", "part-time",
    "contract", "contractual", "freelance",
    "urgent", "immediate joiner", "immediate joining",
]

COMPANY_NOISE = [
    "private limited", "pvt. ltd.", "pvt ltd", "pvt. ltd",
    "limited", "ltd.", "ltd",
    "incorporated", "inc.", "inc",
    "corporation", "corp.", "corp",
    "technologies", "technology", "tech",
    "solutions", "services", "systems",
    "india", "global", "worldwide",
]

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "src", "source", "referrer", "clickid", "cmp", "from",
]

JOB_ID_PARAMS = ["id", "jobid", "jobId", "jk", "vjk"]

# Named entities of HTML that XML does not know (fixed values).
HTML_ENTITIES = {
    "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "euro": "€", "pound": "£", "deg": "°", "laquo": "«", "raquo": "»",
    "times": "×", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß",
    "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
}

DESCRIPTION_HASH_CHARS = 500
DESCRIPTION_MAX_CHARS = 5000

# --- page rules (fixed values) ----------------------------------------------

BLOCK_PHRASES = [
    "unusual traffic",
    "access denied",
    "blocked",
    "captcha",
    "suspicious activity",
    "let us know you're human",
    "are you a robot",
    "too many requests",
    "abuse",
    "rate limit exceeded",
    "security check",
]
BLOCK_BODY_CHARS = 3000

SITE_BLOCK_TITLE_PHRASES = {
    "cutshort": ["access denied", "blocked", "captcha"],
    "foundit": ["access denied", "robot", "captcha"],
    "shine": ["access denied", "blocked", "robot"],
    "timesjobs": ["access denied", "blocked", "captcha"],
    "wellfound": ["just a moment", "cloudflare", "robot"],
    "indeed": ["captcha", "unusual traffic", "blocked", "access denied"],
    "linkedin": ["linkedin login", "sign in to linkedin"],
}
SITE_BLOCK_URL_PARTS = {"linkedin": ["/authwall", "/login"]}

TRACKER_FRAGMENTS = [
    "google-analytics",
    "facebook.net",
    "hotjar",
    "doubleclick",
    "googlesyndication",
    "googletagmanager",
    "linkedin.com/li/track",
    "bat.bing.com",
]
HEAVY_ASSET_TYPES = ["image", "stylesheet", "font", "media"]

# Elements whose text a browser never shows.
UNSEEN_BLOCKS = ["script", "style", "noscript", "template", "svg", "iframe"]
BOILERPLATE_BLOCKS = ["script", "style", "nav", "footer", "header", "svg", "iframe"]
LOW_CAP_PROVIDERS = ["anthropic", "openai", "openai-codex", "google"]
HIGH_CAP_PROVIDERS = ["groq", "cerebras", "ollama", "lmstudio"]
LOW_CAP, DEFAULT_CAP, HIGH_CAP = 3500, 5000, 7000
MIN_BODY_CHARS, MIN_CLEAN_CHARS = 100, 50

# --- rate policies (fixed values) --------------------------------------------
# domain, max requests/min, min delay ms, jitter ms, max concurrent, risk,
# business-hours multiplier, backoff multiplier, max backoff ms, requires auth

POLICY_FIELDS = [
    "domain", "max_rpm", "min_delay_ms", "jitter_ms", "max_concurrent", "risk",
    "business_mult", "backoff_mult", "max_backoff_ms", "requires_auth",
]
RATE_POLICIES = [
    ("linkedin.com", 4, 8000, 5000, 1, "HIGH", 2.5, 3.0, 600000, False),
    ("in.linkedin.com", 4, 8000, 5000, 1, "HIGH", 2.5, 3.0, 600000, False),
    ("indeed.com", 8, 5000, 3000, 2, "MEDIUM", 1.8, 2.0, 300000, False),
    ("in.indeed.com", 10, 4000, 3000, 2, "MEDIUM", 1.5, 2.0, 300000, False),
    ("naukri.com", 10, 4000, 3500, 2, "MEDIUM", 1.6, 2.0, 480000, False),
    ("internshala.com", 15, 3000, 2000, 3, "LOW", 1.2, 1.5, 180000, False),
    ("wellfound.com", 8, 6000, 4000, 1, "MEDIUM", 1.5, 2.0, 360000, False),
    ("glassdoor.com", 5, 8000, 5000, 1, "HIGH", 2.0, 3.0, 600000, False),
    ("hackerearth.com", 15, 3000, 2000, 3, "LOW", 1.2, 1.5, 180000, False),
    ("cutshort.io", 12, 4000, 2500, 2, "LOW", 1.3, 1.5, 180000, False),
    ("instahyre.com", 10, 4500, 3000, 2, "LOW", 1.3, 1.5, 240000, False),
    ("foundit.in", 8, 3000, 2500, 1, "MEDIUM", 1.5, 2.0, 300000, False),
    ("shine.com", 12, 2500, 2000, 2, "LOW", 1.2, 1.5, 180000, False),
    ("timesjobs.com", 10, 4000, 2500, 2, "LOW", 1.2, 1.5, 240000, False),
]
DEFAULT_POLICY = ("default", 10, 5000, 3000, 2, "MEDIUM", 1.5, 2.0, 300000, False)

BACKOFF_BASE_MS = 30000
BACKOFF_JITTER_MS = 10000
MAX_BACKOFF_ATTEMPTS = 5
BUSINESS_HOURS_IST = (9, 19)
OFF_HOURS_IST = (22, 6)
IST_OFFSET_MINUTES = 330

# --- thresholds (fixed values) -------------------------------------------------

HEALTH_THRESHOLDS = {
    "success_warn_pct": 70,
    "success_crit_pct": 40,
    "no_progress_warn_min": 20,
    "no_progress_crit_min": 45,
    "memory_warn_mb": 2500,
    "memory_crit_mb": 3500,
    "rate_limit_warn": 10,
    "rate_limit_crit": 30,
    "proxy_fail_warn": 5,
    "proxy_fail_crit": 20,
    "zero_jobs_after_min": 10,
    "min_requests": 5,
}

LATENCY_SAMPLES = 100
VIOLATION_HISTORY = 200
RECENT_VIOLATIONS_SHOWN = 20
SEEN_RETENTION_DAYS = 30
REFRESH_DAYS = 7
CACHE_TTL_HOURS = 24
ALERT_COOLDOWN_MINUTES = 15
IDLE_KEY_MINUTES = 10
ARCHIVE_AFTER_DAYS = 7
DELETE_AFTER_DAYS = 90
COVERAGE_REASONS = {"enough": "skip-threshold-reached", "partial": "partial-api-collection", "none": "no-api-jobs-collected"}
COVERAGE_MIN_JOBS = 15
COVERAGE_SKIP_THRESHOLD = 25
DEFAULT_MAX_RESULTS = 50
DAILY_BUDGET_USD = 1.0

COST_PER_1M_TOKENS = {
    "anthropic": 10.0,
    "openai": 12.0,
    "google": 3.5,
    "groq": 0.27,
    "cerebras": 0.6,
    "openrouter": 5.0,
    "mistral": 8.0,
    "xai": 5.0,
    "zai": 3.0,
    "moonshot": 3.0,
    "ollama": 0.0,
    "lmstudio": 0.0,
}
DEFAULT_COST_PER_1M = 5.0

FRESHER_BANDS = ["Fresher", "0-1 years"]

# --- search frontier (fixed values) ---------------------------------------------
# site, url template, page cap, page style, page size.
# {q} form-encoded keywords, {qc} percent-encoded keywords, {slug} hyphenated
# keywords, {loc} form-encoded location, {locd} the same with a default,
# {locslug} hyphenated location, {gq} "<keywords> jobs in <location>",
# {page} and {start} the page part where it does not go to the end.

DEFAULT_LOCATION = "India"

FRONTIER_SITES = [
    ("cutshort", "https://cutshort.io/jobs?keywords={q}&experience=0-1", 5, "page", 1),
    ("foundit", "https://www.foundit.in/srp/results?query={q}&location={locd}", 5, "start", 15),
    ("shine", "https://www.shine.com/job-search/{slug}-jobs/{page}?q={qc}&experience=0", 5, "path", 1),
    ("timesjobs", "https://www.timesjobs.com/candidate/job-search.html?searchType=personalizedSearch"
                  "&from=submit&txtKeywords={q}&txtLocation={loc}&sequence={page}&startPage=1", 5, "sequence", 1),
    ("wellfound", "https://wellfound.com/jobs?search={q}&location={loc}", 1, "none", 1),
    ("indeed", "https://in.indeed.com/jobs?q={q}&l={loc}{start}&sort=date&limit=10", 10, "inner_start", 10),
    ("linkedin", "https://www.linkedin.com/jobs/search/?keywords={q}&location={loc}"
                 "&trk=public_jobs_jobs-search-bar_search-submit&position=1&pageNum=0{start}&sortBy=DD",
     4, "inner_start", 25),
    ("google", "https://www.google.com/search?q={gq}&ibp=htl%3Bjobs", 3, "start", 10),
    ("indeed_rss", "https://in.indeed.com/rss?q={q}&l={locd}&sort=date&fromage=7", 1, "none", 1),
    ("naukri", "https://www.naukri.com/{slug}-jobs-in-{locslug}", 1, "none", 1),
    ("naukri_all", "https://www.naukri.com/{slug}-jobs", 1, "none", 1),
    ("internshala", "https://internshala.com/internships/keywords-{slug}", 1, "none", 1),
    ("internshala_all", "https://internshala.com/internships/{slug}-internship", 1, "none", 1),
]
# Sites that leave out the location parameter when there is no location.
OPTIONAL_LOCATION_SITES = ["indeed", "wellfound"]


# --- page fields per site (fixed values) ----------------------------------------
# Selectors in order of preference.

SITE_FIELDS = {
    "cutshort": {
        "title": ['h1[class*="title"]', 'h2[class*="title"]', "h1"],
        "company": ['span[class*="company"]', 'a[class*="company"]', 'div[class*="company"] span'],
        "location": ['span[class*="location"]', 'div[class*="location"]'],
        "description": ['div[class*="description"]', 'div[class*="job-desc"]', 'section[class*="description"]'],
        "experience": ['span[class*="experience"]', 'div[class*="experience"]'],
        "job_type": ['span[class*="job-type"]', 'div[class*="employment"]'],
    },
    "foundit": {
        "title": ["h3.jobTitle", 'h1[class*="title"]', "h1.jdTitle", "h1"],
        "company": ["span.companyName", 'a[class*="company"]', 'div[class*="companyName"]'],
        "location": ["span.loc", 'span[class*="location"]', 'div[class*="location"]'],
        "description": ['div[class*="job-desc"]', "div.jd-desc", 'section[class*="description"]'],
        "experience": ['span[class*="exp"]', 'div[class*="experience"]'],
        "salary": ['span[class*="salary"]', "span.sal"],
        "job_type": ['span[class*="type"]', 'span[class*="empType"]'],
    },
    "shine": {
        "title": ['h1[class*="title"]', 'h2[class*="title"]', "h1", "h2.job-title"],
        "company": ['a[class*="company"]', 'span[class*="company"]', 'div[class*="compName"]'],
        "location": ['span[class*="loc"]', 'span[class*="location"]', 'div[class*="location"]'],
        "description": ['div[class*="description"]', 'div[class*="jd_content"]', 'section[class*="desc"]'],
        "experience": ['span[class*="exp"]', 'div[class*="experience"]'],
        "salary": ['span[class*="salary"]', 'span[class*="sal"]'],
        "job_type": ['span[class*="type"]', 'span[class*="empType"]'],
    },
    "timesjobs": {
        "title": ["h1.jd-job-title"],
        "company": ["h2.jd-comp-name", "h2.heading"],
        "location": ["span.loc", "div.location"],
        "description": ["div.jd-desc", 'section[class*="description"]'],
        "experience": ['li[title="experience"] i', "span.exp"],
        "salary": ['li[title="salary"] i', "span.sal"],
    },
    "wellfound": {
        "title": ['h2[class*="styles_component__"]', "h1.startup-header"],
        "company": ['h1[class*="styles_name__"]', 'div[class*="companyName"]'],
        "location": ['div[class*="styles_location__"]'],
        "description": ['div[class*="styles_description__"]', "div.job-description"],
    },
    "indeed": {
        "title": ['[data-testid="jobsearch-JobInfoHeader-title"]', ".jobsearch-JobInfoHeader-title", 'h1[class*="jobTitle"]'],
        "company": ['[data-testid="inlineHeader-companyName"] a', '[data-testid="inlineHeader-companyName"]',
                    ".jobsearch-InlineCompanyRating-companyHeader a",
                    '.jobsearch-CompanyInfoContainer a[data-tn-element="companyName"]'],
        "location": ['[data-testid="job-location"]', '[data-testid="inlineHeader-companyLocation"]',
                     '.jobsearch-JobInfoHeader-subtitle div[class*="location"]', ".companyLocation"],
        "description": ["#jobDescriptionText", ".jobsearch-jobDescriptionText"],
        "posted_date": ['[data-testid="job-age"]', ".jobsearch-JobMetadataHeader-item--date", 'span[class*="date"]'],
        "salary": ['[data-testid="attribute_snippet_testid"]', ".jobsearch-JobMetadataHeader-item--salary",
                   "#salaryInfoAndJobType span"],
        "job_type": ['[data-testid="attribute_snippet_testid"]', ".jobsearch-JobMetadataHeader-item--jobtype"],
    },
    "linkedin": {
        "title": ["h1.top-card-layout__title", 'h1[class*="job-details-jobs-unified-top-card__job-title"]', "h1.topcard__title"],
        "company": ['a[data-tracking-control-name="public_jobs_topcard-org-name"]', ".top-card-layout__first-subline a",
                    ".topcard__org-name-link", 'a[class*="company-name"]'],
        "location": [".top-card-layout__second-subline .topcard__flavor",
                     '[class*="job-details-jobs-unified-top-card__bullet"]', ".topcard__flavor--bullet"],
        "description": ["section.show-more-less-html .show-more-less-html__markup", ".description__text",
                        'div[class*="description"] .show-more-less-html__markup'],
        "posted_date": ['span[class*="posted-time-ago"]', ".topcard__flavor--metadata", "time"],
        "job_type": ['span[class*="employment-type"]', ".description__job-criteria-text--criteria"],
        "seniority": ['span[class*="experience-level"]', 'li[class*="job-criteria__item"] span'],
    },
    "exampleboard": {
        "title": ["h1.job-title", ".header-title h1", '[data-automation="job-title"]'],
        "company": [".company-name", ".employer-label"],
        "description": [".job-description"],
        "location": [".job-location"],
    },
}

# Detail links of hub pages (fixed values).
HUB_LINKS = {
    "cutshort": ['a[href*="/job/"]', 'a[href*="/jobs/"]', 'div[class*="job-card"] a'],
    "timesjobs": ["h2 a"],
    "wellfound": ['a[href*="/jobs/"]', 'a[class*="styles_jobTitle__"]'],
    "shine": ['a[href*="/job/"]', 'a[href*="/jobs/"]', "h2 a", 'h3 a[class*="title"]'],
    "indeed": ['a[data-testid="job-title"]', "h2.jobTitle a", ".jobtitle a"],
    "foundit": ['a[href*="/job/"]', 'a[href*="/job-listings/"]', "h3.jobTitle a", 'a[class*="cardTitle"]'],
}
# Hubs whose listings are numbered: cards, the card's own mark, links of a card, address of a detail page.
HUB_NUMBERED = {
    "linkedin": (
        ["li.jobs-search-results__list-item", 'li[class*="job-card-container"]', "div[data-occludable-job-id]"],
        "data-entity-urn", ['a[href*="/jobs/view/"]', ".base-card__full-link", ".job-card-list__title"], "https://www.linkedin.com/jobs/view/{id}/",
    ),
}
SEARCH_CARDS = ["li[data-jds]", "[data-jdh]", "article[data-encoded-doc]"]
SEARCH_TITLES = ['[role="heading"]', 'div[class*="title"]', "h2", "h3"]

# Result cards: card selectors, then the fields inside one card.
SITE_CARDS = {
    "internshala": (
        [".individual_internship", ".internship_meta", '[class*="internship-card"]'],
        {
            "title": [".heading_4_5 a", "h3 a", ".job-internship-name a", ".profile a"],
            "company": [".heading_6", ".company_name a", ".company_name", ".link_display_like_text"],
            "location": [".location_link a", "#location_names a", ".locations a"],
            "salary": [".stipend", '[class*="stipend"]'],
            "description": [".internship_other_details", ".other_detail_item"],
        },
    ),
    "naukri": (
        ['[class*="jobTuple"]', '[class*="srp-jobtuple"]', 'article[class*="jobCard"]', ".cust-job-tuple"],
        {
            "title": ['[class*="title"] a', '[class*="designation"] a', ".row1 a", "h2.title"],
            "company": ['[class*="companyInfo"] a', '[class*="company"]', ".subTitle", "a.comp-name"],
            "location": ['[class*="location"]', ".locWdth", '[class*="loc"] span'],
            "experience": ['[class*="experience"]', ".expwdth"],
            "salary": ['[class*="salary"]', ".salwdth"],
            "description": ['[class*="job-description"]', ".job-desc", ".ellipsis"],
        },
    ),
}
SITE_CARD_ORIGINS = {"internshala": "https://internshala.com", "naukri": "https://www.naukri.com"}
