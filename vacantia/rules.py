"""Board rules, junk markers, page selectors and word lists.

Everything here is fixed data the results depend on.  The logic that reads it
lives in ``functions`` and ``operators``.
"""

# --- fixed values: posting layouts ------------------------------------------

POSTING_FIELDS = (
    "job_id", "title", "company", "city", "region", "country", "employment_type",
    "date_posted", "description", "wayback_url", "original_url", "timestamp",
)
ARCHIVE_POSTING_FIELDS = (
    "archive_url", "title", "company", "date_posted", "valid_through",
    "employment_type", "city", "postal_code", "description_preview",
)
CAPTURE_PREFIX = "https://web.archive.org/web/"
BOARDS = ("dice", "efinancialcareers", "stackoverflow", "monster", "stepstone", "pracuj", "jobs_cz")

# Texts that a CSV reader turns into a missing value.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: which addresses are postings (tested on the lower-cased URL) ----

URL_EXCLUDES = {
    "dice": ("dice.com/$", "dice.com/index", "/search/", "/jobs/?", "/jobs?", "/career-advice/",
             "/employer/", "/jobs/detail/$", "/jobs/detail/?"),
    "efinancialcareers": ("/jobs/", "/jobs?", "efinancialcareers.com/$", "/search/", "/news/",
                          "/advice/", "/employer/", "/recruiter/", "?page=", "?q="),
    "stackoverflow": ("/jobs/feed", "/jobs/search", "/jobs?", "/jobs/directory", "/jobs/companies",
                      "/jobs/developer-jobs-using-", "so_medium=", "so_source=", "/apply", "/save",
                      "/unsave"),
    "monster": ("monster.com/$", "monster.com/index", "/search/", "/jobs/", "/career-advice/",
                "/company/", "/profile/", "?page=", "?q=", "/job-openings/&"),
    "stepstone": ("/stellenangebote?", "/stellenangebote/?", "/kandidaten/", "/bewerber/",
                  "/unternehmen/", "/ratgeber/", "/gehalt/", "/karriere/", "stepstone.de/$",
                  "stepstone.de/index", "/suche/", "/jobs?", "/jobs/?"),
    "pracuj": ("/oferta-pracy?", "/praca?", "/praca/?", "/firma/", "/porady/", "/kandydat/",
               "/szukaj/", "/wyniki/", "pracuj.pl/$", "pracuj.pl/index", "/logowanie",
               "/rejestracja"),
    "jobs_cz": ("/rpd/$", "jobs.cz/$", "jobs.cz/index", "/search/", "/hledani/", "/brigady/",
                "?page=", "?rps="),
}
UUID = "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
# Every pattern of a board must be found.
URL_REQUIRED = {
    "dice": ("/(jobs/detail|job-detail)/[^/]{5,}",),
    "efinancialcareers": (r"\.(id|br|ry)\d+|/job/preview/\d+",),
    "stackoverflow": (r"/jobs/\d+/[a-z0-9-]+",),
    "monster": ("/job-openings/", UUID),
    "stepstone": ("/stellenangebote--|/5/|/job/",),
    "pracuj": ("/oferta-pracy/|/praca/", r",\d{4,}"),
    "jobs_cz": (r"/rpd/\d{7,12}",),
}
# (pattern, group, longest id); the first pattern found gives the id, on the URL as written.
JOB_ID_PATTERNS = {
    "dice": ((r"/jobs/detail/[^/]+/[^/]+/([^/?#]+)", 1, 50), (r"/job-detail/([^/?#]+)", 1, 50),
             (r"(\d{6,12})", 1, 12)),
    "efinancialcareers": ((r"(?i)\.(id|br|ry)(\d+)", 2, None), (r"/job/preview/(\d+)", 1, None),
                          (r"(\d{5,12})", 1, None)),
    "stackoverflow": ((r"/jobs/(\d+)/", 1, None),),
    "monster": ((f"(?i)({UUID})", 1, None),),
    "stepstone": ((r"--(\d{6,12})\.html", 1, None), (r"/5/(\d{6,12})", 1, None),
                  (r"/job/[^/]+-(\d{6,12})/?$", 1, None), (r"(\d{6,12})", 1, None)),
    "pracuj": ((r",(\d{4,12})(?:[,?#]|$)", 1, None), (r"(\d{6,12})", 1, None)),
    "jobs_cz": ((r"/rpd/(\d{7,12})", 1, None),),
}
# First keyword found in the lower-cased URL gives the country.
URL_COUNTRIES = (
    ("united-states", "US"), ("usa", "US"), ("new-york", "US"),
    ("united-kingdom", "GB"), ("london", "GB"),
    ("deutschland", "DE"), ("germany", "DE"),
    ("france", "FR"), ("paris", "FR"),
    ("singapore", "SG"), ("hong-kong", "HK"),
    ("australia", "AU"), ("sydney", "AU"),
    ("canada", "CA"), ("toronto", "CA"),
    ("switzerland", "CH"), ("zurich", "CH"),
    ("wien", "AT"), ("austria", "AT"),
    ("china", "CN"), ("beijing", "CN"), ("shanghai", "CN"),
)
# Country a board starts from, and whether structured data may replace it.
BOARD_COUNTRY = {"dice": "US", "monster": "US", "stepstone": "DE", "pracuj": "PL", "jobs_cz": "CZ"}
COUNTRY_FROM_JSON = ("stackoverflow", "monster", "stepstone", "efinancialcareers")

# --- fixed values: junk pages ------------------------------------------------

MIN_PAGE_CHARS = 500
_CORE_MARKERS = (
    "verify you are human", "please enable cookies", "captcha", "access denied",
    "this page requires javascript", "robot or human", "checking your browser",
    "just a moment", "wayback machine doesn't have", "got an http 429 error",
    "this snapshot was not found",
)
_SHARED_MARKERS = _CORE_MARKERS + ("enable javascript", "cf-browser-verification", "ddos-guard")
_CLOUDFLARE_MARKERS = ("please wait... | cloudflare", "attention required! | cloudflare")
_GONE_MARKERS = ("job not found", "this job is no longer available", "this position has been filled")
JUNK_MARKERS = {
    "dice": _SHARED_MARKERS + _CLOUDFLARE_MARKERS + _GONE_MARKERS + ("page not found", "404"),
    "efinancialcareers": _SHARED_MARKERS + _CLOUDFLARE_MARKERS + _GONE_MARKERS,
    "stackoverflow": _SHARED_MARKERS + _GONE_MARKERS
    + ("page not found", "no longer accepting", "job has expired"),
    "monster": _SHARED_MARKERS + _CLOUDFLARE_MARKERS + _GONE_MARKERS + ("page not found",),
    "stepstone": _SHARED_MARKERS + _CLOUDFLARE_MARKERS,
    "pracuj": _SHARED_MARKERS + _CLOUDFLARE_MARKERS
    + ("nie znaleziono strony", "strona nie istnieje"),
    "jobs_cz": _SHARED_MARKERS + _CLOUDFLARE_MARKERS
    + ("stránka nebyla nalezena", "404", "inzerát byl smazán", "tato nabídka již není aktivní"),
}
BACKFILL_JUNK_MARKERS = _CORE_MARKERS

# --- fixed values: page selectors ---------------------------------------------
# Per board and field, in order of trial: (tag, attribute, value).  An attribute
# ending in "~" is a case-insensitive search in the attribute, otherwise the
# attribute must equal the value; no attribute takes any element of the tag.

ANY = ("", "")
SELECTORS = {
    "dice": {
        "title": (("h1", "data-cy", "jobTitle"), ("h1", "class~", "job-title|jobTitle|position"),
                  ("h1", "itemprop", "title"), ("h1", *ANY)),
        "company": (("a", "data-cy", "companyNameLink"), ("span", "data-cy", "companyName"),
                    ("div", "class~", "company|employer|hiring-company"),
                    ("span", "class~", "company|employer"), ("span", "itemprop", "name")),
        "location": (("span", "data-cy", "location"), ("li", "data-cy", "location"),
                     ("span", "itemprop", "addressLocality"),
                     ("span", "class~", "location|city|address")),
        "date_posted": (("span", "data-cy", "postedDate"), ("time", "itemprop", "datePosted"),
                        ("time", *ANY), ("span", "class~", "date|posted|updated"),
                        ("meta", "itemprop", "datePosted")),
        "employment_type": (("span", "data-cy", "employmentType"),
                            ("span", "itemprop", "employmentType"),
                            ("meta", "itemprop", "employmentType"),
                            ("li", "class~", "employment|job-type|contract|fulltime")),
        "description": (("div", "data-cy", "jobDescription"), ("div", "itemprop", "description"),
                        ("section", "itemprop", "description"),
                        ("div", "class~", "job-description|jobDescription|description|job-details"),
                        ("div", "id~", "jobDescription|job-description")),
    },
    "efinancialcareers": {
        "title": (("h1", "class~", "job-title|jobTitle|position-title"), ("h1", "itemprop", "title"),
                  ("h1", "data-test", "job-title"), ("h1", *ANY)),
        "company": (("span", "class~", "company|employer|firm"), ("a", "class~", "company|employer"),
                    ("div", "class~", "company|employer"), ("span", "itemprop", "name")),
        "location": (("span", "itemprop", "addressLocality"),
                     ("span", "class~", "location|city|place"), ("li", "class~", "location|city"),
                     ("meta", "itemprop", "addressLocality")),
        "date_posted": (("time", "itemprop", "datePosted"), ("time", *ANY),
                        ("span", "class~", "date|posted|published"),
                        ("meta", "itemprop", "datePosted")),
        "employment_type": (("span", "itemprop", "employmentType"),
                            ("meta", "itemprop", "employmentType"),
                            ("li", "class~", "employment|contract|permanent")),
        "description": (("div", "itemprop", "description"),
                        ("div", "class~", "job-description|jobDescription|job-detail|description"),
                        ("section", "class~", "description|job-detail"),
                        ("div", "id~", "jobDescription|job-description")),
    },
    "stackoverflow": {
        "title": (("h1", "class~", "job-detail.*title|fs-headline"), ("h1", "itemprop", "title"),
                  ("a", "class~", "job-link|position"), ("h1", *ANY)),
        "company": (("div", "class~", "employer|company"), ("span", "class~", "employer|company"),
                    ("a", "class~", "employer|company"), ("span", "itemprop", "name")),
        "location": (("span", "class~", "location|geoTag"), ("span", "itemprop", "addressLocality")),
        "date_posted": (("time", "itemprop", "datePosted"), ("time", *ANY),
                        ("span", "class~", "date|posted"), ("meta", "itemprop", "datePosted")),
        "employment_type": (("span", "class~", "employment|job.type|contract|fulltime|remote"),
                            ("span", "itemprop", "employmentType"),
                            ("meta", "itemprop", "employmentType")),
        "description": (("div", "id", "job-description"),
                        ("div", "class~", "job-description|description|detail"),
                        ("div", "itemprop", "description"),
                        ("section", "class~", "description|detail")),
    },
    "monster": {
        "title": (("h1", "class~", "job-title|jobTitle|title"), ("h1", "itemprop", "title"),
                  ("h1", "data-testid", "jobTitle"), ("h1", *ANY)),
        "company": (("div", "class~", "company|employer|hiring"),
                    ("span", "class~", "company|employer"), ("a", "data-testid", "companyName"),
                    ("span", "itemprop", "name")),
        "location": (("span", "itemprop", "addressLocality"),
                     ("span", "class~", "location|city|address"), ("div", "class~", "location|city"),
                     ("meta", "itemprop", "addressLocality")),
        "region": (("span", "itemprop", "addressRegion"), ("abbr", "class~", "state|region")),
        "date_posted": (("time", "itemprop", "datePosted"), ("time", *ANY),
                        ("span", "class~", "date|posted|updated"),
                        ("meta", "itemprop", "datePosted")),
        "employment_type": (("span", "itemprop", "employmentType"),
                            ("meta", "itemprop", "employmentType"),
                            ("li", "class~", "employment|job-type|full.time|part.time")),
        "description": (("div", "itemprop", "description"), ("section", "itemprop", "description"),
                        ("div", "class~", "job-description|jobDescription|description|job-details"),
                        ("div", "id~", "jobDescription|job-description|job-details")),
    },
    "stepstone": {
        "title": (("h1", "data-at", "job-ad-header-title"),
                  ("h1", "class~", "jobAd-header|job-title|listing-title"),
                  ("h1", "itemprop", "title"), ("h1", *ANY)),
        "company": (("span", "data-at", "job-ad-company-name"),
                    ("span", "class~", "company|employer|hiring"),
                    ("a", "data-at", "job-ad-company-link"),
                    ("div", "itemprop", "hiringOrganization")),
        "location": (("span", "data-at", "job-ad-header-location"),
                     ("li", "data-at", "job-ad-header-location"),
                     ("span", "class~", "location|city|ort"),
                     ("meta", "itemprop", "addressLocality")),
        "date_posted": (("time", *ANY), ("span", "data-at", "job-posting-date"),
                        ("meta", "itemprop", "datePosted")),
        "employment_type": (("span", "data-at", "job-ad-employment-type"),
                            ("meta", "itemprop", "employmentType"),
                            ("li", "class~", "employment|vollzeit|teilzeit")),
        "description": (("div", "data-at", "jobad-duties-section"),
                        ("div", "class~", "job-ad-display|jobAdPage|job-description|description"),
                        ("section", "itemprop", "description"), ("div", "itemprop", "description")),
    },
    "pracuj": {
        "title": (("h1", "data-test", "text-positionName"),
                  ("h1", "class~", "offer-title|jobTitle|position"), ("h1", *ANY)),
        "company": (("h2", "data-test", "text-employerName"),
                    ("a", "data-test", "anchor-company-link"),
                    ("span", "class~", "company|employer|pracodawca"),
                    ("h2", "class~", "company|employer")),
        "location": (("li", "data-test", "sections-benefit-workplaces"),
                     ("span", "data-test", "text-workplaceAddress"),
                     ("span", "class~", "location|city|miejsce|lokalizacja")),
        "date_posted": (("span", "data-test", "text-addDate"), ("time", *ANY),
                        ("meta", "itemprop", "datePosted")),
        "employment_type": (("li", "data-test", "sections-benefit-employment-type-name"),
                            ("span", "class~", "employment|etat|zatrudnienie")),
        "description": (("div", "data-test", "section-description"),
                        ("section", "data-test", "section-requirements"),
                        ("div", "class~", "offer-description|job-description|opis"),
                        ("div", "id~", "description|offerDescription")),
    },
    "jobs_cz": {
        "title": (("h1", "class~", "title|nadpis|position|job"), ("h1", "itemprop", "title"),
                  ("h1", *ANY)),
        "company": (("span", "itemprop", "name"),
                    ("div", "class~", "company|employer|spolecnost|firma"),
                    ("a", "class~", "company|employer"), ("strong", "class~", "company|employer")),
        "location": (("span", "itemprop", "addressLocality"),
                     ("li", "class~", "location|address|adresa|mesto"),
                     ("span", "class~", "location|address|adresa"),
                     ("meta", "itemprop", "addressLocality")),
        "date_posted": (("time", "itemprop", "datePosted"), ("time", *ANY),
                        ("meta", "itemprop", "datePosted"), ("span", "class~", "date|datum|posted")),
        "employment_type": (("span", "itemprop", "employmentType"),
                            ("meta", "itemprop", "employmentType"),
                            ("li", "class~", "employment|uvazek|plny|castecny"),
                            ("div", "class~", "employment.type|job.type")),
        "description": (("div", "itemprop", "description"),
                        ("div", "class~", "description|popis|job-detail|offer-detail"),
                        ("div", "id~", "description|popis|job-detail"),
                        ("section", "class~", "description|detail")),
        "main": (("main", *ANY), ("article", *ANY), ("div", "id", "content")),
    },
}
# A text this long or longer is passed over.
TOO_LONG = {
    "company": {"dice": 100, "efinancialcareers": 100, "stackoverflow": 100, "monster": 100,
                "jobs_cz": 100},
    "employment_type": {"stackoverflow": 50, "jobs_cz": 60},
}
# Fields that read the element's text only; elsewhere a content attribute comes first.
TEXT_ONLY = {
    "company": ("dice", "efinancialcareers", "stackoverflow", "monster", "pracuj", "jobs_cz"),
    "location": ("dice", "stackoverflow", "pracuj"),
    "employment_type": ("pracuj",),
}
MAIN_CONTENT_CHARS = 3000

BACKFILL_CONTAINER = ("div", "class*", "listing-content")
BACKFILL_UNWANTED = "similar|footer|apply|modal|banner"
BACKFILL_BLOCKS = ("div", "class^", "richtext")
BACKFILL_SELECTORS = (
    ("div", "data-at", "jobad-duties-section"),
    ("div", "class~", "job-ad-display|jobAdPage|job-description"),
    ("section", "itemprop", "description"), ("div", "itemprop", "description"),
)
BACKFILL_MIN_CHARS = 200

# --- fixed values: file names and source metadata ------------------------------

SLUG_SUFFIXES = ("_jobs_dedup.csv", "_dedup.csv", "_cleaned.csv", "_jobs.csv", ".csv")
DESCRIPTION_NAMES = ("description", "description_preview", "job_description", "text", "full_text")
SOURCE_META = (  # slug, country, sector, region
    ("stackoverflow", "Global", "IT", "Global"),
    ("efinancialcareers", "Global", "Finance", "Global"),
    ("stepstone_de", "Germany", "Mixed", "Europe"),
    ("pracuj_pl", "Poland", "Mixed", "Europe"),
    ("ch_data", "Switzerland", "Mixed", "Europe"),
    ("dice_com", "USA", "IT", "North America"),
    ("monster_com", "USA", "Mixed", "North America"),
)
FILL_LOW, FILL_MODERATE, SHORT_TEXT, NARROW_YEARS, SMALL_SOURCE = 40, 80, 300, 2, 5000
USABLE_FILL, USABLE_SIZE = 50, 5000
TREND_COUNTRIES = ("CH", "PL", "DE", "US")
MIN_JOBS, TOP_SKILLS = 30, 30

# --- fixed values: weak labels --------------------------------------------------

LABELS = ("IT", "Finance", "HR", "Other")
TITLE_MARKERS = {
    "Finance": "analyst|trader|risk|compliance|fund|portfolio|credit|quant|actuar",
    "HR": "recruiter|hr|human resources|talent|people operations|l&d",
    "Other": "arzt|pfleger|fahrer|bauingenieur|koch|kellner|lekarz|kierowca|kelner|mechanic",
}
LABEL_SOURCES = {"IT": "stackoverflow", "Finance": "efinancialcareers"}
LABEL_CAPS = {"IT": 20000, "Finance": 20000, "HR": 5000, "Other": 5000}
SAMPLE_SEED = 42

# --- fixed values: skills ---------------------------------------------------------

HARD_TYPES = ("Specialized Skill", "Certification")
SOFT_TYPES = ("Common Skill",)
SKILL_SYNONYMS = {
    "Python": ("python", "python3", "pandas", "numpy"),
    "SQL": ("sql", "mysql", "postgresql", "t-sql", "pl/sql"),
    "Java": ("java", "java 8", "java 11", "spring boot"),
    "Cloud Computing": ("aws", "amazon web services", "azure", "gcp", "google cloud"),
    "Machine Learning": ("machine learning", "ml", "tensorflow", "pytorch", "scikit-learn"),
    "Git": ("git", "github", "gitlab", "version control"),
    "Docker": ("docker", "containerization", "kubernetes", "k8s"),
    "Excel": ("excel", "ms excel", "microsoft excel", "vlookup", "pivot tables", "macros", "vba"),
    "Financial Modeling": ("financial modeling", "dcf", "valuation", "financial analysis"),
    "Accounting Standards": ("ifrs", "gaap", "us gaap"),
    "ERP Systems": ("sap", "oracle e-business", "1c"),
    "Bloomberg": ("bloomberg", "bloomberg terminal"),
    "Agile/Scrum": ("agile", "scrum", "kanban", "sprint planning"),
    "Recruiting": ("recruiting", "talent acquisition", "sourcing", "headhunting"),
    "ATS": ("ats", "applicant tracking system", "workday", "greenhouse", "lever"),
}

# --- language word lists (our own choice) -------------------------------------------
# Words of one language only, so that a hit counts for one language.

STOPWORDS = {
    "EN": ("the", "and", "of", "to", "is", "are", "with", "that", "this", "which", "you", "we",
           "our", "your", "will", "have", "from", "by", "it", "be", "as", "or"),
    "DE": ("der", "die", "das", "und", "ist", "sind", "mit", "für", "nicht", "ein", "eine", "auf",
           "wir", "sie", "zu", "den", "dem", "von", "sich", "auch", "bei", "werden"),
    "PL": ("i", "w", "na", "się", "nie", "jest", "są", "że", "oraz", "dla", "lub", "przez",
           "pracy", "od", "po", "jak", "ze", "twoje", "praca", "oferujemy", "firma", "będzie"),
    "Other_Lang": ("le", "les", "et", "est", "dans", "pour", "que", "qui", "sur", "une", "el", "los",
                   "las", "y", "por", "para", "una", "con", "avec", "pas", "del", "il"),
}
