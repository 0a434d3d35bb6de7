"""Registered queries: every operator on the given tables, with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions import pages as P
from vacantia.functions import text as T
from vacantia.functions import urls as U
from vacantia.operators import (
    classify, dedup, evaluate, extract, label, language, merge, profile, skills, structure, trends,
)
from vacantia.plans import checks, flows
from vacantia.plans.fixtures import Inputs, with_views
from vacantia.session import shared_path
from vacantia.sources import csv_files, tables
from vacantia.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SOURCES = ("stackoverflow", "efinancialcareers", "stepstone", "pracuj", "ch", "dice", "monster")
SMALL_CAPS = {"IT": 60, "Finance": 40, "HR": 100, "Other": 80}
KINDS = {"hard": "hard_skills", "soft": "soft_skills"}
THETA = 0.004
EARLY, LATE = (1995, 1997), (1999, 2001)
# Thresholds fitting the size of the test corpus; the defaults are in ``rules``.
FEW_JOBS, SMALL_SIZE = 5, 143


def query(name: str, check: str | None = None):
    """Register a function of the inputs under a name, with the SQL that must agree."""
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if check is not None:
            ORACLES[name] = with_views(check)
        return build
    return register


def rounded(table: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return table.withColumns({c: F.round(c, digits) for c in columns})


def joined(*columns: str) -> list:
    """Array columns as text for comparison."""
    return [F.array_join(c, "|").alias(c) for c in columns]


# --- sources ---------------------------------------------------------------------

CSV_COLUMNS = ("doc_id", "job_id", "title", "source", "country", "date_posted", "description",
               "original_url", "timestamp")


@query("scan_csv_roundtrip", """SELECT CAST(doc_id AS STRING) AS doc_id, nullif(job_id, '') AS job_id, title, source,
  country, date_posted, description, original_url, timestamp FROM v_postings""")
def scan_csv_roundtrip(data):
    from vacantia.schema import text_schema
    path = shared_path(data.spark, "csv")
    tables.write_csv(data.postings().select(*CSV_COLUMNS), path)
    return csv_files.read_ranges(data.spark, path, text_schema(*CSV_COLUMNS)).drop("file")


def board_files(data) -> str:
    """Boards' files of uneven quality: one has no description column, one is missing, some have
    records that are cut short; headers differ in order and names."""
    given = data.postings().select("doc_id", "source", "title", "description")
    quoted = {c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in given.columns}
    full = F.when(F.col("source") == "pracuj", F.concat_ws(",", quoted["title"], quoted["doc_id"], quoted["description"])).when(
        F.col("source") == "dice", F.concat_ws(",", quoted["doc_id"], quoted["title"])).otherwise(
        F.concat_ws(",", quoted["doc_id"], quoted["title"], quoted["description"]))
    line = F.when((F.col("source") != "dice") & (F.col("doc_id") % 23 == 0), F.concat(quoted["doc_id"], F.lit(',"short"'))).otherwise(full)
    rows = given.filter("source != 'monster'").select("source", F.lit(1).alias("no"), line.alias("value"))
    names = {"pracuj": "title,doc_id,Job_Description", "dice": "doc_id,title"}
    heads = data.spark.createDataFrame([(s, 0, names.get(s, "doc_id,title,description")) for s in SOURCES if s != "monster"],
                                       "source string, no int, value string")
    path = shared_path(data.spark, "boards")
    (heads.unionByName(rows).repartition("source").sortWithinPartitions("source", "no")
     .select("source", "value").write.partitionBy("source").text(path))
    return path


def source_in(path):
    return F.regexp_extract(path, "source=([^/]+)/", 1)


BOARD_ROWS = """WITH r AS (SELECT source, doc_id, title, description, source <> 'dice' AND doc_id % 23 = 0 AS bad FROM v_postings WHERE source <> 'monster')"""


@query("source_file_report", BOARD_ROWS + """ SELECT source, CASE WHEN source = 'dice' THEN 'no description' WHEN count(*) FILTER (bad) > 0 THEN 'partly read'
  ELSE 'read' END AS status, count(*) AS n_records, count(*) FILTER (bad) AS n_bad FROM r GROUP BY source
  UNION ALL SELECT 'monster', 'empty', 0, 0""")
def source_file_report(data):
    path = board_files(data)
    rows = csv_files.by_header(data.spark, f"{path}/*", ("doc_id", "title"))
    return csv_files.file_report(data.spark, f"{path}/*", rows, SOURCES, source_in).withColumnRenamed("name", "source")


@query("merge_readable_files", BOARD_ROWS + """ SELECT doc_id, source, title, description FROM r
  WHERE NOT bad AND source <> 'dice' AND description IS NOT NULL""")
def merge_readable_files(data):
    """The good records of all files that have a description, whatever it is called."""
    path = board_files(data)
    rows = csv_files.by_header(data.spark, f"{path}/*", ("doc_id", "title", "description", "Job_Description"))
    text = F.coalesce("description", "Job_Description")
    return rows.filter("NOT bad").select(F.col("doc_id").cast("long").alias("doc_id"), source_in(F.col("file")).alias("source"), "title", text.alias("description")).filter(
        "description IS NOT NULL AND source != 'dice'")


@query("taxonomy_split", """SELECT CASE type_name WHEN 'Common Skill' THEN 'soft' ELSE 'hard' END AS kind, name
FROM v_part_taxonomy WHERE type_name IN ('Specialized Skill', 'Certification', 'Common Skill')""")
def taxonomy_split(data):
    return tables.split_taxonomy(data.view("v_part_taxonomy")).select("kind", "name")


@query("source_from_filename", "SELECT doc_id, split_part(file_name, '_', 1) AS source FROM v_files")
def source_from_filename(data):
    return data.view("v_files").select("doc_id", T.source_of_file(F.col("file_name")).alias("source"))


@query("source_slug", """SELECT doc_id, replace(replace(replace(replace(replace(file_name, '_jobs_dedup.csv', ''),
  '_dedup.csv', ''), '_cleaned.csv', ''), '_jobs.csv', ''), '.csv', '') AS slug FROM v_files""")
def source_slug(data):
    return data.view("v_files").select("doc_id", T.slug_of_file(F.col("file_name")).alias("slug"))


@query("parse_skill_list", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || '|' || source || '''s' END AS items FROM documents""")
def parse_skill_list(data):
    text = F.when(F.col("doc_id") % 5 == 0, "[]").otherwise(
        F.concat(F.lit("['"), "lang", F.lit("', \""), "source", F.lit("'s\"]")))
    items = T.parse_list(text)
    return data.table("documents").select("doc_id", F.size(items).alias("n"),
                                          F.array_join(items, "|").alias("items"))


@query("capture_index", """SELECT timestamp, original_url,
  'https://web.archive.org/web/' || timestamp || '/' || original_url AS wayback_url FROM v_captures""")
def capture_index(data):
    return tables.capture_index(data.view("v_captures"))


@query("file_inventory", "SELECT 'documents.parquet' AS file_name, count(*) > 0 AS has_size FROM documents")
def file_inventory(data):
    """The files behind the documents; the check knows their name and that they aren't empty."""
    files = tables.file_inventory(data.spark, data.path("documents")).select(
        F.when(F.col("file_name").endswith(".parquet"), F.lit("documents.parquet")).alias("file_name"),
        (F.col("size_mb") > 0).alias("has_size"))
    return files.groupBy("file_name").agg(F.bool_and("has_size").alias("has_size"))


@query("standardize_columns", """SELECT doc_id, text AS description, 'board' AS source
FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0""")
def standardize_columns(data):
    named = data.table("documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("Job_Description_Text"))
    return merge.standardize(named, "board").select("doc_id", F.col("description"), "source")


@query("job_url_filter", f"SELECT page_id, board, {checks.is_job_url('url', 'board')} AS is_job FROM v_job_urls")
def job_url_filter(data):
    return data.view("v_job_urls").select(
        "page_id", "board", U.is_job_url(F.col("url"), F.col("board")).alias("is_job"))


@query("junk_pages", f"SELECT page_id, board, {checks.is_junk('html', 'board')} AS junk FROM v_raw_pages")
def junk_pages(data):
    return data.view("v_raw_pages").select(
        "page_id", "board", P.is_junk(F.col("html"), F.col("board")).alias("junk"))


@query("job_id_from_url", r"""SELECT page_id, CASE board
  WHEN 'dice' THEN substr(regexp_extract(url, '/jobs/detail/[^/]+/[^/]+/([^/?#]+)', 1), 1, 50)
  WHEN 'efinancialcareers' THEN regexp_extract(url, '(?i)\.(id|br|ry)(\d+)', 2)
  WHEN 'stackoverflow' THEN regexp_extract(url, '/jobs/(\d+)/', 1)
  WHEN 'monster' THEN regexp_extract(url, '(?i)([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})', 1)
  WHEN 'stepstone' THEN regexp_extract(url, '--(\d{6,12})\.html', 1)
  WHEN 'pracuj' THEN regexp_extract(url, ',(\d{4,12})($|[,?#])', 1)
  ELSE regexp_extract(url, '/rpd/(\d{7,12})', 1) END AS job_id FROM v_job_urls""")
def job_id_from_url(data):
    return data.view("v_job_urls").select(
        "page_id", U.job_id_from_url(F.col("url"), F.col("board")).alias("job_id"))


@query("country_from_url", f"SELECT page_id, {checks.country_of_url('url')} AS country FROM v_job_urls")
def country_from_url(data):
    return data.view("v_job_urls").select("page_id", U.country_from_url(F.col("url")).alias("country"))


@query("split_location", """SELECT c_custkey, trim(split_part(coalesce(location, ''), ',', 1)) AS city,
  trim(split_part(coalesce(location, ''), ',', 2)) AS region,
  CASE WHEN location LIKE '%,%' THEN trim(list_last(string_split(location, ','))) ELSE '' END AS country FROM v_places""")
def split_location(data):
    parts = T.split_location(F.col("location"))
    return data.view("v_places").select("c_custkey", *[c.alias(n) for n, c in parts.items()])


PADDED = ("  ", "\t \u00a0x\u2003 y\n ")
PADDED_SQL = f"'{PADDED[0]}' || text || '{PADDED[1]}'"


@query("clean_text", f"SELECT doc_id, trim(regexp_replace({PADDED_SQL}, '{checks.WS}+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(data):
    return data.texts("documents").select(
        "doc_id", T.clean_text(F.concat(F.lit(PADDED[0]), "text", F.lit(PADDED[1]))).alias("cleaned"))


@query("html_to_text", f"""SELECT page_id, {checks.html_text('marked')} AS body
FROM (SELECT page_id, {checks.marked_text('html', 'page_id')} AS marked FROM pages) p""")
def html_to_text(data):
    """Pages with named references of several alphabets put before them."""
    marked = data.texts("pages").selectExpr("page_id", f"{checks.marked_text('html', 'page_id')} AS marked")
    return marked.select("page_id", T.html_to_text(F.col("marked")).alias("body"))


@query("parse_dates", """SELECT doc_id, strftime(coalesce(try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(raw, '%Y%m%d%H%M%S'),
  try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%d.%m.%Y')), '%Y-%m-%d %H:%M:%S') AS parsed FROM v_dates""")
def parse_dates(data):
    return data.view("v_dates").select(
        "doc_id", F.date_format(T.parse_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("year_month", """SELECT doc_id, coalesce(strftime(try_cast(date_posted AS DATE), '%Y-%m'),
  substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)) AS year_month FROM v_postings""")
def year_month(data):
    return data.postings().select(
        "doc_id", T.year_month(F.col("date_posted"), F.col("timestamp")).alias("year_month"))


@query("explode_skills", """SELECT DISTINCT posting_id, year, hard_skill AS skill FROM v_baskets
WHERE hard_skill IS NOT NULL""")
def explode_skills(data):
    return skills.explode_skills(data.baskets(), "hard_skills", ["posting_id", "year"])


# --- captures, dedup, merge --------------------------------------------------------

@query("earliest_capture", """SELECT original_url, min(timestamp) AS timestamp,
  'https://web.archive.org/web/' || min(timestamp) || '/' || original_url AS wayback_url FROM v_captures GROUP BY original_url""")
def earliest_capture(data):
    return dedup.earliest_captures(data.view("v_captures"))


WITH_CAPTURE = """SELECT *, 'https://web.archive.org/web/' || timestamp || '/' || original_url AS wayback_url FROM v_postings"""


@query("dedup_postings", f"""SELECT doc_id, job_id, title, source, original_url, timestamp, description FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(job_id), ''), original_url)
    ORDER BY timestamp, original_url, wayback_url, doc_id) AS rn FROM ({WITH_CAPTURE}) c) r WHERE rn = 1""")
def dedup_postings(data):
    return dedup.dedup_postings(data.sql(WITH_CAPTURE)).select(
        "doc_id", "job_id", "title", "source", "original_url", "timestamp", "description")


@query("earliest_capture_batches", """SELECT original_url, min(timestamp) AS timestamp,
  'https://web.archive.org/web/' || min(timestamp) || '/' || original_url AS wayback_url FROM v_captures GROUP BY original_url""")
def earliest_capture_batches(data):
    """The same table kept up to date: captures come in three batches, some of the earliest last."""
    root, captures = shared_path(data.spark, "kept-captures"), data.view("v_captures")
    for batch in range(3):
        dedup.merge_captures(captures.filter(F.pmod(F.xxhash64("original_url", "timestamp"), F.lit(3)) == batch), root, 16)
    return dedup.merged_captures(data.spark, root)


@query("dedup_postings_batches", f"""SELECT doc_id, job_id, title, source, original_url, timestamp, description FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(job_id), ''), original_url)
    ORDER BY timestamp, original_url, wayback_url, doc_id) AS rn FROM ({WITH_CAPTURE}) c) r WHERE rn = 1""")
def dedup_postings_batches(data):
    """Postings deduplicated as they come, in two batches."""
    root, postings = shared_path(data.spark, "kept-postings"), data.sql(WITH_CAPTURE)
    for batch in range(2):
        dedup.merge_postings(postings.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == batch), root, 16)
    return dedup.merged_postings(data.spark, root, postings.schema).select(
        "doc_id", "job_id", "title", "source", "original_url", "timestamp", "description")


JOB_CAPTURES = " UNION ALL ".join(
    "SELECT page_id, board, url AS original_url, "
    f"CAST(20160101000000 + ((page_id * 37 + {k * 11}) % 9) * 10000000000 AS STRING) AS timestamp FROM v_job_urls"
    for k in range(3))


@query("pending_job_captures", f"""WITH j AS ({JOB_CAPTURES}),
e AS (SELECT original_url, min(timestamp) AS timestamp FROM j WHERE {checks.is_job_url('original_url', 'board')} GROUP BY original_url)
SELECT original_url, timestamp FROM e WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.page_id % 3 = 0
  AND j.original_url = e.original_url AND j.timestamp = e.timestamp)""")
def pending_job_captures(data):
    """Job pages only, the earliest capture of each, less those stored."""
    captures = data.sql(JOB_CAPTURES)
    stored = tables.capture_index(captures.filter("page_id % 3 = 0"))
    return dedup.pending_job_captures(captures, stored).select("original_url", "timestamp")


@query("resume_antijoin", """SELECT DISTINCT c.original_url, c.timestamp FROM v_captures c
WHERE NOT EXISTS (SELECT 1 FROM v_captures d WHERE d.page_id % 3 = 0 AND d.original_url = c.original_url AND d.timestamp = c.timestamp)""")
def resume_antijoin(data):
    captures = tables.capture_index(data.view("v_captures")).distinct()
    stored = tables.capture_index(data.sql("SELECT * FROM v_captures WHERE page_id % 3 = 0"))
    return dedup.pending_captures(captures, stored).select("original_url", "timestamp")


@query("merge_sources", """SELECT doc_id, source, CASE WHEN source = 'ch' THEN NULL ELSE job_id END AS job_id, title,
  CASE WHEN source = 'ch' THEN original_url END AS archive_url, description
FROM v_postings WHERE description IS NOT NULL""")
def merge_sources(data):
    boards = {}
    for source in SOURCES:
        own = data.postings().filter(F.col("source") == source).drop("source")
        if source == "ch":
            own = own.select("doc_id", "title", F.col("original_url").alias("archive_url"),
                             F.col("description").alias("description_preview"))
        else:
            own = own.select("doc_id", "title", "job_id", "description")
        boards[source] = own
    return merge.merge_sources(boards).select("doc_id", "source", "job_id", "title", "archive_url", "description")


@query("source_metadata", """SELECT p.source, coalesce(m.country, '?') AS country, coalesce(m.sector, '?') AS sector,
  coalesce(m.region, '?') AS region, count(*) AS n FROM v_postings p LEFT JOIN v_source_meta m ON m.source = p.source
GROUP BY ALL""")
def source_metadata(data):
    counts = data.postings().groupBy("source").agg(F.count("*").alias("n"))
    return profile.with_metadata(counts, data.view("v_source_meta"))


@query("backfill_descriptions", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'kept ' || page_id
  WHEN page_id % 6 = 1 THEN 'Block ' || rtrim(repeat('word' || page_id || ' ', 60)) || ' end'
  WHEN page_id % 6 = 2 THEN 'One ' || repeat('rich' || page_id || ' ', 30) || 'Two ' || rtrim(repeat('text ', 30))
  WHEN page_id % 3 = 1 THEN '  ' ELSE NULL END AS description FROM pages""")
def backfill_descriptions(data):
    return extract.backfill_descriptions(data.view("v_gaps"), data.view("v_gap_pages")).select(
        "page_id", "description")


@query("backfill_outcomes", """SELECT CASE page_id % 6 WHEN 4 THEN 'empty' WHEN 5 THEN 'junk' ELSE 'filled' END AS status, count(*) AS n
FROM pages WHERE page_id % 3 <> 0 GROUP BY ALL""")
def backfill_outcomes(data):
    return extract.backfill_outcomes(data.view("v_gaps"), data.view("v_gap_pages"))


@query("backfill_page_text", """SELECT wayback_url, CASE n % 6 WHEN 0 THEN 'From data ' || n
  WHEN 1 THEN 'Block ' || rtrim(repeat('word' || n || ' ', 60)) || ' end'
  WHEN 2 THEN 'One ' || repeat('rich' || n || ' ', 30) || 'Two ' || rtrim(repeat('text ', 30))
  WHEN 3 THEN 'Section ' || rtrim(repeat('part' || n || ' ', 60)) ELSE '' END AS description
FROM (SELECT wayback_url, CAST(split_part(wayback_url, '/', 6) AS BIGINT) AS n FROM v_gap_pages) g""")
def backfill_page_text(data):
    pages = data.view("v_gap_pages").withColumn("plain", T.drop_noise(F.col("html")))
    return pages.select("wayback_url", P.page_description(F.col("html"), F.col("plain")).alias("description"))


# --- pages to postings -----------------------------------------------------------------

def board_pages(data, view: str) -> DataFrame:
    return data.view(view).select(
        "page_id", "board", F.col("url").alias("original_url"), F.lit("20200101000000").alias("timestamp"), "html")


SHOWN = ("page_id", "title", "company", "city", "region", "country", "employment_type", "date_posted", "description")


@query("jsonld_postings", f"""SELECT page_id,
  CASE page_id % 5 WHEN 0 THEN 'Job ' || page_id WHEN 1 THEN 'Arr ' || page_id WHEN 3 THEN 'Second ' || page_id ELSE h1 END AS title,
  CASE page_id % 5 WHEN 0 THEN 'Org' WHEN 2 THEN 'Left' ELSE '' END AS company,
  CASE page_id % 5 WHEN 0 THEN 'Bern' WHEN 1 THEN 'Zug' ELSE '' END AS city,
  CASE page_id % 5 WHEN 0 THEN 'BE' ELSE '' END AS region,
  CASE board WHEN 'dice' THEN 'US' WHEN 'pracuj' THEN 'PL' WHEN 'jobs_cz' THEN 'CZ' WHEN 'efinancialcareers' THEN 'GB'
    ELSE CASE WHEN page_id % 5 = 0 THEN 'CH' WHEN board = 'monster' THEN 'US' WHEN board = 'stepstone' THEN 'DE' ELSE '' END END AS country,
  CASE page_id % 5 WHEN 0 THEN 'FULL_TIME' ELSE '' END AS employment_type,
  CASE page_id % 5 WHEN 0 THEN '2020-01-02' WHEN 2 THEN '2019-05-06' ELSE '' END AS date_posted,
  CASE WHEN page_id % 5 = 0 THEN 'Text ' || page_id || ' &more'
    WHEN board = 'jobs_cz' AND page_id % 5 IN (2, 4) THEN body ELSE '' END AS description
FROM (SELECT l.page_id, l.board, {checks.run_together("regexp_extract(p.html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1,
  {checks.html_text("regexp_extract(p.html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS body
  FROM v_ld_pages l JOIN pages p ON p.page_id = l.page_id) x""")
def jsonld_postings(data):
    return extract.extract_postings(board_pages(data, "v_ld_pages"), keep=["page_id"]).select(*SHOWN)


@query("html_fallback_postings", """SELECT page_id, 'JobNo' || page_id || ' & Co' AS title,
  CASE WHEN board IN ('efinancialcareers', 'stepstone', 'pracuj') THEN 'Firm ' || (page_id % 3) ELSE 'Acme' || (page_id % 3) END AS company,
  'Bern' AS city, CASE board WHEN 'dice' THEN 'BE' ELSE '' END AS region,
  CASE board WHEN 'dice' THEN 'US' WHEN 'pracuj' THEN 'PL' WHEN 'jobs_cz' THEN 'CZ' WHEN 'efinancialcareers' THEN 'GB'
    WHEN 'monster' THEN 'US' WHEN 'stepstone' THEN 'DE' ELSE 'CH' END AS country,
  CASE WHEN board IN ('stackoverflow', 'pracuj') THEN '' ELSE 'Full time' END AS employment_type,
  '2018-03-0' || (1 + page_id % 9) AS date_posted,
  CASE board WHEN 'jobs_cz' THEN 'Do this and that ' || page_id ELSE 'Do this and that ' || page_id END AS description FROM v_marked_pages""")
def html_fallback_postings(data):
    return extract.extract_postings(board_pages(data, "v_marked_pages"), keep=["page_id"]).select(*SHOWN)


@query("archive_postings", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' Job  ' || page_id || ' ' WHEN 1 THEN 'Arr ' || page_id
    WHEN 2 THEN '' ELSE 'Second ' || page_id END AS title,
  CASE page_id % 5 WHEN 0 THEN 'Org' WHEN 2 THEN 'Left' ELSE '' END AS company,
  CASE page_id % 5 WHEN 0 THEN '2020-01-02' WHEN 2 THEN '2019-05-06' END AS date_posted,
  CASE page_id % 5 WHEN 0 THEN '2020-02-02' END AS valid_through,
  CASE page_id % 5 WHEN 0 THEN 'FULL_TIME' END AS employment_type,
  CASE page_id % 5 WHEN 0 THEN 'Bern' WHEN 1 THEN 'Zug' ELSE '' END AS city,
  CASE page_id % 5 WHEN 0 THEN '3000' ELSE '' END AS postal_code,
  CASE page_id % 5 WHEN 0 THEN 'Text ' || page_id || ' &more' ELSE '' END AS description_preview
FROM v_ld_pages WHERE page_id % 5 < 4""")
def archive_postings(data):
    pages = data.view("v_ld_pages").select("page_id", F.col("url").alias("archive_url"), "html")
    return extract.extract_archive_postings(pages, keep=["page_id"]).drop("archive_url")


@query("ingest_outcomes", f"""SELECT board, CASE WHEN html IS NULL THEN 'errors' WHEN {checks.is_junk('html', 'board')} THEN 'junk'
  WHEN NOT regexp_matches(html, '(?i)<h1') THEN 'empty' ELSE 'saved' END AS status, count(*) AS n FROM v_raw_pages GROUP BY ALL""")
def ingest_outcomes(data):
    return ingest.outcome_counts(board_pages(data, "v_raw_pages"))


@query("incremental_ingest", f"""SELECT page_id, title FROM (SELECT p.page_id,
  {checks.run_together("regexp_extract(p.html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
  {checks.is_junk('p.html', "'stepstone'")} AS junk,
  row_number() OVER (PARTITION BY p.url ORDER BY {checks.is_junk('p.html', "'stepstone'")}, p.html NULLS LAST, p.page_id) AS rn
  FROM (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000, url, NULL FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id + 2000000, url, 'too short' FROM pages WHERE page_id % 4 = 0) p) x
WHERE rn = 1 AND NOT junk AND title <> ''""")
def incremental_ingest(data):
    """Stream pages into a new store in two batches, twice; the second run finds nothing new.

    Some captures come as several copies, a good one among a missing and a short one.
    """
    folder = shared_path(data.spark, "captured")
    given = data.table("pages")
    missing = given.filter("page_id % 3 = 0").selectExpr("page_id + 1000000 AS page_id", "url", "CAST(NULL AS STRING) AS html")
    short = given.filter("page_id % 4 = 0").selectExpr("page_id + 2000000 AS page_id", "url", "'too short' AS html")
    given.unionByName(missing).unionByName(short).repartition(4, "url").write.parquet(folder)
    target, checkpoint = shared_path(data.spark, "ingested"), shared_path(data.spark, "ingest-progress")
    schema = given.schema
    # ``page_id`` rides along in the time stamp to show which capture was kept.
    pages = (data.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
             .select(F.lit("stepstone").alias("board"), F.col("url").alias("original_url"),
                     F.lit("20200101000000").alias("timestamp"), "html", "page_id"))
    for _ in range(2):
        ingest.incremental_ingest(pages, target, checkpoint, keep=["page_id"]).awaitTermination()
    return ingest.stored_postings(data.spark, target, keep={"page_id": "bigint"}).select("page_id", "title")


# --- skills and trends --------------------------------------------------------------------

@query("extract_skills_synonyms", f"SELECT doc_id, {checks.synonyms('description')} AS extracted_skills FROM v_adverts")
def extract_skills_synonyms(data):
    return skills.extract_synonyms(data.view("v_adverts")).select("doc_id", *joined("extracted_skills"))


def taxonomy_skills(data, kind: str) -> DataFrame:
    words = skills.vocabulary(skills.taxonomy_entries(data.view("v_taxonomy")))
    column = KINDS[kind]
    return skills.with_skills(data.postings(), "doc_id", "description", words, {kind: column},
                              keep=["doc_id"]).select("doc_id", *joined(column))


@query("extract_skills_hard", f"SELECT doc_id, {checks.taxonomy('description', 'hard')} AS hard_skills FROM v_postings")
def extract_skills_hard(data):
    return taxonomy_skills(data, "hard")


@query("extract_skills_soft", f"SELECT doc_id, {checks.taxonomy('description', 'soft')} AS soft_skills FROM v_postings")
def extract_skills_soft(data):
    return taxonomy_skills(data, "soft")


@query("extract_skills_overlap", checks.OVERLAP)
def extract_skills_overlap(data):
    """Names that overlap, begin alike or hold punctuation."""
    words = skills.vocabulary(skills.taxonomy_entries(data.view("v_overlap_names")))
    out = skills.with_skills(data.view("v_overlap_texts"), "doc_id", "body", words, {"hard": "hard_skills"}, keep=["doc_id"])
    return out.select("doc_id", *joined("hard_skills"))


@query("domain_skills", f"""SELECT doc_id, domain_label, {checks.taxonomy('description', 'hard')} AS hard_skills,
  {checks.taxonomy('description', 'soft')} AS soft_skills FROM v_postings WHERE domain_label IN ('IT', 'Finance', 'HR')""")
def domain_skills(data):
    """The three domains' extraction in one job."""
    corpus = data.postings().filter(F.col("domain_label").isin("IT", "Finance", "HR"))
    out = skills.extract_skills(corpus, data.view("v_taxonomy"), keep=["doc_id", "domain_label"])
    return out.select("doc_id", "domain_label", *joined("hard_skills", "soft_skills"))


def corpus_skills(data) -> DataFrame:
    """Postings of the test corpus with year, country, domain and skills."""
    corpus = data.postings().withColumn("year", T.year_of_month(F.col("year_month"))).filter("year is not null")
    return skills.extract_skills(corpus, data.view("v_taxonomy"),
                                 keep=["doc_id", "year", "country", "domain_label"])


@query("corpus_skill_trends", f"""WITH k AS (SELECT CAST(substr(year_month, 1, 4) AS INT) AS year, {checks.taxonomy_list('description', 'hard')} AS s FROM v_postings),
t AS (SELECT year, count(*) AS total_jobs FROM k GROUP BY year),
c AS (SELECT year, skill, count(*) AS skill_count FROM (SELECT year, unnest(s) AS skill FROM k) e GROUP BY ALL),
r AS (SELECT c.year, c.skill, c.skill_count, t.total_jobs, round(c.skill_count / t.total_jobs * 100, 6) AS percentage,
  row_number() OVER (PARTITION BY c.year ORDER BY c.skill_count / t.total_jobs DESC, c.skill) AS rn FROM c JOIN t ON t.year = c.year WHERE t.total_jobs >= {FEW_JOBS})
SELECT year, skill, skill_count, total_jobs, percentage FROM r WHERE rn <= 30""")
def corpus_skill_trends(data):
    """From text to top list: the flagship query."""
    out = trends.skill_trends(corpus_skills(data), "hard_skills", ["year"], min_jobs=FEW_JOBS)
    return rounded(out, "percentage")


@query("target_postings", """SELECT doc_id, domain_label, source, CASE WHEN source = 'ch' THEN coalesce(country, 'CH') ELSE country END AS country,
  ym AS year_month, CAST(substr(ym, 1, 4) AS INT) AS year FROM (SELECT *, coalesce(strftime(try_cast(date_posted AS DATE), '%Y-%m'),
  substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)) AS ym FROM v_postings WHERE domain_label <> 'Other') p""")
def target_postings(data):
    return flows.target_postings(data.postings()).select(
        "doc_id", "domain_label", "source", "country", "year_month", "year")


@query("domain_skill_trends", checks.domain_trends(FEW_JOBS))
def domain_skill_trends(data):
    """The whole way from labelled postings to all trend tables."""
    out = flows.domain_trends(flows.target_postings(data.postings()), data.view("v_taxonomy"), "doc_id", FEW_JOBS)
    return rounded(out, "percentage")


@query("skill_trends_global", checks.trends("hard_skill", ["year"], "TRUE"))
def skill_trends_global(data):
    return rounded(trends.skill_trends(data.baskets(), "hard_skills", ["year"]), "percentage")


@query("skill_trends_country", checks.trends("hard_skill", ["year", "country"], "country IN ('CH','PL','DE','US')"))
def skill_trends_country(data):
    return rounded(trends.skill_trends(data.baskets(), "hard_skills", ["year", "country"]), "percentage")


@query("skill_trends_all", checks.all_trends())
def skill_trends_all(data):
    return rounded(trends.all_trends(data.baskets()), "percentage")


# --- profile -------------------------------------------------------------------------------

def corpus_profile(data) -> DataFrame:
    return profile.with_metadata(profile.source_profile(data.postings()), data.view("v_source_meta"))


@query("source_profile", checks.PROFILE + " SELECT * FROM profile")
def source_profile(data):
    return corpus_profile(data)


@query("profile_mixed_columns", checks.MIXED)
def profile_mixed_columns(data):
    """Boards of three layouts, the columns found by name."""
    def board(source: str) -> DataFrame:
        rows = data.postings().filter(F.col("source") == source).select("job_id", "description", "date_posted")
        if source in ("pracuj", "dice"):
            return rows.withColumnsRenamed({"description": "Job_Description", "date_posted": "Posting_Date"})
        if source in ("ch", "monster"):
            return rows.select("job_id", F.col("date_posted").alias("timestamp"))
        return rows

    found = profile.mixed_profile({source: board(source) for source in SOURCES})
    return profile.with_metadata(found, data.view("v_source_meta"))


@query("null_rates", checks.null_rates(("title", "job_id", "country", "date_posted", "description")))
def null_rates(data):
    return profile.null_rates(data.postings(), ("title", "job_id", "country", "date_posted", "description"))


@query("yearly_counts", """SELECT source, CAST(year(try_cast(date_posted AS DATE)) AS INT) AS year, count(*) AS n FROM v_postings
WHERE try_cast(date_posted AS DATE) IS NOT NULL GROUP BY ALL""")
def yearly_counts(data):
    return profile.yearly_counts(data.postings())


@query("yearly_pivot", checks.yearly_pivot(SOURCES))
def yearly_pivot(data):
    return profile.yearly_matrix(profile.yearly_counts(data.postings()), SOURCES)


@query("coverage_heatmap", checks.coverage(SOURCES))
def coverage_heatmap(data):
    matrix = profile.yearly_matrix(profile.yearly_counts(data.postings()), SOURCES)
    return rounded(profile.coverage(matrix, SOURCES), "relative")


@query("country_totals", checks.PROFILE + """ SELECT country, CAST(sum(total_vacancies) AS BIGINT) AS total_vacancies,
  round(sum(total_vacancies) / (SELECT sum(total_vacancies) FROM profile) * 100, 1) AS share_pct FROM profile GROUP BY country""")
def country_totals(data):
    return profile.totals_by(corpus_profile(data), "country")


@query("sector_totals", checks.PROFILE + """ SELECT sector, CAST(sum(total_vacancies) AS BIGINT) AS total_vacancies,
  round(sum(total_vacancies) / (SELECT sum(total_vacancies) FROM profile) * 100, 1) AS share_pct FROM profile GROUP BY sector""")
def sector_totals(data):
    return profile.totals_by(corpus_profile(data), "sector")


@query("corpus_totals", checks.PROFILE + """ SELECT count(*) AS sources, CAST(sum(total_vacancies) AS BIGINT) AS total_vacancies,
  CAST(sum(valid_desc) AS BIGINT) AS valid_desc, round(sum(valid_desc) / sum(total_vacancies) * 100, 1) AS fill_pct,
  count(*) FILTER (total_vacancies >= 5000) AS usable_sources,
  CAST(coalesce(sum(total_vacancies) FILTER (total_vacancies >= 5000), 0) AS BIGINT) AS usable_vacancies,
  CAST(coalesce(sum(valid_desc) FILTER (total_vacancies >= 5000), 0) AS BIGINT) AS usable_valid_desc FROM profile""")
def corpus_totals(data):
    return profile.corpus_totals(corpus_profile(data))


@query("usable_sources", checks.PROFILE + f""" SELECT source, country, sector, total_vacancies, valid_desc,
  round(100 - missing_pct, 1) AS fill_pct FROM profile WHERE 100 - missing_pct >= 50 AND total_vacancies >= {SMALL_SIZE}""")
def usable_sources(data):
    return profile.usable_sources(corpus_profile(data), min_size=SMALL_SIZE).select(
        "source", "country", "sector", "total_vacancies", "valid_desc", "fill_pct")


@query("excluded_sources", checks.PROFILE + f""" SELECT source, concat_ws(' | ',
  CASE WHEN 100 - missing_pct < 90 THEN 'fill=' || CAST(round_even(100 - missing_pct, 0) AS INT) || '%' END,
  CASE WHEN total_vacancies < {SMALL_SIZE} THEN 'size=' || format('{{:,}}', total_vacancies) END) AS reason
FROM profile WHERE 100 - missing_pct < 90 OR total_vacancies < {SMALL_SIZE}""")
def excluded_sources(data):
    return profile.excluded_sources(corpus_profile(data), min_fill=90, min_size=SMALL_SIZE).select("source", "reason")


@query("quality_flags", checks.PROFILE + f""" SELECT source, CAST(round_even(100 - missing_pct, 0) AS INT) || '%' AS fill,
  CASE WHEN flags = '' THEN '✅ Good' ELSE flags END AS status FROM (SELECT *, concat_ws(' | ',
  CASE WHEN 100 - missing_pct < 40 THEN '⚠ Low description fill rate (' || CAST(round_even(100 - missing_pct, 0) AS INT) || '%)'
    WHEN 100 - missing_pct < 80 THEN '△ Moderate description fill rate (' || CAST(round_even(100 - missing_pct, 0) AS INT) || '%)' END,
  CASE WHEN avg_desc_length > 0 AND avg_desc_length < 300 THEN '⚠ Short avg description (' || avg_desc_length || ' chars)' END,
  CASE WHEN years_covered <= 2 THEN '△ Narrow time window (' || years_covered || ' year(s))' END,
  CASE WHEN total_vacancies < {SMALL_SIZE} THEN '△ Small dataset (' || format('{{:,}}', total_vacancies) || ' records)' END) AS flags FROM profile) f""")
def quality_flags(data):
    return profile.quality_flags(corpus_profile(data), small=SMALL_SIZE).select("source", "fill", "status")


@query("length_histogram", checks.HISTOGRAM)
def length_histogram(data):
    return profile.length_histogram(data.postings())


@query("sample_descriptions", r"""SELECT source, doc_id, sample FROM (SELECT source, doc_id, substr(description, 1, 300) AS sample,
  row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING) || '-42')) AS rn FROM v_postings
  WHERE description IS NOT NULL AND trim(description) <> '') s WHERE rn = 1""")
def sample_descriptions(data):
    return profile.sample_descriptions(data.postings())


# --- labels and classification ----------------------------------------------------------------

@query("weak_labels", checks.labelled(rules.LABEL_CAPS))
def weak_labels(data):
    return label.weak_labels(data.postings()).select("doc_id", "label")


@query("stratified_sample", checks.labelled(SMALL_CAPS))
def stratified_sample(data):
    return label.weak_labels(data.postings(), caps=SMALL_CAPS).select("doc_id", "label")


@query("train_val_split", """SELECT doc_id, domain_label, CASE WHEN rn <= round(0.2 * n) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, domain_label, count(*) OVER (PARTITION BY domain_label) AS n,
  row_number() OVER (PARTITION BY domain_label ORDER BY md5(CAST(doc_id AS STRING) || '-42')) AS rn FROM v_postings) r""")
def train_val_split(data):
    return label.train_val_split(data.postings(), "domain_label", "doc_id").select("doc_id", "domain_label", "split")


@query("label_index", """SELECT domain_label, CAST(dense_rank() OVER (ORDER BY domain_label) - 1 AS INT) AS label_id
FROM (SELECT DISTINCT domain_label FROM v_postings) d""")
def label_index(data):
    return label.label_index(data.postings(), "domain_label")


def naive_bayes(data):
    rows = label.train_val_split(data.postings(), "domain_label", "doc_id").filter("split = 'train'")
    return classify.train_naive_bayes(rows, "domain_label")


@query("nb_train", checks.NB_MODEL + """ SELECT word, CAST(n_IT AS BIGINT) AS n_IT, CAST(n_Finance AS BIGINT) AS n_Finance,
  CAST(n_HR AS BIGINT) AS n_HR, CAST(n_Other AS BIGINT) AS n_Other, round(score_IT, 6) AS score_IT, round(score_Finance, 6) AS score_Finance,
  round(score_HR, 6) AS score_HR, round(score_Other, 6) AS score_Other FROM model""")
def nb_train(data):
    model, _ = naive_bayes(data)
    return rounded(model.drop("hot"), *[f"score_{c}" for c in rules.LABELS])


@query("nb_predict", checks.NB_MODEL + checks.NB_PREDICT)
def nb_predict(data):
    model, priors = naive_bayes(data)
    model = tables.stored(model, "word-model")
    out = classify.predict_naive_bayes(data.postings(), model, priors)
    return rounded(out, *[f"score_{c}" for c in rules.LABELS], digits=4)


@query("lr_domain")
def lr_domain(data):
    rows = label.train_val_split(data.postings(), "domain_label", "doc_id")
    rows = classify.hash_words(rows.select("doc_id", "domain_label", "split", F.col("description").isNotNull().alias("has_text"), "description"))
    model = classify.train_logistic(rows.filter("split = 'train' AND has_text"), "domain_label")
    return classify.predict_logistic(rows, model)


@query("lr_optimum", checks.LR_OPTIMUM)
def lr_optimum(data):
    """The regression, left to run on, comes to its optimum: over the training rows each label's
    probabilities sum to its number of texts, and no derivative is further from 0 than 0.0001."""
    rows = label.train_val_split(data.postings(), "domain_label", "doc_id").filter("split = 'train'")
    rows = tables.stored(rows.select("domain_label", "description"), "lr-rows")
    model = classify.train_logistic(rows, "domain_label", features=1 << 10, iterations=400, tolerance=1e-9)
    found = classify.optimality(rows, model, "domain_label")
    return found.select("label", "texts", F.round("expected_texts", 2).alias("expected_texts"),
                        (F.col("gradient") <= 1e-4).alias("at_optimum"))


def scored(data, predicted: DataFrame) -> DataFrame:
    """The validation rows with their label, a model's and their language."""
    rows = label.train_val_split(data.postings(), "domain_label", "doc_id").filter("split = 'val'")
    language = classify.detect_language(F.col("description")).alias("language")
    return rows.select("doc_id", F.col("domain_label").alias("true_label"), language).join(
        predicted.select("doc_id", "predicted_label"), "doc_id")


@query("nb_eval", checks.NB_EVAL)
def nb_eval(data):
    """Accuracy and weighted F1 of Naive Bayes on the validation rows, overall and by language."""
    model, priors = naive_bayes(data)
    rows = tables.stored(scored(data, classify.predict_naive_bayes(
        data.postings(), tables.stored(model, "word-model"), priors)), "nb-scored")
    every = evaluate.summary(rows).withColumn("language", F.lit("all"))
    return rounded(every.unionByName(evaluate.summary(rows, ["language"])), "accuracy", "weighted_f1")


@query("lr_eval")
def lr_eval(data):
    """The same for the logistic regression."""
    rows = tables.stored(scored(data, lr_domain(data)), "lr-scored")
    every = evaluate.summary(rows).withColumn("language", F.lit("all"))
    return rounded(every.unionByName(evaluate.summary(rows, ["language"])), "accuracy", "weighted_f1")


@query("detect_language", f"SELECT doc_id, {checks.language('text')} AS language FROM documents")
def detect_language(data):
    return data.texts("documents").select("doc_id", classify.detect_language(F.col("text")).alias("language"))


@query("language_counts", f"SELECT language, count(*) AS n FROM (SELECT {checks.language('text')} AS language FROM documents) l GROUP BY language")
def language_counts(data):
    found = data.texts("documents").select(classify.detect_language(F.col("text")).alias("language"))
    return found.groupBy("language").agg(F.count("*").alias("n"))


LANGUAGES = ("de", "en", "es", "fr")


def language_split(data) -> DataFrame:
    """The documents of known language, a fifth of each language's held out."""
    return label.train_val_split(data.texts("documents"), "lang", "doc_id", LANGUAGES)


def language_profiles(data) -> DataFrame:
    return tables.stored(language.learn_profiles(language_split(data).filter("split = 'train'"), LANGUAGES), "language-profiles")


@query("language_profile_table", checks.GRAM_PROFILES + " SELECT gram, w_de, w_en, w_es, w_fr FROM profiles")
def language_profile_table(data):
    return language.learn_profiles(language_split(data).filter("split = 'train'"), LANGUAGES)


@query("detect_language_profiles", checks.GRAM_PROFILES + ", texts AS (SELECT doc_id AS k, text FROM documents)" + checks.GRAM_SCORES
       + " SELECT k AS doc_id, score_de, score_en, score_es, score_fr, language FROM scored")
def detect_language_profiles(data):
    return language.detect_by_profiles(data.texts("documents"), language_profiles(data), LANGUAGES)


def language_trials(data) -> DataFrame:
    """Held-out texts of known language: whole, every sentence alone, and followed by the next
    document where that is in another language; the longer one's language is then the right one."""
    split = language_split(data)
    held = tables.stored(split.filter("split = 'val'").select("doc_id", "lang", "text"), "language-held")
    other = data.table("documents").selectExpr("doc_id - 1 AS doc_id", "lang AS next_lang", "text AS next_text")
    size, next_size = (F.length(language.letters(F.col(c))) for c in ("text", "next_text"))
    mixed = held.join(other, "doc_id").filter("lang != next_lang").select(
        F.lit("mixed").alias("kind"), F.concat(F.lit("m"), "doc_id").alias("trial"),
        F.when(size >= next_size, F.col("lang")).otherwise(F.col("next_lang")).alias("lang"),
        F.concat_ws(" ", "text", "next_text").alias("text"))
    sentences = held.select("doc_id", "lang", F.posexplode_outer(F.split("text", r"[.!?\n]+")).alias("no", "text")).filter(
        F.col("text").rlike(r"\p{L}")).select(F.lit("sentence").alias("kind"), F.concat(F.lit("s"), "doc_id", F.lit("-"), "no").alias("trial"), "lang", "text")
    whole = held.select(F.lit("whole").alias("kind"), F.concat(F.lit("w"), "doc_id").alias("trial"), "lang", "text")
    return whole.unionByName(sentences).unionByName(mixed)


@query("language_profile_eval", checks.LANGUAGE_EVAL)
def language_profile_eval(data):
    """How many held-out texts each detector tells right, by kind of text and language."""
    by_words = classify.detect_language(F.col("text"))
    wanted = F.when(F.col("lang") == "en", "EN").when(F.col("lang") == "de", "DE").otherwise("Other_Lang")
    # What is known of a trial travels with its key, so that its texts are read and moved once.
    trials = language_trials(data).select(F.struct("trial", "kind", "lang", by_words.alias("by_words")).alias("about"), "text")
    judged = language.detect_by_profiles(trials, language_profiles(data), LANGUAGES, key="about").select("about.*", "language")
    return judged.groupBy("kind", "lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("profiles_right"),
        F.count_if(F.col("by_words") == wanted).alias("words_right"))


@query("confusion_matrix", "SELECT true_label, predicted_label, count(*) AS n FROM v_eval GROUP BY ALL")
def confusion_matrix(data):
    return evaluate.confusion_matrix(data.view("v_eval"))


@query("eval_overall", checks.EVALUATION + """ SELECT round(sum(hit) / sum(support), 6) AS accuracy,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS sample_size FROM m""")
def eval_overall(data):
    """The hand-labelled rows name their label column in a way of their own."""
    given = data.view("v_eval").withColumnRenamed("true_label", "label")
    return rounded(evaluate.summary(evaluate.with_true_label(given)), "accuracy", "weighted_f1")


@query("eval_report", checks.EVALUATION + """ SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT label, precision, recall, f1, support FROM m UNION ALL
  SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM m UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM m) r""")
def eval_report(data):
    return rounded(evaluate.report(data.view("v_eval")), "precision", "recall", "f1")


@query("eval_by_language", checks.evaluation_by("language") + """ SELECT language, round(sum(hit) / sum(support), 6) AS accuracy,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS sample_size FROM m GROUP BY language""")
def eval_by_language(data):
    return rounded(evaluate.summary(data.view("v_eval"), ["language"]), "accuracy", "weighted_f1")


# --- market structure ---------------------------------------------------------------------------

@query("skill_ols", checks.OLS)
def skill_ols(data):
    out = structure.skill_growth(data.baskets(), "hard_skills")
    return rounded(out, "slope", "intercept", "r2", "t_stat", "p_value", digits=5)


@query("skill_bloat_welch", checks.bloat(EARLY, LATE) + f""" SELECT domain_label, n_early, n_late, round(mean_early, 6) AS mean_early,
  round(mean_late, 6) AS mean_late, round(t, 5) AS t_stat, round(df, 4) AS df, round({checks.p_value('t', 'df')}, 5) AS p_value FROM w""")
def skill_bloat_welch(data):
    out = structure.bloat_welch(data.baskets(), "hard_skills", EARLY, LATE)
    out = rounded(out, "mean_early", "mean_late")
    return rounded(rounded(out, "t_stat", "p_value", digits=5), "df", digits=4)


@query("skill_bloat_cohen", checks.bloat(EARLY, LATE) + """ SELECT domain_label, round(mean_early, 6) AS mean_early,
  round(mean_late, 6) AS mean_late, round(sp, 6) AS pooled_sd, round((mean_late - mean_early) / sp, 6) AS cohens_d FROM w""")
def skill_bloat_cohen(data):
    out = structure.bloat_cohen(data.baskets(), "hard_skills", EARLY, LATE)
    return rounded(out, "mean_early", "mean_late", "pooled_sd", "cohens_d")


@query("skill_cooccurrence", checks.pairs(THETA) + """ SELECT domain_label, year, total_jobs, skill_a, skill_b, pair_count,
  round(pair_count / total_jobs, 6) AS support FROM p""")
def skill_cooccurrence(data):
    return rounded(structure.cooccurrence(data.baskets(), "hard_skills", THETA), "support")


@query("network_density", checks.pairs(THETA) + """ SELECT v.domain_label, v.year, v.nodes, coalesce(e.edges, 0) AS edges,
  round(CASE WHEN v.nodes > 1 THEN 2 * coalesce(e.edges, 0) / (v.nodes * (v.nodes - 1)) ELSE 0.0 END, 6) AS density
FROM (SELECT domain_label, year, count(*) AS nodes FROM f GROUP BY ALL) v
LEFT JOIN (SELECT domain_label, year, count(*) AS edges FROM p GROUP BY ALL) e ON e.domain_label = v.domain_label AND e.year = v.year""")
def network_density(data):
    return rounded(structure.network_density(data.baskets(), "hard_skills", THETA), "density")


@query("skill_degrees", checks.pairs(THETA) + """ SELECT domain_label, year, skill, count(*) AS degree FROM (
  SELECT domain_label, year, skill_a AS skill FROM p UNION ALL SELECT domain_label, year, skill_b FROM p) d GROUP BY ALL""")
def skill_degrees(data):
    return structure.skill_degrees(structure.cooccurrence(data.baskets(), "hard_skills", THETA))


@query("convergence_index", checks.CONVERGENCE)
def convergence_index(data):
    return rounded(structure.convergence(data.baskets(), "hard_skills"), "cosine", "jaccard")


@query("geo_benchmark", checks.GEO)
def geo_benchmark(data):
    return rounded(structure.geo_benchmark(data.baskets(), "hard_skills"), "percentage", "base_percentage", "gap")


@query("skills_per_posting", """SELECT year, count(*) AS postings, round(avg(k), 6) AS mean_skills, round(quantile_cont(k, 0.5), 6) AS median_skills,
  round(quantile_cont(k, 0.9), 6) AS p90_skills FROM (SELECT posting_id, year, count(DISTINCT hard_skill) AS k FROM v_baskets GROUP BY ALL) s GROUP BY year""")
def skills_per_posting(data):
    return rounded(structure.skills_per_posting(data.baskets(), "hard_skills"),
                   "mean_skills", "median_skills", "p90_skills")
