"""Inputs of the registered queries: views over the given tables.

The SQL text of a view is the same for Spark and for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_postings": """SELECT doc_id,
  CASE WHEN doc_id % 10 = 9 THEN '' ELSE CAST(doc_id - doc_id % 3 AS STRING) END AS job_id,
  CASE doc_id % 10 WHEN 0 THEN 'Senior Risk Analyst' WHEN 1 THEN 'HR Recruiter' WHEN 2 THEN 'Backend Developer'
    WHEN 3 THEN 'Kierowca' WHEN 4 THEN 'Arzt' WHEN 5 THEN 'Portfolio Trader' WHEN 6 THEN 'Koch'
    WHEN 7 THEN 'Data Engineer' WHEN 8 THEN 'Talent Partner' ELSE NULL END AS title,
  CASE doc_id % 7 WHEN 0 THEN 'stackoverflow' WHEN 1 THEN 'efinancialcareers' WHEN 2 THEN 'stepstone' WHEN 3 THEN 'pracuj'
    WHEN 4 THEN 'ch' WHEN 5 THEN 'dice' ELSE 'monster' END AS source,
  CASE doc_id % 6 WHEN 0 THEN 'CH' WHEN 1 THEN 'PL' WHEN 2 THEN 'DE' WHEN 3 THEN 'US' WHEN 4 THEN 'CZ' ELSE NULL END AS country,
  CASE doc_id % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'Finance' WHEN 2 THEN 'HR' ELSE 'Other' END AS domain_label,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'Posted 3 days ago' ELSE CAST(d AS STRING) END AS date_posted,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '   ' ELSE text END AS description,
  'https://jobs.example.com/rpd/' || CAST(1000000 + doc_id - doc_id % 3 AS STRING) || '/' AS original_url,
  replace(CAST(d AS STRING), '-', '') || '120000' AS timestamp,
  substr(CAST(d AS STRING), 1, 7) AS year_month
FROM (SELECT *, DATE '2010-01-01' + CAST((doc_id * 7919) % 5479 AS INT) AS d FROM documents) x""",
    "v_baskets": """SELECT DISTINCT o.o_orderkey AS posting_id, CAST(year(o.o_orderdate) AS INT) AS year,
  CASE c.c_nationkey % 5 WHEN 0 THEN 'CH' WHEN 1 THEN 'PL' WHEN 2 THEN 'DE' WHEN 3 THEN 'US' ELSE 'CZ' END AS country,
  CASE substr(o.o_orderpriority,1,1) WHEN '1' THEN 'IT' WHEN '2' THEN 'Finance' ELSE 'HR' END AS domain_label,
  p.p_name AS hard_skill, p.p_type AS soft_skill
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
JOIN customer c ON c.c_custkey = o.o_custkey""",
    "v_taxonomy": """SELECT * FROM (VALUES ('Of The','Specialized Skill'), ('In The','Specialized Skill'), ('To The','Specialized Skill'), ('De La','Specialized Skill'),
 ('Que La','Specialized Skill'), ('For','Specialized Skill'), ('From','Certification'), ('Für','Certification'), ('Ci','Certification'),
 ('And','Common Skill'), ('Der','Common Skill'), ('It Is','Common Skill'), ('Que','Common Skill'), ('Other','Unlisted Type')) t(name, type_name)""",
    "v_part_taxonomy": """SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'Specialized Skill' WHEN 1 THEN 'Certification' WHEN 2 THEN 'Common Skill' ELSE 'Unlisted Type' END AS type_name
FROM part""",
    "v_source_meta": """SELECT * FROM (VALUES ('stackoverflow','Global','IT','Global'), ('efinancialcareers','Global','Finance','Global'), ('stepstone','Germany','Mixed','Europe'),
 ('pracuj','Poland','Mixed','Europe'), ('ch','Switzerland','Mixed','Europe'), ('dice','USA','IT','North America')) t(source, country, sector, region)""",
    "v_captures": " UNION ALL ".join(
        "SELECT page_id, url AS original_url, "
        f"CAST(20160101000000 + ((page_id * 37 + {k * 11}) % 9) * 10000000000 AS STRING) AS timestamp FROM pages"
        for k in range(3)),
    "v_job_urls": """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'dice' WHEN 1 THEN 'efinancialcareers' WHEN 2 THEN 'stackoverflow' WHEN 3 THEN 'monster'
  WHEN 4 THEN 'stepstone' WHEN 5 THEN 'pracuj' WHEN 6 THEN 'jobs_cz' ELSE 'pracuj' END AS board,
 CASE page_id % 8 WHEN 0 THEN 'https://www.dice.com/jobs/detail/Java-Dev-Acme/10' || CAST(page_id AS STRING) || '/JOB' || CAST(page_id AS STRING) || '?x=1'
  WHEN 1 THEN 'https://www.efinancialcareers.com/jobs-London-Analyst.ID0' || CAST(1000 + page_id AS STRING)
  WHEN 2 THEN 'https://stackoverflow.com/jobs/' || CAST(page_id AS STRING) || '/dev-at-x'
  WHEN 3 THEN 'https://www.monster.com/job-openings/a--0A1B2C3D-1111-2222-3333-' || CAST(444400000000 + page_id AS STRING)
  WHEN 4 THEN 'https://www.stepstone.de/stellenangebote--Koch-Berlin--' || CAST(1000000 + page_id AS STRING) || '.html'
  WHEN 5 THEN 'https://www.pracuj.pl/praca/kierowca,oferta,' || CAST(10000 + page_id AS STRING)
  WHEN 6 THEN 'https://www.jobs.cz/rpd/' || CAST(1000000 + page_id AS STRING) || '/' || CASE WHEN page_id % 3 = 0 THEN '?page=2' ELSE '' END
  ELSE 'https://www.pracuj.pl/firma/x,' || CAST(10000 + page_id AS STRING) END AS url
FROM pages""",
    "v_raw_pages": """SELECT p.page_id, u.board, u.url, CASE WHEN p.page_id % 5 = 0 THEN substr(p.html, 1, 300)
  WHEN p.page_id % 7 = 0 THEN p.html || '<p>Please Enable Cookies</p>' WHEN p.page_id % 11 = 0 THEN p.html || '<p>Error 404</p>'
  WHEN p.page_id % 13 = 0 THEN NULL WHEN p.page_id % 17 = 0 THEN repeat('<p>', 200) ELSE p.html END AS html
FROM pages p JOIN v_job_urls u ON u.page_id = p.page_id""",
    "v_ld_pages": """SELECT p.page_id, u.board, u.url, CASE p.page_id % 5
 WHEN 0 THEN '<script type="application/ld+json">{"@type":"JobPosting","title":" Job  ' || CAST(p.page_id AS STRING) || ' ","datePosted":"2020-01-02","employmentType":"FULL_TIME","validThrough":"2020-02-02","hiringOrganization":{"name":"Org"},"jobLocation":{"address":{"addressLocality":"Bern","addressRegion":"BE","addressCountry":"CH","postalCode":"3000"}},"description":"<p>Text <b>' || CAST(p.page_id AS STRING) || '</b>&amp;more</p>"}</script>'
 WHEN 1 THEN '<script type="application/ld+json">[{"@type":"WebSite"},{"@type":"JobPosting","title":"Arr ' || CAST(p.page_id AS STRING) || '","jobLocation":[{"address":{"addressLocality":"Zug"}}]}]</script>'
 WHEN 2 THEN '<script type="application/ld+json">{"@type":"JobPosting","title":"","datePosted":"2019-05-06","hiringOrganization":{"name":"Left"}}</script>'
 WHEN 3 THEN '<script type="application/ld+json">{"@type":"Product","title":"no"}</script><script type="application/ld+json">{"@type":"JobPosting","title":"Second ' || CAST(p.page_id AS STRING) || '"}</script>'
 ELSE '<script type="application/ld+json">{broken</script>' END || p.html AS html
FROM pages p JOIN v_job_urls u ON u.page_id = p.page_id""",
    "v_marked_pages": """SELECT p.page_id, u.board, u.url, '<html><body><!-- <h1>Old</h1> --><h1>Job <b>No</b> ' || CAST(p.page_id AS STRING) || ' &amp; Co</h1>'
 || '<div class="top company-box"> Acme <i>' || CAST(p.page_id % 3 AS STRING) || '</i> </div><span class=' || q || 'company' || q || '>Firm ' || CAST(p.page_id % 3 AS STRING) || '</span>'
 || '<span class=' || q || 'Location' || q || '>Bern , BE, CH</span><time datetime=' || q || '2018-03-0' || CAST(1 + p.page_id % 9 AS STRING) || q || '>x</time>'
 || '<li class=' || q || 'employment' || q || '>Full&nbsp;time</li><div class=' || q || 'job-description' || q || '> Do <div>this <p>and</p></div> that<script>var x=1;</script> ' || CAST(p.page_id AS STRING) || '</div><div>tail</div>'
 || p.html AS html
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN '"' WHEN 1 THEN '''' ELSE '' END AS q FROM pages) p JOIN v_job_urls u ON u.page_id = p.page_id""",
    "v_gaps": """SELECT page_id, 'https://web.archive.org/web/20200101000000/' || CAST(page_id AS STRING) AS wayback_url,
  CASE page_id % 3 WHEN 0 THEN 'kept ' || CAST(page_id AS STRING) WHEN 1 THEN '  ' ELSE NULL END AS description
FROM pages""",
    "v_gap_pages": """SELECT 'https://web.archive.org/web/20200101000000/' || CAST(page_id AS STRING) AS wayback_url,
  CASE page_id % 6
   WHEN 0 THEN '<script type="application/ld+json">{"@type":"JobPosting","description":"<p>From data ' || CAST(page_id AS STRING) || '</p>"}</script>' || html
   WHEN 1 THEN '<div class="x listing-content js"><div>Block</div><div class="similar-jobs">drop <div>me</div></div> ' || repeat('word' || CAST(page_id AS STRING) || ' ', 60) || '<b>end</b></div><p>after</p>' || html
   WHEN 2 THEN '<div class="richtext a">One ' || repeat('rich' || CAST(page_id AS STRING) || ' ', 30) || '</div><p>gap</p><div class="b richtext">Two ' || repeat('text ', 30) || '</div>' || html
   WHEN 3 THEN '<section itemprop="description">Section ' || repeat('part' || CAST(page_id AS STRING) || ' ', 60) || '</section>' || html
   WHEN 4 THEN '<div itemprop="description">too short</div>' || html
   ELSE html || '<p>captcha</p>' END AS html
FROM pages""",
    "v_eval": """SELECT d.doc_id, d.text AS description,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'IT' WHEN l.quality = 1 THEN 'Finance' WHEN l.toxic = 0 THEN 'HR' ELSE 'Other' END AS true_label,
  CASE WHEN d.n_chars > 600 THEN 'IT' WHEN d.n_chars > 300 THEN 'Finance' ELSE 'HR' END AS predicted_label,
  CASE d.lang WHEN 'en' THEN 'EN' WHEN 'de' THEN 'DE' WHEN 'pl' THEN 'PL' ELSE 'Other_Lang' END AS language
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "v_files": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'stackoverflow' WHEN 1 THEN 'efinancialcareers' WHEN 2 THEN 'stepstone_de' WHEN 3 THEN 'pracuj_pl'
    WHEN 4 THEN 'ch_data' WHEN 5 THEN 'dice_com' ELSE 'monster_com' END
  || CASE doc_id % 5 WHEN 0 THEN '_jobs_dedup.csv' WHEN 1 THEN '_dedup.csv' WHEN 2 THEN '_cleaned.csv' WHEN 3 THEN '_jobs.csv' ELSE '.csv' END AS file_name
FROM documents""",
    "v_adverts": """SELECT doc_id, text || CASE doc_id % 9 WHEN 0 THEN ' Python3 und PL/SQL, k8s.' WHEN 1 THEN ' MS Excel, VLOOKUP; Java 11!' WHEN 2 THEN ' machine learning/ML on AWS'
    WHEN 3 THEN ' python4 sqlx notgit' WHEN 4 THEN ' US GAAP+IFRS (Bloomberg Terminal)' WHEN 5 THEN ' Scrum' WHEN 6 THEN ' talent acquisition with an applicant tracking system' ELSE '' END AS description
FROM documents""",
    "v_overlap_names": """SELECT * FROM (VALUES ('Java','Specialized Skill'), ('Java Script','Specialized Skill'), ('JavaScript','Specialized Skill'),
 ('Script','Specialized Skill'), ('C','Specialized Skill'), ('C++','Specialized Skill'), ('C#','Specialized Skill'), ('.NET','Specialized Skill'),
 ('ASP.NET','Certification'), ('Machine Learning','Specialized Skill'), ('Learning Data','Specialized Skill'), ('Data','Specialized Skill'),
 ('Data Lake','Specialized Skill'), ('Lake','Specialized Skill'), ('SQL','Specialized Skill'), ('T-SQL','Certification')) t(name, type_name)""",
    "v_overlap_texts": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'java script' WHEN 1 THEN 'C++/C#' WHEN 2 THEN 'asp.net' WHEN 3 THEN 'machine learning data lake' ELSE 'T-SQL' END
 || CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN ', ' WHEN 2 THEN '.' ELSE '' END
 || CASE doc_id % 7 WHEN 0 THEN 'JAVASCRIPT' WHEN 1 THEN '.NET' WHEN 2 THEN 'c c++ c' WHEN 3 THEN 'data  lake' WHEN 4 THEN 'Java Java Script Script' WHEN 5 THEN 'learning data, sql' ELSE 'x.net' END
 || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '-' END || text AS body FROM documents""",
    "v_places": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || ', ' || c_mktsegment WHEN 2 THEN '  ' || c_name || ' ,  ' || c_mktsegment || ', US ' ELSE NULL END AS location
FROM customer""",
    "v_dates": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN iso WHEN 1 THEN replace(iso, '-', '') || '134501' WHEN 2 THEN iso || 'T08:30:00Z' WHEN 3 THEN 'Posted 3 days ago'
    WHEN 4 THEN substr(iso, 9, 2) || '.' || substr(iso, 6, 2) || '.' || substr(iso, 1, 4) WHEN 5 THEN ' ' || iso || ' ' ELSE NULL END AS raw
FROM (SELECT doc_id, CAST(DATE '2010-01-01' + CAST((doc_id * 7919) % 5479 AS INT) AS STRING) AS iso FROM documents) x""",
}


def needed(sql: str) -> list[str]:
    """Views a query names, those they need first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """The query with the views it names in a WITH clause."""
    views = needed(sql)
    if not views:
        return sql
    clause = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in views)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {clause},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {clause},\n{body[5:]}"
    return f"WITH {clause}\n{body}"


class Inputs:
    """The given tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def texts(self, name: str) -> DataFrame:
        """A table of long texts.  One in fewer splits than cores is spread over the cores, as
        its cost is computing; a large one has far more splits and is read as it is."""
        table = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                table = self.texts(name) if name in ("documents", "pages") else self.table(name)
                table.createOrReplaceTempView(name)
        return self.spark.sql(full)

    def postings(self) -> DataFrame:
        return self.view("v_postings")

    def baskets(self) -> DataFrame:
        """``v_baskets`` with one row per posting and arrays of skills.

        Order lines meet their orders on the order key and are gathered under the same key,
        so the second step needs no further shuffle.
        """
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        parts = self.table("part").select("p_partkey", "p_name", "p_type")
        sold = lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "p_name", "p_type")
        skills = sold.groupBy("l_orderkey").agg(
            F.array_sort(F.collect_set("p_name")).alias("hard_skills"),
            F.array_sort(F.collect_set("p_type")).alias("soft_skills"))
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        nation = F.col("c_nationkey") % 5
        country = (F.when(nation == 0, "CH").when(nation == 1, "PL").when(nation == 2, "DE")
                   .when(nation == 3, "US").otherwise("CZ"))
        urgency = F.substring("o_orderpriority", 1, 1)
        domain = F.when(urgency == "1", "IT").when(urgency == "2", "Finance").otherwise("HR")
        none = F.array().cast("array<string>")
        return (orders.join(customers, orders.o_custkey == customers.c_custkey)
                .join(skills, orders.o_orderkey == skills.l_orderkey, "left")
                .select(F.col("o_orderkey").alias("posting_id"), F.year("o_orderdate").alias("year"),
                        country.alias("country"), domain.alias("domain_label"),
                        F.coalesce("hard_skills", none).alias("hard_skills"),
                        F.coalesce("soft_skills", none).alias("soft_skills")))
