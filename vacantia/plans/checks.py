"""Pieces of the checking SQL, written for the checking engine and apart from the operators."""

from __future__ import annotations

from vacantia import rules

WS = (r"[\s\x0B\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
HARD = ("Ci", "De La", "For", "From", "Für", "In The", "Of The", "Que La", "To The")
SOFT = ("And", "Der", "It Is", "Que")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _boards(table: dict, board: str, make, default: str) -> str:
    branches = " ".join(f"WHEN {board} = '{b}' THEN {make(rule)}" for b, rule in table.items())
    return f"(CASE {branches} ELSE {default} END)"


def is_job_url(url: str, board: str) -> str:
    required = _boards(rules.URL_REQUIRED, board, lambda patterns: " AND ".join(
        f"regexp_matches(lower({url}), {_quoted(p)})" for p in patterns), "FALSE")
    excluded = _boards(rules.URL_EXCLUDES, board, lambda texts: " OR ".join(
        f"contains(lower({url}), {_quoted(t)})" for t in texts), "TRUE")
    return f"({required} AND NOT {excluded})"


def is_junk(html: str, board: str) -> str:
    marked = _boards(rules.JUNK_MARKERS, board, lambda texts: "(" + " OR ".join(
        f"contains(lower({html}), {_quoted(t)})" for t in texts) + ")", "FALSE")
    return (f"(coalesce(length(regexp_replace({html}, '^{WS}+|{WS}+$', '', 'g')) < 500, TRUE) "
            f"OR coalesce({marked}, FALSE))")


def country_of_url(url: str) -> str:
    branches = " ".join(f"WHEN contains(lower({url}), '{k}') THEN '{c}'" for k, c in rules.URL_COUNTRIES)
    return f"CASE {branches} ELSE '' END"


# Character references of the check, its own short list, Polish and Czech letters among them.
CHECK_ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&auml;", "ä"), ("&szlig;", "ß"),
    ("&eacute;", "é"), ("&aacute;", "á"), ("&iacute;", "í"), ("&lstrok;", "ł"), ("&sacute;", "ś"), ("&aogon;", "ą"),
    ("&Scaron;", "Š"), ("&ccaron;", "č"), ("&rcaron;", "ř"), ("&frac12;", "½"), ("&mdash;", "—"),
    ("&copy;", "©"), ("&middot;", "·"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&euro;", "€"), ("&hellip;", "…"),
)


def _decoded(text: str) -> str:
    for name, char in (*CHECK_ENTITIES, ("&amp;", "&")):
        text = f"replace({text}, '{name}', {_quoted(char)})"
    return text


def _noise_free(html: str) -> str:
    return (rf"regexp_replace({html}, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
            rf"|<template\b[^>]*>.*?</template\s*>', ' ', 'g')")


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def marked_text(html: str, key: str) -> str:
    """Markup with character references of the check before it."""
    listed = " || ".join(f"CASE WHEN {key} % {n + 2} = 0 THEN '{name}x' ELSE ' ' END" for n, (name, _) in enumerate(CHECK_ENTITIES))
    return f"'<p>Pr&aacute;ce ' || {listed} || '&unknown; &amp;lstrok;</p>' || {html}"


def html_text(html: str) -> str:
    return _collapsed(_decoded(f"regexp_replace({_noise_free(html)}, '</?[a-zA-Z!?][^>]*>', ' ', 'g')"))


def run_together(html: str) -> str:
    joined = f"regexp_replace({html}, '{WS}*(</?[a-zA-Z!?][^>]*>{WS}*)+', '', 'g')"
    return _collapsed(_decoded(joined))


def _present(text: str, variants) -> str:
    words = "|".join(variants)
    return f"regexp_matches(lower(coalesce({text}, '')), '(^|[^a-z0-9_])({words})($|[^a-z0-9_])')"


def synonyms(text: str) -> str:
    parts = ", ".join(f"CASE WHEN {_present(text, rules.SKILL_SYNONYMS[name])} THEN '{name}' END"
                      for name in sorted(rules.SKILL_SYNONYMS))
    return f"concat_ws('|', {parts})"


def _taxonomy_cases(text: str, kind: str) -> str:
    names = HARD if kind == "hard" else SOFT
    return ", ".join(f"CASE WHEN {_present(text, [n.lower()])} THEN '{n}' END" for n in names)


def taxonomy(text: str, kind: str) -> str:
    return f"concat_ws('|', {_taxonomy_cases(text, kind)})"


def taxonomy_list(text: str, kind: str) -> str:
    return f"list_filter([{_taxonomy_cases(text, kind)}], lambda x: x IS NOT NULL)"


def _using(keys, left: str, right: str) -> str:
    return " AND ".join(f"{left}.{k} = {right}.{k}" for k in keys)


def trends(column: str, keys, condition: str, top: int = 30) -> str:
    names = ", ".join(keys)
    return f"""WITH b AS (SELECT * FROM v_baskets WHERE {condition}),
t AS (SELECT {names}, count(DISTINCT posting_id) AS total_jobs FROM b GROUP BY {names}),
c AS (SELECT {names}, {column} AS skill, count(DISTINCT posting_id) AS skill_count FROM b WHERE {column} IS NOT NULL GROUP BY {names}, {column}),
r AS (SELECT c.*, t.total_jobs, c.skill_count / t.total_jobs * 100 AS percentage,
  row_number() OVER (PARTITION BY {", ".join("c." + k for k in keys)} ORDER BY c.skill_count / t.total_jobs * 100 DESC, c.skill) AS rn
  FROM c JOIN t ON {_using(keys, "c", "t")} WHERE t.total_jobs >= 30)
SELECT {names}, skill, skill_count, total_jobs, round(percentage, 6) AS percentage FROM r WHERE rn <= {top}"""


def all_trends() -> str:
    return "WITH " + _all_trends("""SELECT domain_label, 'hard' AS kind, country, year, posting_id, hard_skill AS skill FROM v_baskets
  UNION ALL SELECT domain_label, 'soft', country, year, posting_id, soft_skill FROM v_baskets""", 30)


def domain_trends(min_jobs: int) -> str:
    listed = " UNION ALL ".join(
        f"SELECT domain_label, '{kind}' AS kind, country, year, doc_id AS posting_id, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS skill "
        f"FROM (SELECT *, {taxonomy_list('description', kind)} AS s FROM d) e" for kind in ("hard", "soft"))
    return f"""WITH d AS (SELECT doc_id, domain_label, description, CASE WHEN source = 'ch' THEN coalesce(country, 'CH') ELSE country END AS country,
  CAST(coalesce(strftime(try_cast(date_posted AS DATE), '%Y'), substr(timestamp, 1, 4)) AS INT) AS year FROM v_postings WHERE domain_label <> 'Other'),
""" + _all_trends(listed, min_jobs)


def _all_trends(long: str, min_jobs: int) -> str:
    keys = ("domain_label", "kind", "country", "year")
    names = ", ".join(keys)
    return f"""k AS ({long}),
b AS (SELECT domain_label, kind, '*' AS country, year, posting_id, skill FROM k
  UNION ALL SELECT domain_label, kind, country, year, posting_id, skill FROM k WHERE country IN ('CH','PL','DE','US')),
t AS (SELECT {names}, count(DISTINCT posting_id) AS total_jobs FROM b GROUP BY {names}),
c AS (SELECT {names}, skill, count(DISTINCT posting_id) AS skill_count FROM b WHERE skill IS NOT NULL GROUP BY {names}, skill),
r AS (SELECT c.*, t.total_jobs, c.skill_count / t.total_jobs * 100 AS percentage,
  row_number() OVER (PARTITION BY c.domain_label, c.kind, c.country, c.year ORDER BY c.skill_count / t.total_jobs * 100 DESC, c.skill) AS rn
  FROM c JOIN t ON {_using(keys, "c", "t")} WHERE t.total_jobs >= {min_jobs})
SELECT {names}, skill, skill_count, total_jobs, round(percentage, 6) AS percentage FROM r WHERE rn <= 30"""


PROFILE = r"""WITH base AS (SELECT source, description, try_cast(date_posted AS DATE) AS d,
  description IS NOT NULL AND trim(description) <> '' AS valid FROM v_postings),
profile AS (SELECT s.*, coalesce(m.country, '?') AS country, coalesce(m.sector, '?') AS sector, coalesce(m.region, '?') AS region,
  CASE WHEN 100 - missing_pct >= 80 THEN 'high' WHEN 100 - missing_pct >= 40 THEN 'moderate' ELSE 'low' END AS fill_band
  FROM (SELECT source, count(*) AS total_vacancies, count(*) FILTER (valid) AS valid_desc,
    round((count(*) - count(*) FILTER (valid)) / count(*) * 100, 1) AS missing_pct,
    CAST(coalesce(floor(avg(length(description)) FILTER (valid)), 0) AS BIGINT) AS avg_desc_length,
    coalesce(strftime(min(d), '%Y-%m-%d'), 'N/A') AS oldest_record, coalesce(strftime(max(d), '%Y-%m-%d'), 'N/A') AS newest_record,
    count(DISTINCT year(d)) AS years_covered FROM base GROUP BY source) s LEFT JOIN v_source_meta m ON m.source = s.source)"""


# Boards of three layouts: their description and date columns are named differently or absent.
MIXED = PROFILE.replace("FROM v_postings)", """FROM (SELECT source, date_posted,
  CASE WHEN source IN ('ch', 'monster') THEN NULL ELSE description END AS description FROM v_postings) b)""") + " SELECT * FROM profile"


def null_rates(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT source, '{c}' AS column_name, round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 1) AS null_pct "
        "FROM v_postings GROUP BY source" for c in columns)


YEARS = """SELECT source, CAST(year(try_cast(date_posted AS DATE)) AS INT) AS year FROM v_postings
  WHERE year(try_cast(date_posted AS DATE)) BETWEEN 2010 AND 2025"""


def yearly_pivot(sources) -> str:
    counts = ", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in sources)
    return f"SELECT year, {counts} FROM ({YEARS}) y GROUP BY year"


def coverage(sources) -> str:
    listed = ", ".join(f"('{s}')" for s in sources)
    return f"""WITH y AS ({YEARS}), g AS (SELECT a.year, s.source FROM (SELECT DISTINCT year FROM y) a CROSS JOIN (VALUES {listed}) s(source)),
c AS (SELECT g.year, g.source, (SELECT count(*) FROM y WHERE y.year = g.year AND y.source = g.source) AS n FROM g)
SELECT year, source, n, round(n / greatest(max(n) OVER (PARTITION BY source), 1), 6) AS relative FROM c"""


HISTOGRAM = """WITH l AS (SELECT source, least(length(description), 10000) AS chars FROM v_postings WHERE length(description) > 50),
s AS (SELECT source, min(chars) AS low, max(chars) AS high, median(chars) AS median_chars FROM l GROUP BY source),
n AS (SELECT l.source, CASE WHEN s.high = s.low THEN 25 ELSE least(((l.chars - s.low) * 50) // (s.high - s.low), 49) END AS bin, count(*) AS n
  FROM l JOIN s ON s.source = l.source GROUP BY ALL)
SELECT s.source, CAST(b.bin AS INT) AS bin, coalesce(n.n, 0) AS n, CAST(s.low AS INT) AS low, CAST(s.high AS INT) AS high, s.median_chars
FROM s CROSS JOIN (SELECT unnest(range(50)) AS bin) b LEFT JOIN n ON n.source = s.source AND n.bin = b.bin"""


def labelled(caps: dict) -> str:
    finance, hr, other = (rules.TITLE_MARKERS[k] for k in ("Finance", "HR", "Other"))
    cap = " ".join(f"WHEN '{k}' THEN {v}" for k, v in caps.items())
    return f"""WITH pool AS (
  SELECT doc_id, 'IT' AS label FROM v_postings WHERE title IS NOT NULL AND source = 'stackoverflow' UNION ALL
  SELECT doc_id, 'Finance' FROM v_postings WHERE source = 'efinancialcareers' AND regexp_matches(title, '(?i){finance}') UNION ALL
  SELECT doc_id, 'HR' FROM v_postings WHERE regexp_matches(title, '(?i){hr}') UNION ALL
  SELECT doc_id, 'Other' FROM v_postings WHERE regexp_matches(title, '(?i){other}'))
SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS STRING) || '-42')) AS rn FROM pool) r
WHERE rn <= CASE label {cap} END"""


def _each(form: str, separator: str = ", ") -> str:
    return separator.join(form.format(c=c) for c in rules.LABELS)


NB_MODEL = r"""WITH ranked AS (SELECT *, count(*) OVER (PARTITION BY domain_label) AS n,
  row_number() OVER (PARTITION BY domain_label ORDER BY md5(CAST(doc_id AS STRING) || '-42')) AS rn FROM v_postings),
tr AS (SELECT * FROM ranked WHERE rn > round(0.2 * n) AND description IS NOT NULL),
w AS (SELECT domain_label, unnest(regexp_extract_all(lower(description), '[\p{L}\p{N}_]+')) AS word FROM tr),
""" + "c AS (SELECT word, " + _each("count(*) FILTER (domain_label = '{c}') AS n_{c}") + """ FROM w GROUP BY word),
s AS (SELECT count(*) AS words, """ + _each("sum(n_{c}) AS t_{c}") + """ FROM c),
model AS (SELECT c.*, """ + _each("ln((n_{c} + 1) / (s.t_{c} + s.words)) AS score_{c}") + " FROM c CROSS JOIN s)"

_NB_SCORES = r""", d AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(description, 'No description provided')), '[\p{L}\p{N}_]+')) AS word FROM v_postings),
""" + "q AS (SELECT d.doc_id, " + _each("sum(m.score_{c}) AS score_{c}") + """ FROM d JOIN model m ON m.word = d.word GROUP BY d.doc_id),
pr AS (SELECT """ + _each("ln(count(*) FILTER (domain_label = '{c}') / count(*)) AS p_{c}") + """ FROM tr),
z AS (SELECT v.doc_id, """ + _each("coalesce(q.score_{c}, 0) + pr.p_{c} AS score_{c}") + """
  FROM v_postings v CROSS JOIN pr LEFT JOIN q ON q.doc_id = v.doc_id)"""
_NB_LABEL = "CASE greatest(" + _each("score_{c}") + ") " + _each("WHEN score_{c} THEN '{c}'", " ") + " END AS predicted_label"
NB_PREDICT = _NB_SCORES + " SELECT doc_id, " + _each("round(score_{c}, 4) AS score_{c}") + f", {_NB_LABEL} FROM z"

LR_OPTIMUM = NB_MODEL + """ SELECT domain_label AS label, count(*) AS texts, CAST(count(*) AS DOUBLE) AS expected_texts,
  TRUE AS at_optimum FROM tr GROUP BY domain_label"""


def language(text: str) -> str:
    words = rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+')"
    hits = {name: f"len(list_intersect({words}, [{', '.join(map(_quoted, listed))}]))"
            for name, listed in rules.STOPWORDS.items()}
    best = f"greatest({', '.join(hits.values())})"
    cases = " ".join(f"WHEN {h} THEN '{n}'" for n, h in hits.items())
    return f"CASE WHEN {best} = 0 THEN 'Unknown' ELSE CASE {best} {cases} END END"


_TONGUES = ("de", "en", "es", "fr")


def letters_of(text: str) -> str:
    return rf"regexp_replace(' ' || lower(coalesce({text}, '')) || ' ', '[^\p{{L}}]+', ' ', 'g')"


def _grams(text: str) -> str:
    """All runs of one to three characters: runs side by side from each of the first places."""
    runs = " || ".join(f"regexp_extract_all(substr(p, {place + 1}), '{'.' * n}')" for n in (1, 2, 3) for place in range(n))
    return f"(SELECT {runs} FROM (SELECT {letters_of(text)} AS p))"


def _tongues(form: str, separator: str = ", ") -> str:
    return separator.join(form.format(t=t) for t in _TONGUES)


LANGUAGE_SPLIT = """ranked_docs AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n,
  row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS STRING) || '-42')) AS rn FROM documents WHERE lang IS NOT NULL)"""
GRAM_PROFILES = f"""WITH {LANGUAGE_SPLIT},
gram_rows AS (SELECT lang, unnest({_grams("text")}) AS gram FROM ranked_docs WHERE rn > round(0.2 * n)),
gram_counts AS (SELECT gram, {_tongues("count(*) FILTER (lang = '{t}') AS n_{t}")} FROM gram_rows GROUP BY gram),
gram_ranks AS (SELECT *, count(*) OVER () AS v, {_tongues("sum(n_{t}) OVER () AS t_{t}")},
  {_tongues("row_number() OVER (ORDER BY n_{t} DESC, gram) AS r_{t}")} FROM gram_counts),
profiles AS (SELECT gram, {_tongues("round(1000000 * ln((n_{t} + 1) / (t_{t} + v)))::BIGINT AS w_{t}")} FROM gram_ranks
  WHERE {_tongues("(r_{t} <= 3000 AND n_{t} > 0)", " OR ")})"""
GRAM_SCORES = f""", text_grams AS (SELECT k, gram, count(*) AS times FROM (SELECT k, unnest({_grams("text")}) AS gram FROM texts) GROUP BY k, gram),
gram_sums AS (SELECT k, {_tongues("sum(times * w_{t})::BIGINT AS score_{t}")} FROM text_grams JOIN profiles USING (gram) GROUP BY k),
scored AS (SELECT texts.k, {_tongues("coalesce(score_{t}, 0) AS score_{t}")}, CASE WHEN s.k IS NULL THEN 'Unknown'
  ELSE CASE greatest({_tongues("score_{t}")}) {_tongues("WHEN score_{t} THEN '{t}'", " ")} END END AS language
  FROM texts LEFT JOIN gram_sums s ON s.k = texts.k)"""


def evaluation_by(*keys: str, table: str = "v_eval", after: str = "WITH") -> str:
    names = "".join(f"{k}, " for k in keys)
    return f"""{after} x AS (SELECT {names}true_label AS label, 1 AS support, 0 AS predicted,
  CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS hit FROM {table}
  UNION ALL SELECT {names}predicted_label, 0, 1, 0 FROM {table}),
g AS (SELECT {names}label, sum(support) AS support, sum(predicted) AS predicted, sum(hit) AS hit FROM x GROUP BY {names}label),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2 * hit / (predicted + support) ELSE 0.0 END AS f1 FROM g)"""


EVALUATION = evaluation_by()

NB_EVAL = (NB_MODEL + _NB_SCORES + f""", y AS (SELECT doc_id, {_NB_LABEL} FROM z),
ev AS (SELECT domain_label AS true_label, predicted_label, {language('description')} AS language
  FROM ranked JOIN y USING (doc_id) WHERE rn <= round(0.2 * n)),
every AS (SELECT * FROM ev UNION ALL SELECT true_label, predicted_label, 'all' FROM ev)"""
           + evaluation_by("language", table="every", after=",") + """ SELECT language,
  round(sum(hit) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS sample_size FROM m GROUP BY language""")


LANGUAGE_EVAL = GRAM_PROFILES + rf""", held AS (SELECT doc_id, lang, text FROM ranked_docs WHERE rn <= round(0.2 * n)),
trials AS (SELECT 'whole' AS kind, 'w' || doc_id AS k, lang, text FROM held
  UNION ALL SELECT 'sentence', 's' || doc_id || '-' || no, lang, text FROM
    (SELECT doc_id, lang, unnest(parts) AS text, unnest(range(len(parts))) AS no
     FROM (SELECT doc_id, lang, string_split_regex(text, '[.!?\n]+') AS parts FROM held)) WHERE regexp_matches(text, '\p{{L}}')
  UNION ALL SELECT 'mixed', 'm' || h.doc_id, CASE WHEN length({letters_of("h.text")}) >= length({letters_of("d.text")}) THEN h.lang ELSE d.lang END,
    concat_ws(' ', h.text, d.text) FROM held h JOIN documents d ON d.doc_id = h.doc_id + 1 WHERE h.lang <> d.lang),
texts AS (SELECT k, text FROM trials)""" + GRAM_SCORES + f""" SELECT kind, lang, count(*) AS n, count(*) FILTER (scored.language = lang) AS profiles_right,
  count(*) FILTER ({language("trials.text")} = CASE lang WHEN 'en' THEN 'EN' WHEN 'de' THEN 'DE' ELSE 'Other_Lang' END) AS words_right
FROM trials JOIN scored ON scored.k = trials.k GROUP BY kind, lang"""


def p_value(t: str, df: str) -> str:
    """Two-sided t tail: Simpson's rule in the angle atan(t / sqrt(df))."""
    top = f"least(pi() / 2, 12 / sqrt({df}))"

    def area(low: str) -> str:
        return (f"(list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
                f" * pow(greatest(cos({low} + ({top} - {low}) * i / 400), 0.0), {df} - 1))) * ({top} - {low}) / 1200)")

    return f"({area(f'least(atan(abs({t}) / sqrt({df})), {top})')} / {area('0.0')})"


_SHARE = """b AS (SELECT DISTINCT posting_id, {keys}, {column} AS skill FROM v_baskets),
t AS (SELECT {keys}, count(DISTINCT posting_id) AS total_jobs FROM b GROUP BY {keys}),
c AS (SELECT {keys}, skill, count(*) AS skill_count FROM b WHERE skill IS NOT NULL GROUP BY {keys}, skill)"""


def _share(column: str, *keys: str) -> str:
    return _SHARE.format(keys=", ".join(keys), column=column)


OLS = f"""WITH {_share('hard_skill', 'domain_label', 'year')},
y AS (SELECT * FROM t WHERE total_jobs >= 30),
k AS (SELECT DISTINCT c.domain_label, c.skill FROM c JOIN y ON y.domain_label = c.domain_label AND y.year = c.year),
g AS (SELECT k.domain_label, k.skill, CAST(y.year AS DOUBLE) AS x, coalesce(c.skill_count, 0) / y.total_jobs * 100 AS v
  FROM k JOIN y ON y.domain_label = k.domain_label LEFT JOIN c ON c.domain_label = k.domain_label AND c.year = y.year AND c.skill = k.skill),
r AS (SELECT domain_label, skill, count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, regr_r2(v, x) AS r2,
  sqrt((regr_syy(v, x) - regr_slope(v, x) * regr_sxy(v, x)) / (count(*) - 2) / regr_sxx(v, x)) AS se FROM g GROUP BY ALL HAVING count(*) >= 3),
z AS (SELECT *, slope / se AS t_raw, CAST(n - 2 AS DOUBLE) AS df FROM r)
SELECT domain_label, skill, n AS years, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(r2, 5) AS r2,
  round(t_raw, 5) AS t_stat, round({p_value('t_raw', 'df')}, 5) AS p_value FROM z"""


def bloat(early, late) -> str:
    return f"""WITH k AS (SELECT posting_id, domain_label, year, count(DISTINCT hard_skill) AS k FROM v_baskets GROUP BY ALL),
e AS (SELECT domain_label, count(*) AS n, avg(k) AS m, var_samp(k) AS v FROM k WHERE year BETWEEN {early[0]} AND {early[1]} GROUP BY ALL),
l AS (SELECT domain_label, count(*) AS n, avg(k) AS m, var_samp(k) AS v FROM k WHERE year BETWEEN {late[0]} AND {late[1]} GROUP BY ALL),
w AS (SELECT e.domain_label, e.n AS n_early, l.n AS n_late, e.m AS mean_early, l.m AS mean_late,
  (l.m - e.m) / sqrt(l.v / l.n + e.v / e.n) AS t,
  pow(l.v / l.n + e.v / e.n, 2) / (pow(l.v / l.n, 2) / (l.n - 1) + pow(e.v / e.n, 2) / (e.n - 1)) AS df,
  sqrt(((e.n - 1) * e.v + (l.n - 1) * l.v) / (e.n + l.n - 2)) AS sp FROM e JOIN l ON l.domain_label = e.domain_label)"""


def pairs(theta: float) -> str:
    return f"""WITH {_share('hard_skill', 'domain_label', 'year')},
f AS (SELECT c.*, t.total_jobs FROM c JOIN t ON t.domain_label = c.domain_label AND t.year = c.year WHERE c.skill_count / t.total_jobs * 100 >= {theta * 100}),
p AS (SELECT a.domain_label, a.year, t.total_jobs, a.skill AS skill_a, z.skill AS skill_b, count(*) AS pair_count
  FROM b a JOIN b z ON z.posting_id = a.posting_id AND a.skill < z.skill
  JOIN t ON t.domain_label = a.domain_label AND t.year = a.year GROUP BY ALL HAVING count(*) / t.total_jobs >= {theta})"""


CONVERGENCE = f"""WITH {_share('hard_skill', 'domain_label', 'year')},
s AS (SELECT c.year, c.skill, c.domain_label, c.skill_count / t.total_jobs * 100 AS v FROM c JOIN t ON t.domain_label = c.domain_label AND t.year = c.year
  WHERE c.domain_label IN ('IT', 'Finance')),
j AS (SELECT coalesce(i.year, f.year) AS year, coalesce(i.v, 0.0) AS a, coalesce(f.v, 0.0) AS b
  FROM (SELECT * FROM s WHERE domain_label = 'IT') i FULL JOIN (SELECT * FROM s WHERE domain_label = 'Finance') f ON f.year = i.year AND f.skill = i.skill)
SELECT year, count(*) FILTER (a > 0 AND b > 0) AS shared_skills, count(*) AS all_skills,
  round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(count(*) FILTER (a > 0 AND b > 0) / count(*), 6) AS jaccard FROM j GROUP BY year"""

GEO = f"""WITH {_share('hard_skill', 'year', 'country')},
s AS (SELECT c.*, t.total_jobs, c.skill_count / t.total_jobs * 100 AS percentage FROM c JOIN t ON t.year = c.year AND t.country = c.country WHERE t.total_jobs >= 30)
SELECT s.year, s.country, s.skill, s.skill_count, s.total_jobs, round(s.percentage, 6) AS percentage,
  round(coalesce(u.percentage, 0.0), 6) AS base_percentage, round(s.percentage - coalesce(u.percentage, 0.0), 6) AS gap
FROM s LEFT JOIN s u ON u.country = 'US' AND u.year = s.year AND u.skill = s.skill WHERE s.country IN ('CH', 'PL', 'DE')"""


# Overlapping names: every place a name fits, then from left to right the longest; the token right
# behind a match starts none.
_PARTS = "regexp_extract_all(lower({}), '[a-z0-9_]+|[^a-z0-9_]')"
OVERLAP = rf"""WITH RECURSIVE e AS (SELECT name, {_PARTS.format("name")} AS g FROM v_overlap_names),
t AS (SELECT doc_id, {_PARTS.format("body")} AS p FROM v_overlap_texts),
pos AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM t),
m AS (SELECT doc_id, i, len(g) AS n, name FROM pos JOIN e ON p[i] = g[1] AND p[i:i + len(g) - 1] = g
  AND (regexp_matches(g[1], '^[a-z0-9_]') OR i = 1 OR NOT regexp_matches(p[i - 1], '^[a-z0-9_]'))
  AND (regexp_matches(g[-1], '[a-z0-9_]$') OR i + len(g) - 1 = len(p) OR NOT regexp_matches(p[i + len(g)], '^[a-z0-9_]'))),
b AS (SELECT doc_id, i, max(n) AS n, arg_max(name, n) AS name FROM m GROUP BY doc_id, i),
r AS (SELECT doc_id, min(i) AS i FROM b GROUP BY doc_id UNION ALL
  SELECT r.doc_id, min(b.i) FROM r JOIN b c ON c.doc_id = r.doc_id AND c.i = r.i JOIN b ON b.doc_id = r.doc_id AND b.i > c.i + c.n
  GROUP BY r.doc_id),
k AS (SELECT doc_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM r JOIN b USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(names, '') AS hard_skills FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""
