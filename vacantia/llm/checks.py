"""SQL of the registered queries, for the engine that checks them."""

from __future__ import annotations

from vacantia.llm import licences, secret_scan

SPACE = r"[\x20\x09-\x0D]"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')"

_ROUND = "on to the row that does not fit, then up to three rows that narrow the gap"
_STEP = """list_reduce(list_transform(range(start, len(sizes) + 1), lambda i: {'i': i::INT, 'w': coalesce(sizes[i], 0), 'acc': 0::DOUBLE,
      'stop': 0, 'taken': []::INT[]}), lambda x, y: CASE WHEN x.stop > 0 OR (start > 0 AND y.w > gap) THEN x
      WHEN x.acc + y.w > gap THEN {'i': x.i, 'w': x.w, 'acc': x.acc, 'stop': y.i, 'taken': x.taken}
      ELSE {'i': x.i, 'w': x.w, 'acc': x.acc + y.w, 'stop': 0, 'taken': list_append(x.taken, y.i)} END)"""


def _nearest(off: str, taken: str, fits: str) -> str:
    """The row not taken that leaves least of the gap, the first of equals."""
    return (f"list_min(list_transform(list_filter(range(1, len(sizes) + 1), lambda i: NOT list_contains({taken}, i::INT) AND sizes[i] > 0 AND {fits}),"
            f" lambda i: {{'off': abs({off} - sizes[i]), 'i': i::INT}}))")


MIX = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
-- sharing in rounds: sources above their limit stay at it, the others share the rest
u AS (SELECT *, (SELECT sum(source_size) FROM r) AS total, 3.0::DOUBLE * source_size / w AS level FROM r),
c AS (SELECT a.*, coalesce((SELECT sum(3 * b.source_size) FROM u b WHERE (b.level, b.source) < (a.level, a.source)), 0) AS capped,
             (SELECT sum(b.w) FROM u b WHERE (b.level, b.source) >= (a.level, a.source)) AS weights FROM u a),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE,
             (SELECT max((total - capped)::DOUBLE / weights) FROM c) * w) AS target FROM c),
g AS (SELECT source, length(bin(size)) AS grade, sum(size) AS words FROM d WHERE size > 0 GROUP BY 1, 2),
f AS (SELECT g.*, target, (target - 3 * coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY grade DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(words * grade) OVER (PARTITION BY g.source ORDER BY grade) AS factor
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
b AS (SELECT source, arg_max(factor, grade) AS factor FROM f WHERE factor * grade <= 3 GROUP BY source),
e AS (SELECT f.source, grade, words, target, least(3.0::DOUBLE, coalesce(b.factor * grade, 3.0::DOUBLE)) AS copies
      FROM f LEFT JOIN b ON f.source IS NOT DISTINCT FROM b.source),
n AS (SELECT source, any_value(target) - sum(words * floor(copies)) AS wanted FROM e GROUP BY source),
x AS (SELECT d.*, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p,
             (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
      FROM d LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND length(bin(d.size)) = e.grade),
q AS (SELECT x.*, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q, wanted
      FROM x LEFT JOIN n ON x.source IS NOT DISTINCT FROM n.source),
-- the order of each source, and rounds: {_ROUND}
o AS (SELECT source, any_value(wanted) AS wanted, avg(size) AS average, list(size ORDER BY q) AS sizes, list(doc_id ORDER BY q) AS ids
      FROM q WHERE q IS NOT NULL GROUP BY source),
walk AS (SELECT source, sizes, average, wanted::DOUBLE AS gap, 0 AS start, []::INT[] AS taken, NULL::DOUBLE AS best_off, []::INT[] AS best, true AS open FROM o
  UNION ALL SELECT source, sizes, average, gap, stop, taken, least(off, best_off), CASE WHEN off < best_off OR best_off IS NULL THEN filled ELSE best END,
    stop > 0 AND off > average
  FROM (SELECT *, coalesce(f.off, off2) AS off, CASE WHEN f IS NULL THEN filled2 ELSE list_append(filled2, f.i) END AS filled FROM (
    SELECT *, {_nearest("off2", "filled2", "abs(sizes[i] - off2) < off2")} AS f FROM (
    SELECT *, coalesce(f2.off, off1) AS off2, CASE WHEN f2 IS NULL THEN filled1 ELSE list_append(filled1, f2.i) END AS filled2 FROM (
    SELECT *, {_nearest("off1", "filled1", "sizes[i] <= off1")} AS f2 FROM (
    SELECT *, coalesce(f1.off, gap) AS off1, CASE WHEN f1 IS NULL THEN taken ELSE list_append(taken, f1.i) END AS filled1 FROM (
    SELECT *, {_nearest("gap", "taken", "sizes[i] <= gap")} AS f1 FROM (
    SELECT source, sizes, average, best_off, best, gap - step.acc AS gap, step.stop AS stop, taken || step.taken AS taken FROM (
    SELECT *, {_STEP} AS step FROM walk WHERE open))))))))),
more AS (SELECT unnest(list_transform(best, lambda i: ids[i])) AS doc_id FROM walk JOIN o ON walk.source IS NOT DISTINCT FROM o.source WHERE NOT open)
SELECT x.doc_id, x.size, t.source_size::BIGINT AS source_size, t.target,
       x.size * (coalesce(whole, 0) + (x.doc_id IN (SELECT doc_id FROM more))::BIGINT) AS taken
FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source"""

QUALITY = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, {WORDS} AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1),
               lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS t FROM w),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > greatest(n_words, 1),
              10 * n_dup_lines > 3 * n_lines,
              n_words > 0 AND NOT (word_chars / greatest(n_words, 1) BETWEEN 3 AND 12)] AS broken FROM m),
h AS (SELECT source, rule, count(*) AS n, sum(bad::INT) AS failed
      FROM (SELECT source, unnest(range(5)) AS rule, unnest(broken) AS bad FROM v) GROUP BY ALL),
a AS (SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(failed) / sum(n) AS m FROM h GROUP BY rule),
z AS (SELECT h.rule, m, greatest(sum(n * pow(failed / n - m, 2)) / sum(n) - m * (1 - m) * (hosts - 1) / docs, 1e-9) AS v
      FROM h JOIN a USING (rule) GROUP BY h.rule, m, hosts, docs),
bad AS (SELECT DISTINCT source FROM h JOIN (SELECT rule, m, least(greatest(m * (1 - m) / v - 1, 1), 1000) AS k FROM z) USING (rule)
        WHERE (failed + m * k) / (n + k) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM v.source) AS kept FROM v"""


def _found(number: int, rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, unnest(range(len(ms))) AS i, unnest(ms) AS m,
  unnest(ps[1:len(ms)]) AS gap, unnest(vs) AS v, {rule.least} AS least
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS vs,
             string_split_regex(text, '{pattern}') AS ps FROM d)"""


def _base_kinds() -> str:
    return ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found(n, r) for n, r in enumerate(secret_scan.RULES))}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM f),
s AS (SELECT doc_id, k, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE length(v) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE kind IN ({_base_kinds()})) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""

GROUPS = f"""WITH RECURSIVE w AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM g),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, len(sh) AS n_shingles, c.component_id FROM g
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


def _licence_steps() -> str:
    """Rules one after the other, each on what the one before left."""
    steps = ["r0 AS (SELECT doc_id, ids, coalesce(list_aggregate(list_transform(ids, lambda s: '<' || s || '>'), 'string_agg', ''), '') AS rest,"
             " []::VARCHAR[] AS found FROM i)"]
    for n, rule in enumerate(licences.RULES):
        row = "".join(f"<{s}>" for s in rule.sentences)
        steps.append(f"r{n + 1} AS (SELECT doc_id, ids, replace(rest, '{row}', '|') AS rest, CASE WHEN contains(rest, '{row}')"
                     f" AND NOT list_contains(found, '{rule.licence}') THEN list_append(found, '{rule.licence}') ELSE found END"
                     f" AS found FROM r{n})")
    return ",\n".join(steps)


_KNOWN = ", ".join(f"('{name}', ' {text.replace(' ', '  ')} ')" for name, text in licences.SENTENCES.items())
# Every place of every known sentence (spaces are doubled, so that neighbours share none), but those
# inside a longer one.
LICENCES = rf"""WITH k(name, t) AS (VALUES {_KNOWN}),
s AS (SELECT doc_id, string_split_regex(regexp_replace(lower(coalesce(text, '')), '{licences.ALONE[0]}', '\1\2 \3', 'g'), '{licences.BREAK}') AS ss
  FROM documents),
p AS (SELECT doc_id, unnest(range(len(ss))) AS no, unnest(list_transform(ss, lambda x: replace(' ' || regexp_replace(x, '[^a-z0-9]+', ' ', 'g') || ' ', ' ', '  '))) AS s FROM s),
c AS (SELECT doc_id, no, name, length(t) AS n, unnest(range(1, len(string_split(s, t)))) AS nth, string_split(s, t) AS parts FROM p JOIN k ON contains(s, t)),
h AS (SELECT doc_id, no, name, n, (list_sum(list_transform(parts[1:nth], lambda x: length(x))) + (nth - 1) * n)::BIGINT AS b FROM c),
f AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.doc_id = a.doc_id AND z.no = a.no AND z.n > a.n AND z.b <= a.b AND z.b + z.n >= a.b + a.n)),
i AS (SELECT s.doc_id, list(name ORDER BY no, b) FILTER (name IS NOT NULL) AS ids FROM s LEFT JOIN f USING (doc_id) GROUP BY s.doc_id),
{_licence_steps()}
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(array_to_string(
  CASE WHEN len(found) > 1 THEN list_filter(found, lambda x: x <> '{licences.LAST_RESORT}') ELSE found END, ','), '') AS licences
FROM r{len(licences.RULES)}"""

URLS = r"""WITH c AS (SELECT page_id, url, DATE '2021-01-01' + (page_id * 37 % 1461)::INT AS day,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT DISTINCT unnest([host, array_to_string(string_split(host, '.')[-2:], '.'),
  host || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1)]) AS pattern FROM c),
n AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS n FROM p WHERE pattern <> ''),
l AS (SELECT pattern, n, unnest(list_filter([CASE WHEN n % 4 = 0 THEN 'spam' END, CASE WHEN n % 5 = 0 THEN 'adult' END,
  CASE WHEN n % 7 = 0 THEN 'trusted' END], lambda x: x IS NOT NULL)) AS list FROM n),
v AS (SELECT pattern, list, b + (a * (n % 300 + 1))::INT AS valid_from,
  CASE WHEN a = 0 THEN b + (n % 300 + 1)::INT ELSE b + (4 * (n % 300 + 1))::INT END AS valid_to
  FROM (SELECT *, DATE '2020-06-01' + (n % 1200)::INT AS b, unnest([0, 2]) AS a FROM l)),
k AS (SELECT page_id, day, host AS key FROM c UNION SELECT page_id, day, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
    lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM c
  UNION SELECT page_id, day, unnest(list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1),
    lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:i], '/'))) FROM c),
a AS (SELECT page_id, k.day, pattern, list FROM k JOIN v ON k.key = v.pattern AND v.valid_from <= k.day AND k.day < v.valid_to),
d AS (SELECT page_id, day, count(*) AS n_active, max({'n': length(pattern), 'b': list IN ('spam', 'adult'), 'p': pattern, 'l': list}) AS m
  FROM a GROUP BY page_id, day)
SELECT c.page_id, c.day, coalesce(n_active, 0) AS n_active, m.p AS pattern, m.l AS list, coalesce(m.b, false) AS blocked
FROM c LEFT JOIN d ON c.page_id = d.page_id"""

DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v))::HUGEINT AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(p.n) + 1) // (any_value(a.n) + any_value(v)))::HUGEINT AS q
      FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) a USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM e)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o
QUALIFY part = 'pair' OR rank <= 200"""
