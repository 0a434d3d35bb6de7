"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs of
three-character strings that any match must contain (in lower case).  The index holds, for every
trigram that some query names, the distinct texts it occurs in.  A rule's candidates are the texts
found by joining the postings with its ANDs and counting, and only these are verified with the
expression.  A rule whose expression has no mandatory trigram is run over every text.

Texts are known by their digest, so copies are indexed and verified once.  All work on texts is
done by column functions.  The texts are read twice: once to index, once to verify candidates,
whose digests are broadcast while they are few; beyond that the planner shuffles both sides.

Defined cases: a null text is empty and has no secrets; repeated rows give a row each; a null key
stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import small, text_of
from vacantia.sources.tables import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The base kinds, then public formats of keys and tokens.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
FORMATS = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = (*BASE, *FORMATS)

MOST_STRINGS = 32  # alternatives of a literal stretch before it is cut
FEW = 500_000  # candidate digests (16 bytes each) that may be broadcast


# --- trigram queries ---------------------------------------------------------------

Query = frozenset  # of frozensets of trigrams: any of them, all its members
EVERYTHING = Query([frozenset()])


def either(*queries: Query) -> Query:
    """OR; an alternative that asks for more than another is dropped."""
    every = frozenset().union(*queries)
    return Query(a for a in every if not any(b < a for b in every))


def both(a: Query, b: Query) -> Query:
    return either(Query(x | y for x in a for y in b))


def of_strings(strings: frozenset[str]) -> Query:
    return either(Query(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def class_strings(members) -> frozenset[str] | None:
    found = set()
    for kind, value in members:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def sequence_query(nodes) -> tuple[frozenset[str] | None, Query]:
    """The strings a sequence matches, if they are few, or else what any match must contain."""
    query, strings, exact = EVERYTHING, frozenset([""]), True
    for kind, value in nodes:
        own, inner = node_query(kind, value)
        if own is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in own)
            continue
        exact = False
        query, strings = both(query, of_strings(strings)), own if own is not None else frozenset([""])
        query = both(query, inner)
    return (strings, of_strings(strings)) if exact else (None, both(query, of_strings(strings)))


def node_query(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is sre.LITERAL:
        return frozenset([chr(value).lower()]), EVERYTHING
    if kind is sre.IN:
        return class_strings(value), EVERYTHING
    if kind is sre.SUBPATTERN:
        return sequence_query(value[3])
    if kind is sre.BRANCH:
        parts = [sequence_query(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return frozenset().union(*[strings for strings, _ in parts]), either(*[q for _, q in parts])
        return None, either(*[q for _, q in parts])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        strings, query = sequence_query(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, EVERYTHING
        return None, query if low else EVERYTHING
    return None, EVERYTHING


def trigram_query(rule: Rule) -> Query:
    """An OR of ANDs of trigrams; one empty AND if the rule has no mandatory trigram."""
    return sequence_query(parser.parse(rule.pattern))[1]


# --- index and candidates ----------------------------------------------------------

def index(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: key, digest, the trigrams of any query that occur, and the
    rules without mandatory trigrams that match.  Stored."""
    queries = {r: trigram_query(r) for r in rules}
    trigrams = sorted({t for q in queries.values() for conjunction in q for t in conjunction})
    scanned = [r for r, q in queries.items() if q == EVERYTHING]
    read = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).withColumn("low", F.lower("text"))
    grams = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(long_enough(r)), F.lit(r.kind)) for r in scanned]))
    return stored(read.select("key", F.unhex(F.md5("text")).alias("digest"), grams.alias("grams"),
                              hits.cast("array<string>").alias("hits")), "secret-index")


def long_enough(rule: Rule) -> str:
    """For a rule that is one repeated class, the expression with its least length; it matches
    the same texts as the rule and its length test."""
    found = re_repeat(rule.pattern)
    return f"{found}{{{rule.least},}}" if found and rule.group == 0 else rule.pattern


def re_repeat(pattern: str) -> str | None:
    nodes = list(parser.parse(pattern))
    if len(nodes) == 1 and nodes[0][0] is sre.MAX_REPEAT and nodes[0][1][:2] == (1, sre.MAXREPEAT):
        return pattern[:-1]
    return None


def candidates(indexed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(digest, kinds)``: the texts that a rule has to look at.  Stored."""
    spark = indexed.sparkSession
    asked = [(rule.kind, n, trigram, len(conjunction)) for rule in rules
             for n, conjunction in enumerate(sorted(trigram_query(rule), key=sorted)) for trigram in sorted(conjunction)]
    terms = spark.createDataFrame(asked, "kind string, part int, trigram string, needed int")
    postings = indexed.select("digest", F.explode("grams").alias("trigram")).distinct()
    found = (postings.join(F.broadcast(terms), "trigram").groupBy("digest", "kind", "part", "needed")
             .agg(F.count("*").alias("n")).filter("n = needed").select("digest", "kind"))
    scanned = indexed.select("digest", F.explode("hits").alias("kind"))
    return stored(found.unionByName(scanned).groupBy("digest").agg(F.collect_set("kind").alias("kinds")),
                  "secret-candidates")


# --- verification ------------------------------------------------------------------

def matches(text: Column, number: int, rule: Rule) -> Column:
    """The rule's matches in order: what lies between them, their length, the length tested."""
    pattern = long_enough(rule)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    widths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length)
    placed = F.transform(F.arrays_zip(widths.alias("w"), tested.alias("t")), lambda m, i: F.struct(
        F.lit(number).alias("kind_no"), i.alias("i"), m["w"].alias("width"), m["t"].alias("tested")))
    return F.zip_with(placed, gaps, lambda m, gap: F.when(m.isNotNull(), F.struct(
        m["kind_no"].alias("kind_no"), m["i"].alias("i"), gap.alias("gap"), m["width"].alias("width"),
        m["tested"].alias("tested"))))


def spans(docs: DataFrame, wanted: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """``(digest, kind_no, start, end)`` of every verified match, in code points.

    Lengths of matches and of the text between them are taken from the row; places are their
    running sums within one text and kind.
    """
    read = docs.select(text_of(text).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    chosen = read.join(small(wanted, FEW), "digest")
    none = F.array().cast("array<struct<kind_no:int,i:int,gap:int,width:int,tested:int>>")
    lists = [F.when(F.array_contains("kinds", r.kind), matches(F.col("text"), n, r)).otherwise(none)
             for n, r in enumerate(rules)]
    once = chosen.select("digest", F.array_compact(F.concat(*lists)).alias("m")).groupBy("digest").agg(F.any_value("m").alias("m"))
    rows = once.select("digest", F.explode("m").alias("m")).select("digest", "m.*")
    order = Window.partitionBy("digest", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("width")).over(order)
    least = F.array(*[F.lit(r.least) for r in rules])
    return (rows.withColumn("end", stop).filter(F.col("tested") >= F.get(least, F.col("kind_no")))
            .select("digest", "kind_no", (F.col("end") - F.col("width")).alias("start"), "end"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``key`` and ``found``, an array of ``(start, kind_no, end)`` by start,
    then kind; ``kind_no`` counts the rules."""
    indexed = index(docs, rules, key, text)
    located = spans(docs, candidates(indexed, rules), rules, text)
    lists = stored(located.groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end"))).alias("found")), "secret-spans")
    none = F.array().cast(lists.schema["found"].dataType)
    return indexed.select("key", "digest").join(lists, "digest", "left").select(
        "key", F.coalesce("found", none).alias("found"))


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")


def number_of(found: Column, kind: str, rules: tuple[Rule, ...] = RULES) -> Column:
    number = [r.kind for r in rules].index(kind)
    return F.size(F.filter(found, lambda s: s["kind_no"] == number)).cast("long")

