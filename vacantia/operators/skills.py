"""Dictionary skills in free text.

Matching: case-insensitive, leftmost then longest, not overlapping.  Word characters are
``a-z 0-9 _`` only.  A match must be followed by another character or the end and may only
start after one; the character right after a match cannot start the next match.

The text becomes tokens (a run of word characters, or one other character), so each possible
match is a run of whole tokens.  Tokens that start no entry are dropped by a hash join on the
first token; the rest try the lengths that exist for it by a second hash join.  Cost per token
does not grow with the dictionary, and only matches are shuffled, once, by posting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions.text import settled, sql_text, strip
from vacantia.operators import joins

TOKENS = r"\w+|\W"  # on lower-cased text; these classes are ASCII only and far faster than spelled-out ones
WORD = r"^\w"
SET_SIZE = 20_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))


def taxonomy_entries(taxonomy: DataFrame) -> DataFrame:
    """Taxonomy ``(name, type_name[, position])`` to ``(kind, skill, variant, position)``."""
    kind = (F.when(F.col("type_name").isin(*rules.HARD_TYPES), "hard")
            .when(F.col("type_name").isin(*rules.SOFT_TYPES), "soft"))
    position = F.col("position") if "position" in taxonomy.columns else F.lit(0)
    named = taxonomy.select(kind.alias("kind"), strip(F.col("name")).alias("skill"),
                            position.alias("position"))
    return (named.filter("kind is not null and skill <> ''")
            .groupBy("kind", "skill").agg(F.min("position").alias("position"))
            .withColumn("variant", F.lower("skill")))


def synonym_entries(spark: SparkSession, synonyms: Mapping[str, Sequence[str]] = rules.SKILL_SYNONYMS,
                    kind: str = "skill") -> DataFrame:
    rows = [(kind, skill, variant.lower(), i)
            for i, (skill, variants) in enumerate(synonyms.items()) for variant in variants]
    return spark.createDataFrame(rows, "kind string, skill string, variant string, position int")


def vocabulary(entries: DataFrame) -> DataFrame:
    """One row per kind and variant; of equal variants the last in the list wins."""
    parts = tokens(F.col("variant"))
    return (
        entries.filter("variant <> ''").groupBy("kind", "variant")
        .agg(F.max(F.struct("position", "skill")).alias("last"))
        .select("kind", F.col("variant").alias("gram"), F.col("last.skill").alias("skill"),
                F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("first"),
                F.rlike("variant", F.lit(WORD)).alias("starts_word"),
                F.rlike("variant", F.lit(r"\w$")).alias("ends_word")))


def _begins(firsts: DataFrame) -> Column | None:
    """Test whether a token starts an entry, as a constant set: far cheaper per token than a
    join, which then sees few rows.  None when the dictionary has too many first tokens."""
    found = [r["first"] for r in firsts.select("first").limit(SET_SIZE + 1).collect()]
    if len(found) > SET_SIZE:
        return None
    return F.expr(f"first IN ({', '.join(map(sql_text, found))})") if found else F.lit(False)


def _matches(docs: DataFrame, key: str, text: str, words: DataFrame, limit: int) -> DataFrame:
    """All occurrences ``(key, kind, start, n, skill)``, overlapping ones included."""
    size = words.agg(F.sum(F.octet_length("gram") + F.octet_length("skill") + 64).alias("bytes"),
                     F.max("n").alias("longest")).first()
    small = (size["bytes"] or 0) <= limit
    firsts = words.groupBy("first").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    begins = _begins(firsts) if small else None
    spread = docs.filter(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("parts"))
    # Outer generators: for inner ones Spark would filter on the size of the array first and
    # compute it twice.
    placed = spread.select(key, "parts", F.posexplode_outer("parts").alias("start", "first"))
    if begins is not None:
        placed = placed.filter(begins)
    if not small:
        # Tokens travel, so each carries its neighbourhood instead of the whole text.
        reach = F.lit((size["longest"] or 0) + 2)
        placed = placed.withColumn("parts", F.slice(
            "parts", F.greatest(F.col("start"), F.lit(1)), reach)).withColumn(
            "at", F.when(F.col("start") == 0, 1).otherwise(2))
    salt = F.concat_ws(":", F.col(key), F.col("start"))
    begun = joins.lookup_join(placed, firsts, ["first"], small, salt)
    at = F.col("start") + 1 if small else F.col("at")

    n = F.col("n")
    tried = begun.withColumn("n", F.explode_outer("lengths")).select(key, "start", settled(
        n.alias("n"), F.array_join(F.slice("parts", at, n), "").alias("gram"),
        F.get("parts", at - 2).alias("before"), F.get("parts", at - 1 + n).alias("after")))
    hits = joins.lookup_join(tried, words.drop("first"), ["gram", "n"], small, salt)

    def free(side: str) -> Column:
        return ~F.coalesce(F.rlike(side, F.lit(WORD)), F.lit(False))

    return hits.filter((F.col("starts_word") | free("before")) & (F.col("ends_word") | free("after"))
                       ).select(key, "kind", "start", "n", "skill")


def _leftmost_longest(found: Column) -> Column:
    """Distinct skills of matches kept from left to right, sorted by name.

    A skill is kept once, so the array that grows is bounded by the text's distinct skills.
    """
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("skills"))

    def step(acc: Column, match: Column) -> Column:
        known = F.array_contains(acc["skills"], match["skill"])
        skills = F.when(known, acc["skills"]).otherwise(F.concat(acc["skills"], F.array(match["skill"])))
        taken = F.struct((match["start"] - match["less"]).alias("end"), skills.alias("skills"))
        return F.when(match["start"] > acc["end"], taken).otherwise(acc)

    return F.array_sort(F.aggregate(F.array_sort(found), start, step)["skills"])


def match_skills(docs: DataFrame, key: str, text: str, words: DataFrame,
                 kinds: Mapping[str, str], limit: int = joins.BROADCAST_BYTES) -> DataFrame:
    """``(key, one array column per kind)`` for the texts with at least one match.

    ``key`` must be unique.  ``kinds`` maps a kind of the vocabulary to its output column.
    """
    hits = _matches(docs, key, text, words, limit)
    match = F.struct("start", (-F.col("n")).alias("less"), "skill")
    lists = [F.collect_list(F.when(F.col("kind") == kind, match)).alias(column)
             for kind, column in kinds.items()]
    grouped = hits.groupBy(key).agg(*lists)
    return grouped.select(key, *[_leftmost_longest(F.col(c)).alias(c) for c in kinds.values()])


def with_skills(docs: DataFrame, key: str, text: str, words: DataFrame, kinds: Mapping[str, str],
                keep: Sequence[str] | None = None, limit: int = joins.BROADCAST_BYTES) -> DataFrame:
    """``docs`` with skill arrays; a text without skills gets empty ones.

    Only the columns in ``keep`` (default: all but the text) travel to the final join.
    """
    keep = list(keep) if keep is not None else [c for c in docs.columns if c != text]
    if key not in keep:
        keep.insert(0, key)
    matched = match_skills(docs, key, text, words, kinds, limit)
    none = F.array().cast("array<string>")
    return docs.select(*keep).join(matched, key, "left").select(
        *keep, *[F.coalesce(F.col(c), none).alias(c) for c in kinds.values()])


def extract_skills(corpus: DataFrame, taxonomy: DataFrame, domain: str | None = None,
                   key: str = "doc_id", text: str = "description",
                   keep: Sequence[str] | None = None) -> DataFrame:
    """Hard and soft skills of a domain's postings (all postings without ``domain``)."""
    if domain is not None:
        corpus = corpus.filter(F.col("domain_label") == domain)
    return with_skills(corpus, key, text, vocabulary(taxonomy_entries(taxonomy)),
                       {"hard": "hard_skills", "soft": "soft_skills"}, keep)


def extract_synonyms(corpus: DataFrame, synonyms: Mapping[str, Sequence[str]] = rules.SKILL_SYNONYMS,
                     key: str = "doc_id", text: str = "description",
                     keep: Sequence[str] | None = None) -> DataFrame:
    """Canonical skills of a synonym dictionary as ``extracted_skills``."""
    words = vocabulary(synonym_entries(corpus.sparkSession, synonyms))
    return with_skills(corpus, key, text, words, {"skill": "extracted_skills"}, keep)


def explode_skills(postings: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One row per posting and skill; a posting without skills gives none."""
    return postings.select(*keys, F.explode(column).alias("skill"))
