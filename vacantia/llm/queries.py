"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import (
    checks, conversations, divergence, leaks, licences, lm, mixing, pieces, quality, secret_scan, similar, token_files, toxicity, url_lists,
)
from vacantia.sources.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build):
        QUERIES[name] = build
        if check:
            ORACLES[name] = check
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op9_host_quality", checks.QUALITY)
def op9_host_quality(spark, folder):
    found = quality.assess(table(spark, folder, "documents"))
    return found.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query("op1_pareto_mix", checks.MIX)
def op1_pareto_mix(spark, folder):
    found = mixing.sample(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


@query("op4_benchmark_leaks")
def op4_benchmark_leaks(spark, folder):
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.leaked_items(found).select(
        F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "windows", "edits")


@query("op5_token_files")
def op5_token_files(spark, folder):
    found = token_files.token_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op2_secret_index", checks.SECRETS)
def op2_secret_index(spark, folder):
    found = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind_no"] < len(secret_scan.BASE))
    return found.select(
        F.col("key").alias("doc_id"), *[secret_scan.number_of(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans"))


@query("op6_jaccard_groups", checks.GROUPS)
def op6_jaccard_groups(spark, folder):
    found = similar.shingle_groups(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


@query("op10_interpolated_scores")
def op10_interpolated_scores(spark, folder):
    return lm.score(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


@query("op7_licence_sentences", checks.LICENCES)
def op7_licence_sentences(spark, folder):
    found = licences.scan(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.array_join("sentences", ",").alias("sentences"),
                        F.array_join("licences", ",").alias("licences"))


def number(column, digits: int = 7):
    """A number made of a text, the same in every engine."""
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def dated_captures(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2021-01-01").cast("date"), (F.col("page_id") * 37 % 1461).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Lists made of the pages' own hosts: which patterns enter a list, and the days they enter,
    leave and come back, follow from the pattern's hash."""
    host = url_lists.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    first = F.concat(host, F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]+)", 1))
    patterns = pages.select(F.explode(F.array(host, parent, first)).alias("pattern")).distinct().filter("pattern != ''")
    n = number(F.col("pattern"))
    start = F.date_add(F.lit("2020-06-01").cast("date"), (n % 1200).cast("int"))
    lists = F.array(F.when(n % 4 == 0, F.lit("spam")), F.when(n % 5 == 0, F.lit("adult")), F.when(n % 7 == 0, F.lit("trusted")))
    days = F.array(*[F.date_add(start, (gap * (n % 300 + 1)).cast("int")) for gap in (0, 1, 2, 4)])
    added = F.array(*map(F.lit, (True, False, True, False)))
    listed = patterns.select("pattern", F.explode(F.array_compact(lists)).alias("list"), days.alias("day"), added.alias("added"))
    return (listed.select("list", "pattern", F.explode(F.arrays_zip("day", "added")).alias("s"))
            .select("list", "pattern", "s.day", "s.added"))


@query("op8_dated_url_lists", checks.URLS)
def op8_dated_url_lists(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    entries = stored(dated_entries(pages), "url-entries")
    return url_lists.judged(dated_captures(pages), entries, ["spam", "adult"]).select(
        "page_id", "day", "n_active", "pattern", "list", "blocked")


@query("op3_toxicity_grades")
def op3_toxicity_grades(spark, folder):
    documents = table(spark, folder, "documents")
    labelled = toxicity.graded(documents, table(spark, folder, "labels"), "doc_id", "text", "toxic")
    chosen = toxicity.choose(labelled)
    model = toxicity.train(toxicity.split_severe(toxicity.vectors(labelled, chosen)), chosen, 3)
    found = toxicity.predict(documents, model)
    return found.select(F.col("key").alias("doc_id"), "expected_severity", "grade", (F.col("grade") > 0).alias("toxic"))


@query("op12_merge_pieces")
def op12_merge_pieces(spark, folder):
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, folder, "documents"), model), model)
    numbers = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that follow from a checksum of each row's place."""
    blank = F.lit(" ")
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(place) % 20
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


@query("op13_conversation_auction")
def op13_conversation_auction(spark, folder):
    turns = table(spark, folder, "conversations")
    repaired = stored(conversations.repair(damaged(turns)), "conversation-repairs")
    found = conversations.report(repaired).join(conversations.digests(repaired), "conv_key").withColumnRenamed("conv_id", "id")
    originals = turns.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return originals.join(found, originals.conv_id.eqNullSafe(found.id), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op11_source_divergence", checks.DIVERGENCE)
def op11_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))
