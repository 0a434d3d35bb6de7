"""Quality rules judged per host.

Each document is measured and held against a set of rules.  The failures of each rule are summed
by host (the ``source`` of a document), the hosts' failure rates are shrunk towards the corpus
rate with a beta prior estimated from the hosts themselves, and a host whose shrunk rate for any
rule exceeds ``worst`` is rejected.  The verdict is joined back: a document is kept if it passes
the base rules and its host is not rejected.

Everything is built from column functions: one pass over the texts, a map-side sum per host, a
join with the table of rejected hosts (one row per host, broadcast by the planner when it is
small; otherwise a skew join splits a host that holds much of the rows).

Defined cases: a null text has no words (and so fails); documents with a null source form one
host of their own; repeated rows count each time; an empty table gives an empty result; other
columns, whatever their names, pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import settled
from vacantia.llm.common import let, text_of, words_of
from vacantia.sources.tables import stored

MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of the words
#: A host is rejected if the shrunk share of its documents that break one rule exceeds this.
WORST = 0.6
#: The prior never weighs less or more than so many documents.
PRIOR_WEIGHT = (1.0, 1000.0)

SYMBOLS = "[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """Words lying in three-word windows found twice or more, the first ones included.

    Windows are compared by a 64-bit hash.  The hashes are sorted, so that equal ones are
    neighbours; positions are looked at only if there are any.
    """
    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def same_as_next(ordered, key):
        n = F.size(ordered)
        return F.zip_with(F.slice(ordered, 1, n - 1), F.slice(ordered, F.lit(2), n - 1),
                          lambda a, b: key(a) == key(b))

    def covered(hashes):
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p):
            equal = same_as_next(p, lambda x: x["h"])
            flags = let(equal, lambda e: F.zip_with(F.concat(F.array(F.lit(False)), e),
                                                    F.concat(e, F.array(F.lit(False))), lambda x, y: x | y))
            starts = F.filter(F.zip_with(p, flags, lambda x, f: F.when(f, x["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
        return let(placed, positions)

    def count(hashes):
        ordered = F.sort_array(hashes)
        repeats = let(ordered, lambda s: F.exists(same_as_next(s, lambda x: x), lambda x: x))
        return F.when(repeats, covered(hashes)).otherwise(F.lit(0))

    return F.when(F.size(words) >= 4, let(windows(words), count)).otherwise(F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text, in columns that begin with ``q_``."""
    whole = docs.withColumn("q_text", text_of(text))
    split = whole.withColumn("q_words", words_of(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    # A generator: a filter on what it makes is not pushed below it, where it would measure again.
    return split.withColumn("q_line_counts", line_counts).select(*docs.columns, settled(
        F.size("q_words").cast("long").alias("q_n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        F.regexp_count("q_text", F.lit(SYMBOLS)).cast("long").alias("q_n_symbols"),
        F.col("q_line_counts.again").cast("long").alias("q_n_dup_lines"),
        F.col("q_line_counts.all").cast("long").alias("q_n_lines"),
        repeat_words(F.col("q_words")).cast("long").alias("q_n_repeat_words")))


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT * F.col("q_n_words"))


def rules() -> dict[str, Column]:
    """The rules whose failures count against a host."""
    n = F.greatest(F.col("q_n_words"), F.lit(1))
    return {
        "too_short": F.col("q_n_words") < MIN_WORDS,
        "repeats": 100 * F.col("q_n_repeat_words") > MAX_REPEAT * F.col("q_n_words"),
        "symbols": 10 * F.col("q_n_symbols") > n,
        "same_lines": 10 * F.col("q_n_dup_lines") > 3 * F.col("q_n_lines"),
        "word_length": (F.col("q_n_words") > 0) & ~(F.col("q_word_chars") / n).between(3, 12),
    }


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """``(host, rule, n, failed, rate)``: failures per host and rule with the shrunk rate.

    The prior's mean is the corpus rate m.  Its weight w follows from the variance v of the
    hosts' rates about m (hosts weighed by their documents) less what sampling alone gives:
    w = m (1 - m) / v - 1, kept within ``PRIOR_WEIGHT``; the shrunk rate is
    (failed + m w) / (n + w).
    """
    named = rules()
    sums = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(rule.cast("long")).alias(name) for name, rule in named.items()])
    counts = sums.select("host", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in named])).alias("r"))
    counts = stored(counts.select("host", "n", "r.rule", "r.failed"), "host-failures")
    mean = counts.groupBy("rule").agg(F.sum("n").alias("docs"), F.count("*").alias("hosts"),
                                      (F.sum("failed") / F.sum("n")).alias("m"))
    spread = counts.join(F.broadcast(mean), "rule").groupBy("rule", "docs", "hosts", "m").agg(
        (F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.col("m"), 2)) / F.sum("n")).alias("v"))
    inner = F.col("m") * (1 - F.col("m"))
    beyond = F.greatest(F.col("v") - inner * (F.col("hosts") - 1) / F.col("docs"), F.lit(1e-9))
    low, high = PRIOR_WEIGHT
    prior = spread.select("rule", "m", F.least(F.greatest(inner / beyond - 1, F.lit(low)), F.lit(high)).alias("w"))
    return counts.join(F.broadcast(prior), "rule").select(
        "host", "rule", "n", "failed",
        ((F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))).alias("rate"))


def rejected_hosts(measured: DataFrame, host: str = "source", worst: float = WORST) -> DataFrame:
    """``(host, host_rejected)``: the hosts with a rule broken too often."""
    return stored(host_rates(measured, host).filter(F.col("rate") > worst)
                  .select("host").distinct().withColumn("host_rejected", F.lit(True)), "rejected-hosts")


def judged(measured: DataFrame, rejected: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with ``q_base_failed`` and ``q_kept``."""
    verdict = rejected.select(F.col("host").alias("q_host"), F.col("host_rejected").alias("q_rejected"))
    return (measured.join(verdict, F.col(host).eqNullSafe(F.col("q_host")), "left")
            .withColumn("q_base_failed", base_failed())
            .withColumn("q_kept", ~F.col("q_base_failed") & F.col("q_rejected").isNull())
            .drop("q_host", "q_rejected"))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
           worst: float = WORST) -> DataFrame:
    """One row per document: key, measures, ``q_base_failed``, ``q_kept``; texts are read once."""
    measured = stored(measures(docs.select(key, host, text), text).drop(text), "quality")
    return judged(measured, rejected_hosts(measured, host, worst), host)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", worst: float = WORST) -> DataFrame:
    """The documents kept, with their own columns.  Texts are read twice (hosts, then verdicts)
    instead of being shuffled or written."""
    rejected = rejected_hosts(measures(docs.select(F.col(host).alias("host"), F.col(text).alias("text"))).drop("text"), "host", worst)
    # The document travels as one column, so that its own names cannot clash.
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("q_document"),
                         F.col(text).alias("text"), F.col(host).alias("host"))
    return judged(measures(packed), rejected, "host").filter("q_kept").select("q_document.*")
