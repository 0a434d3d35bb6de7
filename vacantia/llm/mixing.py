"""Mixing sources to target weights by Pareto order sampling.

Every source has a target, in words.  A document's expected copies are the measure of its size
(the number of binary digits of its word count) times a factor of its source, at most ``LIMIT``;
the factor is the one that makes the expected words meet the target.  The whole part of the
expected copies is certain.  The rest p is the inclusion probability of one more copy, drawn by
Pareto order sampling: documents are ranked by the odds u / (1 - u) of a random number divided by
the inclusion odds p / (1 - p), and a sample of fixed size, in words, is the front of that order.
The front ends before the document that would exceed the words still wanted.  Up to ``FILLS``
documents behind it narrow the gap: the largest that fits, again, and at last the one whose size
comes nearest to what remains.  Where they leave more than an average document of the source, they
are put back, the document that did not fit is passed over and the order is followed further down
to the next that does not fit, and so on, to its end if need be.  The round that comes nearest
to the target counts.

The random number is a hash of the key, so a rerun draws the same documents, whatever the
partitions.  Nothing is ranked as a whole: sizes are summed by source and by 1/4096 of the range
of the ranking variable, and only the piece in which a round ends is sorted.  A document passed
over is larger than the gap it leaves, and further down only those count that fit the gap, so the
rounds are few.  What is joined to the documents is a table of at most 64 rows per source.

Defined cases: a null text has size 0 and is never taken; a null source is a source, the last;
rows with equal key and text share their draw and are taken or left together; a null key draws
like the empty text; an empty table gives an empty result; ``mix`` returns the documents' own
columns, whatever their names, a document with k copies as k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import WORD, running, text_of
from vacantia.sources.tables import stored

LIMIT = 3  # copies of a document, and a source's target in multiples of its size
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
PIECES = 4096
FILLS = 3  # that finish a round
PLACE = "struct<q:double,tie:bigint>"  # in the order of a source
SEED = "mix"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def measure(size: Column) -> Column:
    return F.length(F.bin(size))


def draw(key: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the key alone."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def rows(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """What sampling needs of each document: ``key, source, size, grade, tie``."""
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
                        F.xxhash64(F.col(key), F.col(text)).alias("tie"))
    return sized.withColumn("grade", measure(F.col("size")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``(source, source_size)`` with ``target``.

    Sources in code point order, null last, weigh ``weights``, repeating, and share all words; no
    target exceeds ``limit`` times its source, the excess is shared by weight among the others.
    With the sources by ``limit * source_size / weight``, those before some place are at their
    limit and the others get weight times a level.
    """
    ranked = running(sizes, [F.col("source").isNull(), F.col("source")], "sources", rank=F.lit(1))
    weigh = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    table = ranked.withColumn("weight", weigh.cast("long")).drop("rank").withColumn("top", limit * F.col("source_size"))
    order = [F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    table = stored(running(table, order, "targets", top_before=F.col("top"), weight_before=F.col("weight")), "targets")
    every = table.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_size") - F.col("top_before")) / (F.col("all_weight") - F.col("weight_before"))
    # The level rises while sources at their limit leave the sharing and falls thereafter.
    highest = table.crossJoin(F.broadcast(every)).agg(F.max(level).alias("level"))
    return table.crossJoin(F.broadcast(highest)).select(
        "source", "source_size", F.least(F.col("top").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def expected(units: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(source, grade)`` with ``whole`` copies and the inclusion probability ``p`` of one more."""
    graded = units.filter("size > 0").groupBy("source", "grade").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    above = Window.partitionBy("source").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("source").orderBy("grade").rowsBetween(Window.unboundedPreceding, 0)
    joined = graded.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    factors = joined.withColumn(
        "factor", (F.col("target") - limit * F.coalesce(F.sum("words").over(above), F.lit(0)))
        / F.sum(F.col("words") * F.col("grade")).over(to_here))
    # The first factor, from the largest grade on, that keeps its grade within the limit.
    fits = F.when(F.col("factor") * F.col("grade") <= limit, F.struct((-F.col("grade")).alias("g"), "factor"))
    best = factors.withColumn("best", F.min(fits).over(Window.partitionBy("source")))
    copies = F.when(F.col("best").isNull(), F.lit(float(limit))).otherwise(
        F.least(F.lit(float(limit)), F.col("best.factor") * F.col("grade")))
    return best.withColumn("copies", copies).select(
        "source", "grade", "words", "source_size", "target", F.floor("copies").cast("long").alias("whole"),
        (F.col("copies") - F.floor("copies")).alias("p"))


def odds(u: Column, p: Column) -> Column:
    """The ranking variable of Pareto sampling, from 0 to infinity."""
    return (u / (1 - u)) * ((1 - p) / p)


def plan(table: DataFrame, limit: int = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """Decisions per ``(source, grade)``: whole copies, ``p`` and what the order takes.

    ``table`` is a stored table of ``rows``; the result is stored.
    """
    units = table.groupBy("key", "source", "size", "grade", "tie").agg(F.count("*").alias("n"))
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    graded = stored(expected(units, source_targets(sizes, weights, limit), limit), "mix-grades")
    wanted = graded.groupBy("source").agg((F.first("target") - F.sum(F.col("words") * F.col("whole"))).alias("wanted"))

    ranked = stored(with_plan(units.filter("size > 0"), graded).filter("p > 0").select(
        "source", "size", "tie", (F.col("size") * F.col("n")).alias("words"), odds(draw(F.col("key")), F.col("p")).alias("q"))
        .withColumn("piece", piece()), "mix-ranked")
    per_source = followed(ranked, wanted)
    # Repeated rows are taken or left together, but where they are taken only the size of one is known.
    left_out = (ranked.join(same_source(per_source), F.col("source").eqNullSafe(F.col("s")))
                .filter((F.col("size") <= limit_here()) & (F.col("words") > limit_here()))
                .groupBy("source").agg(F.collect_list(F.struct("q", "tie")).alias("left_out")))
    per_source = (per_source.join(same_source(left_out), F.col("source").eqNullSafe(F.col("s")), "left")
                  .select("source", "steps", "fillers", F.coalesce("left_out", no_places()).alias("left_out")))
    return stored(graded.join(same_source(per_source), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "words"),
                  "mix-plan")


def followed(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, steps, fillers)``: what the order of each source takes.

    A step ``(to, most)`` says that rows before ``to`` (all, if null), and not before an earlier
    step's, are taken if they have at most ``most`` words.
    """
    average = ranked.groupBy("source").agg(F.avg("words").alias("average"))
    state = stored(wanted.join(same_source(average), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "average", F.col("wanted").alias("gap"), F.lit(None).cast(PLACE).alias("start"),
        F.array().cast(f"array<struct<to:{PLACE},most:double>>").alias("steps"), F.lit(None).cast(f"struct<off:double,steps:array<struct<to:{PLACE},most:double>>,fillers:array<{PLACE}>>").alias("best"),
        F.lit(True).alias("open")), "mix-wanted")
    while state.filter("open").limit(1).count():
        further = stored(next_step(ranked, state.filter("open")), "mix-steps")
        filled = fill(ranked, further)
        this = F.struct("off", "steps", "fillers")
        best = F.when(F.col("best").isNull() | (F.col("off") < F.col("best.off")), this).otherwise(F.col("best"))
        tried = filled.select("source", "average", "gap", F.col("to").alias("start"), "steps", best.alias("best"),
                              (F.col("to").isNotNull() & (F.col("off") > F.col("average"))).alias("open"))
        state = stored(state.filter("NOT open").unionByName(tried), "mix-followed")
    return state.select("source", "best.steps", "best.fillers")


def next_step(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """One more step: on to the first row that would exceed the gap (``to``; null, if none would).

    Rows that exceed it by themselves end the first step and are passed over by later ones.
    """
    here = F.struct("q", "tie")
    left = (ranked.join(same_source(state.select("source", "gap", "start")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .filter(F.col("start").isNull() | ((here > F.col("start")) & (F.col("words") <= F.col("gap")))))
    along = Window.partitionBy("source").orderBy("piece")
    before = F.col("to_here") - F.col("words")
    ends = stored(left.groupBy("source", "gap", "piece").agg(F.sum("words").alias("words"))
                  .withColumn("to_here", F.sum("words").over(along)).groupBy("source").agg(
                      F.min(F.when(F.col("to_here") > F.col("gap"), F.struct("piece", before.alias("before")))).alias("end"),
                      F.sum("words").alias("all_words")), "mix-ends")
    inside = left.join(same_source(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("end.piece")))
    order = Window.partitionBy("source").orderBy("q", "tie").rowsBetween(Window.unboundedPreceding, 0)
    stops = (inside.withColumn("taken", F.col("end.before") + F.sum("words").over(order))
             .filter(F.col("taken") > F.col("gap")).groupBy("source")
             .agg(F.min(F.struct("q", "tie", (F.col("taken") - F.col("words")).alias("taken"))).alias("stop")))
    steps = (ends.join(same_source(stops), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", F.when(F.col("stop").isNotNull(), F.struct("stop.q", "stop.tie")).alias("to"),
        F.coalesce("stop.taken", "all_words").alias("taken")))
    return state.join(same_source(steps), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "average", "best", "to", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"),
        F.concat("steps", F.array(F.struct("to", F.col("gap").alias("most")))).alias("steps"))


def fill(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with up to ``FILLS`` rows not taken that narrow the gap, and ``off``, what they leave."""
    per_source = state.withColumn("fillers", no_places()).withColumn("off", F.col("gap"))
    here = F.struct("q", "tie")
    off = F.abs(F.col("words") - F.col("off"))
    for number in range(FILLS):
        left = (ranked.join(same_source(per_source), F.col("source").eqNullSafe(F.col("s")))
                .filter(~F.coalesce(F.col("words") <= limit_here(), F.lit(False))
                        & ~F.array_contains("fillers", here) & (off < F.col("off"))))
        if number < FILLS - 1:  # the last may exceed the gap
            left = left.filter(F.col("words") <= F.col("off"))
        filler = left.groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "tie")).alias("f"))
        per_source = stored(per_source.join(same_source(filler), F.col("source").eqNullSafe(F.col("s")), "left").select(
            *[c for c in state.columns], F.coalesce("f.off", "off").alias("off"),
            F.when(F.col("f").isNull(), F.col("fillers"))
            .otherwise(F.concat("fillers", F.array(F.struct("f.q", "f.tie")))).alias("fillers")), "mix-fill")
    return per_source


def no_places() -> Column:
    return F.array().cast(f"array<{PLACE}>")


def piece() -> Column:
    return F.floor(F.col("q") / (1 + F.col("q")) * PIECES).cast("int")


def same_source(table: DataFrame) -> DataFrame:
    return table.withColumnRenamed("source", "s")


def limit_here() -> Column:
    """The most words a ranked row may have to be taken at its place; null behind the last step."""
    here = F.struct("q", "tie")
    return F.get(F.filter("steps", lambda s: s["to"].isNull() | (here < s["to"])), F.lit(0))["most"]


def with_plan(table: DataFrame, decisions: DataFrame) -> DataFrame:
    named = decisions.select(*[F.col(c).alias({"source": "p_source", "grade": "p_grade"}.get(c, c))
                               for c in decisions.columns])
    return (table.join(named, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("grade") == F.col("p_grade")), "left")
            .drop("p_source", "p_grade"))


def copies(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """``table`` (as from ``rows``) with ``copies``, ``source_size`` and ``target``."""
    ranked = with_plan(table, decisions).withColumn("q", F.when(F.col("p") > 0, odds(draw(F.col("key")), F.col("p"))))
    here = F.struct("q", "tie")
    more = F.col("q").isNotNull() & (
        F.coalesce((F.col("size") <= limit_here()) & ~F.array_contains("left_out", here), F.lit(False))
        | F.coalesce(F.array_contains("fillers", here), F.lit(False)))
    return ranked.withColumn("copies", F.coalesce("whole", F.lit(0)) + F.coalesce(more.cast("long"), F.lit(0)))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           limit: int = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per document: ``key, source, size, source_size, target, copies``."""
    table = stored(rows(docs, key, text, source), "mix-rows")
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, limit), "mix-targets")
    chosen = copies(table, plan(table, limit, weights)).drop("source_size", "target")
    return (chosen.join(same_source(targets), F.col("source").eqNullSafe(F.col("s")), "left")
            .select("key", "source", "size", "source_size", "target", "copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        limit: int = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken.  Texts are read twice, not moved."""
    table = stored(rows(docs, key, text, source), "mix-rows")
    decisions = plan(table, limit, weights)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("document")
    narrow = docs.select(own, F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
                         F.xxhash64(F.col(key), F.col(text)).alias("tie")).withColumn("grade", measure(F.col("size")))
    chosen = copies(narrow, decisions).filter("copies > 0")
    repeated = chosen.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("document.*")
