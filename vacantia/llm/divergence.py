"""How far the sources of a language differ in their words, by exact shares.

Terms are the longest runs of letters (A-Z, a-z, everything from U+0080 on), A-Z in lower case.  A
language keeps the terms of at least ``LEAST_DOCS`` of its documents.  A group (language, source)
gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)), N being the group's
occurrences of kept terms and V their number; so does the language as a whole.  The divergence of p
from q is floor((p - q)^2 / q), summed over all kept terms for two sources of a language, and taken
term by term between a source and its language.

*Vocabulary.*  Terms are counted once per document, per task first.  Kept terms are sorted by range
and cut into shards of at most ``SHARD_TERMS``; each shard is a minimal acyclic transducer, which
turns terms into their place among the language's kept terms and back.

*Recount.*  Tasks count the distinct terms of up to ``ENTRIES`` (source, term) pairs at a time and
deal them to the shards by the shards' first terms (a list of one term per shard, which every task
gets).  A shard's rows follow its transducer in one sorted stream; its terms run through it, and
what it does not know falls out.  A frequent term is one entry per task, so that shards are even.

*Divergence* is worked out shard by shard from counts by (place, source): a term that only one or
neither of two sources has counts by the number of such terms, so that only terms that both have
are met pair by pair.  Ties among a source's terms are broken by place, which is their byte order.

The result has a row for every two sources of a language, and a shard holds at most
``SHARD_TERMS`` counts per source: the number of sources is all that must be moderate.

Defined cases: null text, language or source is the empty text; repeated rows count each time; a
group without terms has N = 0; without kept terms every divergence is 0; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import distinct, small, text_of
from vacantia.llm.vocabulary import FIELDS, Transducer
from vacantia.sources.tables import stored

LEAST_DOCS = 3
TOP = 200
SHARD_TERMS = 1 << 13
CELLS = 4_000_000  # sums by pair of sources that a task holds, besides one language's
ENTRIES = 1_500_000  # (source, term) pairs or terms that a task counts before it passes them on
UNIT_HIGH, UNIT_LOW = 100_000, 10_000  # their product is the unit of shares, 10^9
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
KEEP = ("first_arc", "labels", "targets", "weights", "finals")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def texts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"),
                       text_of(text).cast("binary").alias("text"))


# --- vocabulary --------------------------------------------------------------------

def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, term, docs)`` for a run of documents."""
    found: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, counts in found.items():
            names, numbers = list(counts), list(counts.values())
            for i in range(0, len(names), 50_000):
                part = names[i:i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(numbers[i:i + 50_000], pa.int64())],
                    names=["lang", "term", "docs"])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            found[lang].update(set(terms_of(text.as_py())))
            if sum(map(len, found.values())) > ENTRIES:
                yield from flush()
    yield from flush()


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Transducers of the sorted terms of a range, up to ``most`` terms each."""
    held: list[bytes] = []
    now = None

    def row():
        built = Transducer.build(held)
        values = [[now], [held[0]], [len(held)], *[[built[k]] for k in KEEP]]
        kinds = [pa.string(), pa.binary(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                          names=["lang", "first_term", "n_terms", *KEEP])

    for batch in batches:
        for lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
            if held and (lang != now or len(held) == most):
                yield row()
                held = []
            now = lang
            held.append(term)
    if held:
        yield row()


def vocabulary(rows: DataFrame, least: int = LEAST_DOCS, most: int = SHARD_TERMS) -> DataFrame:
    """The shards of the kept terms: ``lang, no, offset, first_term, n_terms`` and the transducer."""
    kept = (rows.select("lang", "text").mapInArrow(frequencies, "lang string, term binary, docs long")
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term"))
    ordered = stored(kept, "terms").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    built = stored(ordered.mapInArrow(lambda b: shards(b, most), f"lang string, first_term binary, n_terms long, {FIELDS}"),
                   "term-shards")
    # One row per shard.
    by_term = Window.partitionBy("lang").orderBy("first_term")
    places = built.select("lang", "first_term", (F.row_number().over(by_term) - 1).alias("no"),
                          F.coalesce(F.sum("n_terms").over(by_term.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return stored(built.join(places, ["lang", "first_term"]), "term-vocabulary")


# --- recount -----------------------------------------------------------------------

DEALT = ("lang string, no int, is_terms int, terms binary, sources array<string>, of_term binary, of_source binary, "
         "counts binary")


def dealt(batches: Iterator[pa.RecordBatch], borders: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Counted terms of a run of documents, cut by shard."""
    found: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def flush():
        for lang, by_source in found.items():
            first = borders.get(lang)
            if not first:
                continue
            names = sorted(by_source)
            terms = sorted(set().union(*by_source.values()))
            place = {t: i for i, t in enumerate(terms)}
            sizes = [len(by_source[s]) for s in names]
            of_term = np.concatenate([np.fromiter(map(place.__getitem__, by_source[s]), "<i4", len(by_source[s])) for s in names])
            counts = np.concatenate([np.fromiter(by_source[s].values(), "<i8", len(by_source[s])) for s in names])
            of_source = np.repeat(np.arange(len(names), dtype="<i4"), sizes)
            order = np.argsort(of_term, kind="stable")
            of_term, of_source, counts = of_term[order], of_source[order], counts[order]
            cuts = [*(bisect_left(terms, f) for f in first), len(terms)]
            for no, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    a, b = np.searchsorted(of_term, [lo, hi])
                    values = [lang, no, 1, b"\n".join(terms[lo:hi]), names, (of_term[a:b] - lo).astype("<i4").tobytes(),
                              of_source[a:b].tobytes(), counts[a:b].tobytes()]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                                     names=[c.split()[0] for c in DEALT.split(", ")])
        found.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            counter = found[lang][source]
            before = len(counter)
            counter.update(terms_of(text.as_py()))
            entries += len(counter) - before
            if entries > ENTRIES:
                yield from flush()
                entries = 0
    yield from flush()


COUNTED = f"lang string, no int, offset long, n_terms long, {FIELDS}, sources array<string>, of_term binary, of_source binary, counts binary"


def recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by place and source for each shard of a sorted stream, its transducer first."""
    shard = None

    def combined():
        keys, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        own = distinct(keys)
        return own, np.add.reduceat(counts, np.searchsorted(keys, own)) if len(own) else counts

    def row():
        keys, counts = combined() if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        values = {**{k: shard[k] for k in ("lang", "no", "offset", "n_terms", *KEEP)}, "sources": list(numbers),
                  "of_term": (keys >> 32).astype("<i4").tobytes(), "of_source": (keys & 0xFFFFFFFF).astype("<i4").tobytes(),
                  "counts": counts.astype("<i8").tobytes()}
        kinds = {"lang": pa.string(), "no": pa.int32(), "offset": pa.int64(), "n_terms": pa.int64(), "sources": pa.list_(pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in values.items()], names=list(values))

    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if not r["is_terms"]:
                if shard:
                    yield row()
                shard, numbers, held, size = r, {}, [], 0
                transducer = Transducer(*[r[k] for k in KEEP])
                continue
            of_source = np.array([numbers.setdefault(s, len(numbers)) for s in r["sources"]])
            places = transducer.ordinals(r["terms"].split(b"\n"))[np.frombuffer(r["of_term"], "<i4")]
            known = places >= 0
            keys = places[known] << 32 | of_source[np.frombuffer(r["of_source"], "<i4")[known]]
            held.append((keys, np.frombuffer(r["counts"], "<i8")[known]))
            size += len(keys)
            if size > 2 * ENTRIES and len(held) > 1:
                held = [combined()]
                size = len(held[0][0])
    if shard:
        yield row()


def recount(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Occurrences of the kept terms by source, a row for each shard of the vocabulary."""
    borders: dict[str, list[bytes]] = defaultdict(list)
    for r in words.select("lang", "no", "first_term").orderBy("lang", "no").toLocalIterator():
        borders[r["lang"]].append(bytes(r["first_term"]))
    borders = dict(borders)
    counted = rows.mapInArrow(lambda b: dealt(b, borders), DEALT)
    stream = words.withColumn("is_terms", F.lit(0)).drop("first_term").unionByName(counted, allowMissingColumns=True)
    return (stream.repartition("lang", "no").sortWithinPartitions("lang", "no", "is_terms").mapInArrow(recounted, COUNTED))


# --- divergence --------------------------------------------------------------------

def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) in two exact steps."""
    high, rest = np.divmod((count + 1) * UNIT_HIGH, total)
    return 1 + high * UNIT_LOW + rest * UNIT_LOW // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def by_source(values: np.ndarray, of_source: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of values by a sorted source number."""
    sums = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(of_source, np.arange(n + 1))
    return sums[at[1:]] - sums[at[:-1]]


def pair_sums(n_terms: int, of_term: np.ndarray, of_source: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Divergence of each source (row) from each other (column), summed over a shard's terms.
    Counts come sorted by source and term; ``totals`` are N + V of each source."""
    n = len(totals)
    bare = share(np.zeros(n, np.int64), totals)  # of a term that the source lacks
    none = apart(bare[:, None], bare[None, :])
    out = n_terms * none
    shares = share(counts, totals[of_source])
    bounds = np.searchsorted(of_source, np.arange(n + 1))
    for a in range(n):
        lo, hi = bounds[a], bounds[a + 1]
        if lo == hi:
            continue
        own, times = np.unique(shares[lo:hi], return_counts=True)
        out[a] += ((apart(own[:, None], bare[None, :]) - none[a]) * times[:, None]).sum(axis=0)
        out[:, a] += ((apart(bare[:, None], own[None, :]) - none[:, a:a + 1]) * times[None, :]).sum(axis=1)
        # Terms that both have.
        mine = np.zeros(n_terms, np.int64)
        mine[of_term[lo:hi]] = shares[lo:hi]
        p = mine[of_term]
        both = np.flatnonzero(p)
        p, q, b = p[both], shares[both], of_source[both]
        out[a] += by_source(apart(p, q) - apart(p, bare[b]) - apart(bare[a], q) + none[a][b], b, n)
    return out


SCORED = "part string, lang string, source string, item string, place long, value long"


def scored(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Sums by pair of sources, for all shards of a task together, and each source's best terms in
    each shard."""
    sums: dict[str, tuple[list[str], np.ndarray]] = {}

    def flush():
        for lang, (names, matrix) in sums.items():
            one, two = np.nonzero(~np.eye(len(names), dtype=bool))
            yield batch_of("pair", lang, [names[a] for a in one], [names[b] for b in two], None, matrix[one, two])
        sums.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            names = [g["source"] for g in r["groups"]]
            number = {s: k for k, s in enumerate(names)}
            totals = np.array([g["n"] for g in r["groups"]], np.int64) + r["v"]
            of_term, of_source, counts = (np.frombuffer(r[c], k).astype(np.int64) for c, k in
                                          (("of_term", "<i4"), ("of_source", "<i4"), ("counts", "<i8")))
            if len(of_source):
                of_source = np.array([number[s] for s in r["sources"]])[of_source]
            order = np.lexsort((of_term, of_source))
            of_term, of_source, counts = of_term[order], of_source[order], counts[order]
            matrix = pair_sums(r["n_terms"], of_term, of_source, counts, totals)
            if r["lang"] not in sums and sum(m.size for _, m in sums.values()) + matrix.size > CELLS:
                yield from flush()
            sums[r["lang"]] = names, matrix + (sums[r["lang"]][1] if r["lang"] in sums else 0)

            whole = np.zeros(r["n_terms"], np.int64)
            np.add.at(whole, of_term, counts)
            q = share(whole, int(totals.sum()) - r["v"] * (len(names) - 1))[of_term]
            p = share(counts, totals[of_source])
            value, above = apart(p, q), p > q
            transducer = Transducer(*[r[k] for k in KEEP])
            bounds = np.searchsorted(of_source, np.arange(len(names) + 1))
            source, item, place, found = [], [], [], []
            for a in range(len(names)):
                at = bounds[a] + np.flatnonzero(above[bounds[a]:bounds[a + 1]])
                at = at[np.lexsort((of_term[at], -value[at]))[:top]]
                source += [names[a]] * len(at)
                item += [transducer.term(t).decode() for t in of_term[at].tolist()]
                place += (of_term[at] + r["offset"]).tolist()
                found += value[at].tolist()
            if found:
                yield batch_of("term", r["lang"], source, item, place, found)
    yield from flush()


def batch_of(part, lang, source, item, place, value) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * n), pa.array([lang] * n), pa.array(source, pa.string()), pa.array(item, pa.string()),
         pa.array(place if place is not None else [None] * n, pa.int64()), pa.array(value, pa.int64())],
        names=[c.split()[0] for c in SCORED.split(", ")])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP,
          least: int = LEAST_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` holds every other source of the
    language, part ``term`` the source's ``top`` terms above their share in the language."""
    rows = texts(docs, text, lang, source)
    words = vocabulary(rows, least, shard_terms)
    counts = stored(recount(rows, words), "term-counts")
    sizes = counts.mapInArrow(source_sums, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["n"])
    kept = words.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    langs = (groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
             .join(kept, "lang", "left").na.fill(0, ["v"]))
    langs = stored(langs, "term-groups")
    # A hot language has many shards: its row is sent to them unless there are very many languages.
    found = stored(counts.join(small(langs, 5000), "lang").mapInArrow(lambda b: scored(b, top), SCORED), "term-scores")

    pairs = (langs.select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("others"))
             .select("lang", "source", F.explode("others").alias("item")).filter("source != item"))
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "place")
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(ranked)}).select(*columns)
            .unionByName(terms.select(*columns)))


def source_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of a shard's terms by source."""
    for batch in batches:
        for i in range(batch.num_rows):
            names = batch.column("sources")[i].as_py()
            sums = np.zeros(len(names), np.int64)
            np.add.at(sums, np.frombuffer(batch.column("of_source")[i].as_py(), "<i4"), np.frombuffer(batch.column("counts")[i].as_py(), "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("lang")[i].as_py()] * len(names), pa.string()),
                                              pa.array(names, pa.string()), pa.array(sums)], names=["lang", "source", "n"])
