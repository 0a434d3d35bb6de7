"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into overlapping windows (an item that is shorter is one window) of two
kinds: long ones with an edit budget of 5 per cent, which meet edits spread over a passage, and short
ones of about seven words with one edit, which meet excerpts and what is left of a passage
between heavier edits.  A text leaks a window if some stretch of it is within the window's budget.
One edit destroys at most q of a window's q-grams, so a leak shares at
least ``length - q + 1 - q * budget`` of them with the text, and, as each edit moves the alignment
by one at most, all of these lie within ``budget + 1`` neighbouring diagonals (place in the text
less place in the window).  Shared q-grams are therefore counted in bands of ``2 * budget + 1``
diagonals that begin every ``budget + 1``, so that one band holds any such group; bands that reach
the bound are verified by an alignment confined to their diagonals.

An item shorter than a long window is also looked for with one stretch replaced, such as a word, of
up to a sixth of it and ``STRETCH`` characters.  The q-grams that such a stretch destroys lie side by
side: at most its length and q - 1 of them, so the bound is ``length - q + 1`` less that.

Both sides are compared in lower case with every run of white space as one space.  Texts are
searched whole, batch by batch, in Arrow with array operations; hits are expanded in pieces of
bounded size.  The benchmark is a query set held against all documents: it is sent to the tasks
in blocks of at most ``BLOCK`` characters, one pass over the documents per block, so that its
size never limits the result.

Defined cases: null and empty texts and items leak nothing; an item shorter than q characters is
compared as a whole word sequence only if its budget is 0, that is, it must occur verbatim; equal
items give a row each; repeated documents give rows each; an empty table gives an empty result;
``drop_leaks`` keeps the documents' own columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import running, text_of
from vacantia.sources.tables import stored



@dataclass(frozen=True)
class Cut:
    """Windows of ``window`` characters that begin every ``step``: any stretch of
    ``window + step - 1`` characters of an item holds one.  ``budget``: edits per character."""
    window: int
    step: int
    budget: float


Q = 16
LONG = Cut(100, 20, 0.05)
SHORT = Cut(40, 4, 0.025)
STRETCH = 12
BLOCK = 500_000  # characters of the benchmark in one pass
BATCH_CHARS = 1 << 21
EXPAND = 1 << 21  # hits held at a time
ROWS = 4096  # alignments side by side
MULTIPLIER = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` code points (q a power of two)."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    out, width, factor = codes.astype(np.uint64), 1, MULTIPLIER
    while width < q:
        out = out[:-width] * np.uint64(factor) + out[width:]
        out ^= out >> np.uint64(29)
        width, factor = 2 * width, (factor * MULTIPLIER + 2) % 2**64
    return out


class Patterns:
    """The windows of a block of the benchmark and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, cuts: Sequence[Cut] = (LONG,), stretch: int = 0):
        self.q, self.items, self.codes, self.starts, self.edits, self.needed = q, [], [], [], [], []

        def add(item, codes, begin, edits, destroyed):
            self.items.append(item)
            self.starts.append(begin)
            self.codes.append(codes)
            self.edits.append(edits)
            self.needed.append(len(codes) - q + 1 - destroyed)

        for item, raw in items:
            codes = code_points(normal(raw))
            for i, cut in enumerate(cuts):
                size = min(cut.window, len(codes))
                if not size or any(size == min(c.window, len(codes)) for c in cuts[:i]):
                    continue
                begins = list(range(0, len(codes) - size + 1, cut.step))
                if begins[-1] != len(codes) - size:
                    begins.append(len(codes) - size)
                # The lemma says something only while the bound stays positive.
                edits = max(0, min(int(size * cut.budget), (size - q) // q))
                for begin in begins:
                    add(item, codes[begin:begin + size], begin, edits, q * edits)
            edits = min(stretch, len(codes) // 6)
            if len(codes) < max(c.window for c in cuts) and edits and len(codes) - q + 1 > edits + q - 1:
                add(item, codes, 0, edits, edits + q - 1)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array(self.edits, np.int64)
        self.needed = np.array(self.needed, np.int64)
        self.short = [i for i, c in enumerate(self.codes) if len(c) < q]
        hashes = [grams(c, q) for c in self.codes]
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        window_of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        order = np.argsort(every, kind="stable")
        self.window_of, self.place = window_of[order].astype(np.int32), place[order].astype(np.int32)
        self.known, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(self.first, append=len(every))
        self.bits = max(16, int(np.ceil(np.log2(16 * max(1, len(self.known))))))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.slot(self.known)] = True

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(MULTIPLIER)) >> np.uint64(64 - self.bits)

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Shared q-grams as (window, place in window, place in text), in pieces."""
        hashes = grams(codes, self.q)
        at = np.flatnonzero(self.filter[self.slot(hashes)])
        if not len(at) or not len(self.known):
            return
        found = hashes[at]
        index = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        same = self.known[index] == found
        at, index = at[same], index[same]
        counts = self.count[index]
        total = np.cumsum(counts)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + EXPAND, side="right")))
            n = counts[begin:end]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(self.first[index[begin:end]], n) + offset
            yield self.window_of[entry].astype(np.int64), self.place[entry].astype(np.int64), np.repeat(at[begin:end], n)
            begin = end

    def bands(self, codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal) of the bands with enough shared q-grams.

        ``base`` exceeds every place in a window, so that diagonals are positive.
        """
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = int(self.edits.max()) + 1 if len(self.edits) else 1
        per_window = len(codes) + base + 2 * width + 2
        for window, place, at in self.hits(codes):
            step = self.edits[window] + 1
            diagonal = at - place + base
            band = diagonal // step
            inner = diagonal - band * step < step - 1
            again = inner & (band > 0)
            key = np.concatenate([window * per_window + band, window[again] * per_window + band[again] - 1])
            new, n = np.unique(key, return_counts=True)
            both = np.concatenate([keys, new])
            keys, place_of = np.unique(both, return_inverse=True)
            counts = np.bincount(place_of, np.concatenate([counts, n])).astype(np.int64)
        window = keys // per_window
        enough = counts >= self.needed[window]
        window, band = window[enough], (keys % per_window)[enough]
        return window, band * (self.edits[window] + 1) - base


def align(patterns: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray,
          width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``patterns``, all of one length: the least edits against a stretch of
    ``text`` between ``begin`` and ``end``, and where it ends, moving only on the ``width``
    diagonals from ``low`` on.  All rows are worked out side by side."""
    far = patterns.shape[1] + width + 1
    steps = np.arange(width)
    places = low[:, None] + steps  # of the text, before the first symbol
    begin, end = begin[:, None], end[:, None]
    row = np.where((places >= begin) & (places <= end), 0, far)
    beyond = np.full((len(patterns), 1), far)
    for i in range(patterns.shape[1]):
        at = places + i
        inside = (at >= begin) & (at < end)
        differs = text[np.where(inside, at, 0)] != patterns[:, i:i + 1]
        diagonal = np.where(inside, row + differs, far)
        row = np.minimum(diagonal, np.concatenate([row[:, 1:], beyond], axis=1) + 1)
        row = np.where((at + 1 >= begin) & (at + 1 <= end), row, far)
        row = np.minimum(row, np.minimum.accumulate(row - steps, axis=1) + steps)
    best = row.argmin(axis=1)
    some = np.arange(len(row))
    return row[some, best], places[some, best] + patterns.shape[1] - begin[:, 0]


def search(key: list, texts: list[str], patterns: Patterns) -> dict:
    """Leaked windows of a batch of texts: rows of key, item, window start, text end and edits."""
    codes = [code_points(normal(t)) for t in texts]
    gap = np.full(patterns.q, 0x110000, np.uint32)
    joined = np.concatenate([x for c in codes for x in (c, gap)]) if codes else np.zeros(0, np.uint32)
    ends = np.cumsum([len(c) + patterns.q for c in codes])
    out = {"key": [], "item": [], "window": [], "stop": [], "edits": []}

    def add(doc, window, stop, edits):
        for name, value in zip(out, (key[doc], patterns.items[window], patterns.starts[window], stop, edits)):
            out[name].append(value)

    base = int(patterns.sizes.max()) if len(patterns.sizes) else 1
    window, low = patterns.bands(joined, base)
    # The middle of a band's stretch lies in the text that may leak the window.
    middle = np.clip(low + patterns.edits[window] + patterns.sizes[window] // 2, 0, max(len(joined) - 1, 0))
    doc = np.searchsorted(ends, middle, side="right")
    end = ends[doc] - patterns.q if len(doc) else doc
    begin = end - np.array([len(c) for c in codes], np.int64)[doc] if len(doc) else doc
    best: dict = {}
    kinds = np.stack([patterns.sizes[window], patterns.edits[window]], axis=1)
    for kind in np.unique(kinds, axis=0):
        alike = np.flatnonzero((kinds == kind).all(axis=1))
        budget = int(kind[1])
        for some in np.array_split(alike, len(alike) // ROWS + 1):
            chosen = window[some]
            edits, stops = align(np.stack([patterns.codes[w] for w in chosen]), joined, begin[some], end[some],
                                 low[some], 2 * budget + 1)
            for d, w, e, stop in zip(doc[some].tolist(), chosen.tolist(), edits.tolist(), stops.tolist()):
                if e <= budget and (e, stop) < best.get((d, w), (budget + 1, 0)):
                    best[d, w] = (e, stop)
    for (d, w), (edits, stop) in best.items():
        add(d, w, stop, edits)
    for w in patterns.short:
        wanted = normal("".join(map(chr, patterns.codes[w])))
        for d, text in enumerate(texts):
            at = re.search(rf"(?<!\S){re.escape(wanted)}(?!\S)", normal(text))
            if at:
                add(d, w, at.end(), 0)
    return out


def scan(batches: Iterator[pa.RecordBatch], patterns: Patterns) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("window", pa.int64()), ("stop", pa.int64()),
                        ("edits", pa.int64())])

    def done(key, texts):
        return pa.RecordBatch.from_pydict(search(key, texts, patterns), schema)

    key, texts, size = [], [], 0
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            key.append(k)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield done(key, texts)
                key, texts, size = [], [], 0
    if key:
        yield done(key, texts)


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> list[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, each a list on the driver.

    An item larger than a block makes a block of its own.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), text_of(text).alias("text")).filter("text != ''")
    sized = items.withColumn("order_no", F.xxhash64("item", "text"))
    numbered = running(sized, [F.col("order_no")], "benchmark", chars=F.length("text"))
    numbered = stored(numbered.withColumn("block", F.floor(F.col("chars") / most)), "benchmark-blocks")
    for row in numbered.select("block").distinct().orderBy("block").toLocalIterator():
        yield [(r["item"], r["text"]) for r in numbered.filter(F.col("block") == row["block"]).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", block: int = BLOCK, cuts: Sequence[Cut] = (LONG, SHORT), stretch: int = STRETCH,
          **settings) -> DataFrame:
    """``(key, item, window, stop, edits)``: windows of items found in documents.

    ``window`` is the window's start in the normalised item, ``stop`` the end of the stretch in
    the normalised text.  Windows of several cuts may begin at the same place.
    """
    schema = "key long, item long, window long, stop long, edits long"
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).filter("text != ''")
    found = []
    for part in blocks(benchmark, item, item_text, block):
        patterns = docs.sparkSession.sparkContext.broadcast(Patterns(part, cuts=cuts, stretch=stretch, **settings))
        found.append(rows.mapInArrow(lambda batches, p=patterns: scan(batches, p.value), schema))
    empty = rows.select("key", *[F.lit(0).cast("long").alias(c) for c in ("item", "window", "stop", "edits")]).filter("false")
    return reduce(DataFrame.unionByName, found, empty)


def leaked_items(found: DataFrame) -> DataFrame:
    """One row per document and item: ``key, item, windows, edits`` (places of windows, the least edits)."""
    return found.groupBy("key", "item").agg(F.countDistinct("window").alias("windows"), F.min("edits").alias("edits"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", **settings) -> DataFrame:
    """The documents without a leak, with their own columns.

    Documents are known by a hash of their text, so that keys may be null or repeated; the hashes
    of leaking texts are stored, and the planner broadcasts them if they are few.
    """
    packed = docs.select(F.struct(*docs.columns).alias("document"), F.xxhash64(text).alias("key"),
                         F.col(text).alias("text"))
    found = leaks(packed, benchmark, "key", "text", item, item_text, **settings)
    bad = stored(found.select("key").distinct(), "leaks")
    return packed.join(bad, "key", "left_anti").select("document.*")
