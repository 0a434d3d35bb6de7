"""Token-ID files compressed by a Re-Pair grammar.

Documents are dealt by ranges of their key and encoded in key order; the ids of consecutive
documents, each with an end id, form shards of about ``SHARD_IDS`` ids.  A shard is compressed by
itself: in each round the most frequent pairs of neighbouring symbols are replaced by new symbols
(nonterminals), until no pair occurs ``LEAST`` times.  Pairs that would overlap are taken from left
to right; several pairs are replaced in one round, which differs from one pair at a time only in
the order of the rules.

A file is a Parquet file with one row per shard:

=========== ============ ============================================================
shard       struct       number of the range, number of the shard within it
keys        array<long>  keys of its documents, in order
n_tokens    array<long>  their numbers of ids, the end id included
base        int          the first nonterminal; smaller symbols are ids
rules       binary       little-endian uint32 pairs, rule i defining symbol ``base + i``
lengths     binary       little-endian uint32, expanded length of each rule
symbols     binary       little-endian uint32, the compressed sequence
=========== ============ ============================================================

The expanded lengths give, by running sums over the symbols, the place of any id, so ``decode``
expands only the symbols that cover the ids asked for.

Encoding uses the ``tokenizers`` library.  A text is cut before spaces, which is always a
boundary of the vocabulary's own splitting pattern (that of byte-level vocabularies) unless white
space lies on both sides of the space (such texts are encoded whole), and each distinct piece is
encoded once per worker while it stays in a bounded memory.

Defined cases: a null text is empty and gives the end id alone; rows with a null key come first,
equal keys in the order of a hash of the text; an empty table gives no shards; a text longer than
a shard makes a shard of its own; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import text_of
from vacantia.session import shared_path

END = 2
SHARD_IDS = 1 << 20
RULES_PER_ROUND = 4096
LEAST = 8  # occurrences of a pair that becomes a rule
SLOT_BITS = 18
PIECES = 1_500_000  # distinct pieces that a worker remembers
TABLE_BITS = 22  # of the table of their hashes
LONG = 256  # bytes of a piece, and
DIRECT = 4_000_000  # characters of a text, that are encoded directly
FACTOR = 0x9E3779B97F4A7C15
MARKS, LATIN = ".,;:!?", "\u024f"

FILE_SCHEMA = ("shard struct<range_no:int,shard_no:int>, keys array<long>, n_tokens array<long>, base int, "
               "rules binary, lengths binary, symbols binary")


# --- grammar -----------------------------------------------------------------------

def slots_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)
    return (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOT_BITS)


def frequent(symbols: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``most`` of the pairs of neighbours that occur ``least`` times or more, the most
    frequent ones, as ``left << 32 | right``; where they stand, and which each is.

    Neighbours are counted by a hash slot first, which counts no pair too low; the pairs of slots
    that count high are sorted and counted exactly.  If no pair is found, none is there.
    """
    left, right = symbols[:-1], symbols[1:]
    slots = slots_of(left, right)
    rough = np.bincount(slots, minlength=1 << SLOT_BITS)
    # The least count at which no more than twice the slots wanted are left.
    slots_above = np.cumsum(np.bincount(np.minimum(rough, len(symbols) >> 8))[::-1])[::-1]
    bound = max(least, int(np.searchsorted(-slots_above, -2 * most)))
    while True:
        at = np.flatnonzero((rough >= bound)[slots])
        pairs = left[at].astype(np.uint64) << np.uint64(32) | right[at]
        ordered = np.sort(pairs)
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(begins, append=len(ordered))
        good = np.flatnonzero(counts >= least)
        if len(good) or bound == least:
            break
        bound = least
    good = np.sort(good[np.argsort(-counts[good], kind="stable")[:most]])
    chosen = ordered[begins[good]]
    if not len(chosen):
        return chosen, at[:0], at[:0]
    # Chosen pairs are found by their slot; the few that share one with another are searched for.
    homes = slots_of((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))
    number, shared = np.zeros(1 << SLOT_BITS, np.int32), np.bincount(homes, minlength=1 << SLOT_BITS) > 1
    number[homes] = np.arange(len(homes))
    slots = slots[at]
    which = number[slots]
    own = chosen[which] == pairs
    rest = np.flatnonzero(shared[slots] & ~own)
    which[rest] = np.minimum(np.searchsorted(chosen, pairs[rest]), len(chosen) - 1)
    own[rest] = chosen[which[rest]] == pairs[rest]
    return chosen, at[own], which[own]


def replace_round(symbols: np.ndarray, first: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` with frequent pairs replaced by ``first`` and the numbers after it, and those
    pairs; none, if no pair occurs ``least`` times or more."""
    pairs, at, rule = frequent(symbols, most, least)
    if not len(pairs):
        return symbols, pairs
    # In a run of overlapping pairs every second one, from the left, is replaced.
    starts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    offset = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    chosen = offset % 2 == 0
    at, rule = at[chosen], rule[chosen]
    # A pair that others left no place gets no rule this time.
    placed = np.bincount(rule, minlength=len(pairs)) > 0
    used, rule = np.flatnonzero(placed), (np.cumsum(placed) - 1)[rule]
    out = symbols.copy()
    out[at] = (first + rule).astype(np.uint32)
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return out[keep], pairs[used]


def compress(ids: np.ndarray, per_round: int = RULES_PER_ROUND, least: int = LEAST):
    """``(base, rules, lengths, symbols)`` of a sequence of ids, in which no pair of neighbours
    occurs ``least`` times or more."""
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, lengths = ids.astype(np.uint32), [], [np.ones(base, np.uint32)]
    first = base
    while len(symbols) > 1:
        symbols, pairs = replace_round(symbols, first, per_round, least)
        if not len(pairs):
            break
        both = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        known = np.concatenate(lengths)
        rules.append(both)
        lengths.append(known[both].sum(axis=1).astype(np.uint32))
        first += len(pairs)
    empty = np.zeros((0, 2), np.uint32)
    return base, np.concatenate([empty, *rules]), np.concatenate([np.zeros(0, np.uint32), *lengths[1:]]), symbols


def expansions(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rules written out one after the other, and where each begins."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat = np.zeros(starts[-1], np.uint32)
    for i, (left, right) in enumerate(rules.tolist()):
        at = starts[i]
        for symbol in (left, right):
            if symbol < base:
                flat[at] = symbol
                at += 1
            else:
                begin, end = starts[symbol - base], starts[symbol - base + 1]
                flat[at:at + end - begin] = flat[begin:end]
                at += end - begin
    return flat, starts


def decode(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray,
           start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``stop``; only symbols that cover them are expanded."""
    of_rule = symbols >= base
    sizes = np.ones(len(symbols), np.int64)
    sizes[of_rule] = lengths[symbols[of_rule] - base]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.uint32)
    lo, hi = np.searchsorted(ends, [start, stop - 1], side="right")
    symbols, sizes, of_rule = symbols[lo:hi + 1], sizes[lo:hi + 1], of_rule[lo:hi + 1]
    before = int(ends[lo] - sizes[0])
    if not len(rules):
        return symbols
    flat, starts = expansions(base, rules, lengths)
    # Ids lie behind the written-out rules, so that one lookup serves both.
    source = np.where(of_rule, starts[np.where(of_rule, symbols - base, 0)], len(flat) + np.arange(len(symbols)))
    table = np.concatenate([flat, symbols])
    first = np.cumsum(sizes) - sizes
    places = np.repeat((source - first).astype(np.int32), sizes)
    places += np.arange(len(places), dtype=np.int32)
    return table[places][start - before:stop - before]


# --- encoding ----------------------------------------------------------------------

class Encoder:
    """Ids of texts, by pieces that are remembered.

    The pieces of many texts are hashed at once, as differences of one running polynomial sum over
    the bytes, and looked up in a table of two slots per hash.  Only unknown pieces become Python
    strings.  Long pieces, for which such a hash is weak, and texts whose cuts are no boundaries
    are encoded directly.
    """

    def __init__(self, vocabulary: str, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        # Byte-level vocabularies write printable Latin-1 bytes as themselves, others from 256 on.
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) if b in kept else chr(256 + others.index(b)) for b in range(256)}
        self.most = most
        self.of_byte = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.known = 0
        self.slot_hash = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot_piece = np.zeros(1 << TABLE_BITS, np.int32)
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.opens = np.zeros(1 << 16, bool)  # the piece is empty or begins with white space
        self.closes = np.zeros(1 << 16, bool)  # it is empty or ends with white space
        self.used = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, pieces: list[str], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row and the number of each, a space before each that is not
        the first of its text.

        A word of Latin letters, with the space, is one unit of the vocabulary's splitting and
        goes to the model as such; so does the stem of such a word with one mark behind it.
        Other pieces go through the whole tokenizer.
        """
        found, rest, stems, tails = [None] * len(pieces), [], {}, {}
        for i, (p, f) in enumerate(zip(pieces, first)):
            mark = p[-1:] in MARKS and len(p) > 1
            stem = p[:-1] if mark else p
            if f or not stem.isalpha() or max(stem) > LATIN:
                rest.append(i)
                continue
            ids = stems.get(stem)
            if ids is None:
                ids = stems[stem] = [t.id for t in self.tokenizer.model.tokenize(
                    (" " + stem).encode().decode("latin-1").translate(self.letters))]
            if mark and p[-1] not in tails:
                tails[p[-1]] = self.whole([p[-1]])[0]
            found[i] = ids + tails[p[-1]] if mark else ids
        for i, ids in zip(rest, self.whole([pieces[i] if first[i] else " " + pieces[i] for i in rest])):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def learn(self, hashes: np.ndarray, pieces: list[str], first: np.ndarray) -> np.ndarray:
        """Remember pieces, one that begins a text without a space before it; their numbers."""
        ids, sizes = self.encoded(pieces, first.tolist())
        n, m = self.known, self.known + len(pieces)
        while m > len(self.starts):
            for name in ("starts", "sizes", "opens", "closes"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[n:m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n:m] = sizes
        self.opens[n:m] = [not p or p[0].isspace() for p in pieces]
        # A text's empty first piece stands for its start, not for a space.
        self.closes[n:m] = [p[-1].isspace() if p else not f for p, f in zip(pieces, first.tolist())]
        self.used += len(ids)
        self.known = m
        numbers = np.arange(n, m, dtype=np.int32)
        one, two = self.slots(hashes)
        free = self.slot_hash[one] == 0
        place = np.where(free, one, two)
        self.slot_hash[place], self.slot_piece[place] = hashes, numbers
        return numbers

    def slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64), (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)

    @staticmethod
    def powers_of(factor: int, size: int) -> np.ndarray:
        """``factor`` to the power of 0, 1, 2 and so on, modulo 2 to the 64th."""
        out = np.full(size, factor, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out, out=out)

    def hashed(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(codes) + 1:
            # An eighth more than asked for: workers keep these between stages.
            size = len(codes) + len(codes) // 8 + 2
            self.powers = self.inverses = np.ones(1, np.uint64)
            self.powers, self.inverses = (self.powers_of(f, size) for f in (FACTOR, pow(FACTOR, -1, 2**64)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.of_byte[codes] * self.powers[:len(codes)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29)) | np.uint64(1)  # 0 is a free slot

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        hashes = self.hashed(np.frombuffer(data, np.uint8), starts, ends) + first * np.uint64(2)
        one, two = self.slots(hashes)
        at_one, at_two = self.slot_hash[one] == hashes, self.slot_hash[two] == hashes
        found = np.where(at_one, self.slot_piece[one], self.slot_piece[two])
        unknown = np.flatnonzero(~(at_one | at_two))
        if len(unknown):
            new, place, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            place = unknown[place]
            pieces = [data[a:b].decode() for a, b in zip(starts[place].tolist(), ends[place].tolist())]
            found[unknown] = self.learn(new, pieces, first[place])[back]
        return found

    def __call__(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end`` after each, and the number of each."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.known > self.most:
            self.forget()
        direct = np.fromiter((len(t) > DIRECT for t in texts), bool, len(texts))
        raw = [b"" if d else t.encode() for t, d in zip(texts, direct.tolist())]
        data = b" ".join(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
        begins = np.searchsorted(starts, np.cumsum(lengths) - lengths)
        first = np.zeros(len(starts), bool)
        first[begins] = True
        at = self.numbers(data, starts, ends, first)
        odd = ends - starts > LONG
        odd[1:] |= self.closes[at[:-1]] & self.opens[at[1:]] & ~first[1:]
        strange = np.flatnonzero(np.add.reduceat(odd, begins) | direct)
        sizes = self.sizes[at].astype(np.int64)
        counts = np.add.reduceat(sizes, begins)
        # The end mark follows the last piece of each text.
        last = np.append(begins[1:], len(at)) - 1
        sizes[last] += 1
        starts_of = np.cumsum(sizes) - sizes
        places = np.repeat((self.starts[at] - starts_of).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        ends_of = np.cumsum(counts + 1) - 1
        places[ends_of] = 0
        ids = self.flat[places].astype(np.uint32)
        ids[ends_of] = end
        counts += 1
        if len(strange):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, found in zip(strange.tolist(), self.whole([texts[i] for i in strange])):
                parts[i] = np.array([*found, end], np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker; what it remembers serves the worker's later tasks."""
    if vocabulary not in ENCODERS:
        ENCODERS[vocabulary] = Encoder(vocabulary)
    return ENCODERS[vocabulary]


# --- files -------------------------------------------------------------------------

def shards(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    range_no, shard_no = TaskContext.get().partitionId(), 0
    keys, counts, parts, held = [], [], [], 0

    def row():
        base, rules, lengths, symbols = compress(np.concatenate(parts))
        columns = [
            pa.array([{"range_no": range_no, "shard_no": shard_no}],
                     pa.struct([("range_no", pa.int32()), ("shard_no", pa.int32())])),
            pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
            pa.array([base], pa.int32()),
            *[pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (rules, lengths, symbols)]]
        return pa.RecordBatch.from_arrays(
            columns, names=["shard", "keys", "n_tokens", "base", "rules", "lengths", "symbols"])

    def groups():
        """Texts of up to a quarter of a shard at a time."""
        chosen, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chosen.append(key)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= shard_ids:
                    yield chosen, texts
                    chosen, texts, size = [], [], 0
        if chosen:
            yield chosen, texts

    for chosen, texts in groups():
        ids, lengths = encode(texts, end)
        begin, done = 0, 0
        running = held + np.cumsum(lengths)
        # Documents are added until a shard is full.
        while done < len(chosen):
            full = int(np.searchsorted(running, shard_ids)) + 1
            full = max(done + 1, min(full, len(chosen)))
            stop = begin + int(lengths[done:full].sum())
            keys += chosen[done:full]
            counts += lengths[done:full].tolist()
            parts.append(ids[begin:stop])
            held += stop - begin
            begin, done = stop, full
            if held >= shard_ids:
                yield row()
                running = running - held
                keys, counts, parts, held, shard_no = [], [], [], 0, shard_no + 1
    if keys:
        yield row()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                 end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode every document and write the shards to ``path`` in key order."""
    tie = F.xxhash64(F.col("text"))
    ordered = (docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
               .repartitionByRange(F.col("key"), tie).sortWithinPartitions(F.col("key"), tie))
    ordered.mapInArrow(lambda batches: shards(batches, vocabulary, end, shard_ids), FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``key, start, n_tokens, ids binary`` (little-endian uint32).

    ``start`` counts the ids of all documents before it.  Shards are numbered by range and by
    place in it: a window runs over the shards of one range, and the ranges' totals, one row
    each, over the ranges.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (sizes.groupBy("shard.range_no").agg(F.sum("n").alias("n"))
              .select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start")))
    within = Window.partitionBy("shard.range_no").orderBy("shard.shard_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
              .join(ranges, F.col("shard.range_no") == F.col("range_no"))
              .select("shard", (F.col("range_start") + F.col("inside")).alias("shard_start")))
    return (files.mapInArrow(documents, "shard struct<range_no:int,shard_no:int>, key long, inside long, "
                                        "n_tokens long, ids_crc32 long")
            .join(starts, "shard")
            .select("key", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each shard with the checksum of their ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            read = {name: np.frombuffer(row[name], "<u4") for name in ("rules", "lengths", "symbols")}
            ids = decode(row["base"], read["rules"].reshape(-1, 2), read["lengths"], read["symbols"])
            counts = np.array(row["n_tokens"], np.int64)
            starts = np.cumsum(counts) - counts
            data = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * s:4 * (s + n)]) for s, n in zip(starts.tolist(), row["n_tokens"])]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.struct([("range_no", pa.int32()), ("shard_no", pa.int32())])),
                 pa.array(row["keys"], pa.int64()), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                names=["shard", "key", "inside", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files to the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, key, text)
    return read_tokens(docs.sparkSession, path)
