"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: P(w | h) = a2 c(h, w) / c(h) + a1 c(w) / N +
a0 / (V + 1), h being the word before (at a text's start the end mark).  The weights a depend on
the context's frequency bucket, the number of binary digits of c(h).  They are learned by
expectation-maximisation on held-out counts: every training document is scored with its own
counts deleted from the model's, bucket and all.  A context never seen has a2 = 0.

*Chunks.*  Documents are cut into words in chunks of about ``CHUNK_CHARS`` characters.  A chunk
keeps its words' 64-bit hashes and its texts as word numbers, and is stored.

*Counts.*  A chunk's distinct words and word pairs, with their training counts, are cut by key
range into parts of about ``PART_KEYS`` keys in all, packed (sorted keys as differences), and
shuffled by part.  Each part sums the counts of equal keys and answers every chunk with the totals
of the keys it sent, in the same order.  A frequent word costs one key per chunk, so no key is
hot.  The answers meet the chunks again and the totals are stored beside the texts.

*Weights.*  Expectation-maximisation needs each held-out token's bucket and the ratios of its
three estimates only.  Chunks count tokens by bucket and by these ratios, in half octaves; the
table of counts is bounded by that grid (``GRID`` squared cells per bucket) whatever the corpus,
is summed by a shuffle and iterated on the driver.

*Scores* are read off chunk by chunk.

Defined cases: a null text is empty and scores as its end mark; repeated rows count and score each
time; a null key belongs to the training part; an empty table gives an empty result; with no
training token the model is uniform; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import distinct, numbered, text_of
from vacantia.sources.tables import stored

CHUNK_CHARS = 8_000_000
PART_KEYS = 1_500_000
END = b" "  # no word holds a space
ROUNDS = 60
PER_OCTAVE = 2
LOW, GRID = -40, 160  # the grid of ratios, in half octaves
BUCKETS = 48


def held_out(key: str = "doc_id") -> Column:
    """The part of the documents that the model doesn't learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def mixed(values: np.ndarray) -> np.ndarray:
    out = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Non-negative integers as compressed planes of bytes, as many as the largest needs."""
    values = values.astype("<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    head = np.array([len(values), width], "<u8").tobytes()
    return head + zstandard.ZstdCompressor(level).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(data[:16], "<u8"))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view("<u8").reshape(n).astype(np.uint64)


# --- chunks ------------------------------------------------------------------------

class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


CHUNKS = pa.schema([("chunk", pa.int64()), ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                    ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary()),
                    ("n_tokens", pa.int64()), ("n_train", pa.int64())])
CHUNK_FIELDS = ("chunk long, keys array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary, "
                "n_tokens long, n_train long")


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    made = 0
    numbers, keys, held, parts, size = Numbers({END: 0}), [], [], [], 0

    def row():
        lengths = np.array([len(p) for p in parts], np.int64)
        train = int(lengths[~np.array(held, bool)].sum())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        values = [TaskContext.get().partitionId() << 32 | made, keys, held, lengths, pack(np.concatenate(parts), 3),
                  hashes.tobytes(), int(lengths.sum()), train]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNKS)], schema=CHUNKS)

    for batch in batches:
        for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = text.as_py().encode("utf-8", "surrogatepass").lower().split()
            tokens = np.zeros(len(words) + 1, np.uint32)
            tokens[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            keys.append(key)
            held.append(out)
            parts.append(tokens)
            size += len(text.as_py())
            if size >= most:
                yield row()
                made += 1
                numbers, keys, held, parts, size = Numbers({END: 0}), [], [], [], 0
    if keys:
        yield row()


class Chunk:
    """A stored chunk's arrays."""

    def __init__(self, row: dict):
        self.id, self.keys = row["chunk"], row["keys"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        self.tokens = unpack(row["tokens"])
        self.of_doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.of_doc]
        self.before = np.zeros_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[np.cumsum(self.lengths) - self.lengths] = 0  # the end mark's number
        self.vocabulary = int(self.tokens.max()) + 1
        self.pairs = self.before * np.uint64(self.vocabulary) + self.tokens


def rows_of(table) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {name: table.column(name)[i].as_py() for name in table.schema.names}


# --- counts ------------------------------------------------------------------------

def word_keys(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes + np.uint64(1))


def pair_keys(hashes: np.ndarray, pairs: np.ndarray, vocabulary: int) -> np.ndarray:
    """56 bits each; a byte less to send than for words, whose counts must be exact at any size."""
    first, second = pairs // np.uint64(vocabulary), pairs % np.uint64(vocabulary)
    return mixed(mixed(hashes[first]) * np.uint64(0x9E3779B97F4A7C15) + hashes[second]) >> np.uint64(8)


def part_of(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and part the sorted keys and their training counts; words and pairs go to
    parts of their own (pairs after the words')."""
    for batch in batches:
        for row in rows_of(batch):
            chunk, hashes = Chunk(row), np.frombuffer(row["words"], np.uint64)
            counts = np.bincount(chunk.tokens[chunk.train].astype(np.int64), minlength=len(hashes))
            flagged = np.sort(chunk.pairs * np.uint64(2) + chunk.train)
            pairs = flagged >> np.uint64(1)
            first = np.flatnonzero(np.diff(pairs, prepend=pairs[0] + np.uint64(1)))
            pair_counts = np.add.reduceat((flagged & np.uint64(1)).astype(np.int64), first)
            for shift, bits, keys, n in ((0, 64, word_keys(hashes), counts),
                                         (parts, 56, pair_keys(hashes, pairs[first], chunk.vocabulary), pair_counts)):
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                bounds = np.searchsorted(part_of(keys, parts, bits), np.arange(parts + 1))
                used = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                cuts = [(bounds[p], bounds[p + 1]) for p in used]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shift + p for p in used], pa.int32()), pa.array([chunk.id] * len(used), pa.int64()),
                    pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()),
                    pa.array([pack(n[a:b]) for a, b in cuts], pa.binary())], names=["part", "chunk", "keys", "counts"])


def answer(table: pa.Table) -> pa.Table:
    """Totals of one part's keys, for each chunk in the order it sent them.

    ``types`` holds, in one row, the number of keys seen in training.
    """
    keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in table.column("keys")]
    counts = np.concatenate([unpack(c.as_py()) for c in table.column("counts")]).astype(np.int64)
    place, occurrences = numbered(np.concatenate(keys))
    totals = np.bincount(place, counts, len(occurrences)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    types = np.zeros(len(keys), np.int64)
    types[0] = np.count_nonzero(totals)
    return pa.table({
        "chunk": table.column("chunk"), "part": table.column("part"),
        "totals": pa.array([pack(totals[p]) for p in np.split(place, ends[:-1])], pa.binary()),
        "types": pa.array(types)})


def settle(chunk_rows: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """The chunk with the totals of its words, by number, and of its distinct pairs, by order."""
    row = next(rows_of(chunk_rows))
    chunk, hashes = Chunk(row), np.frombuffer(row["words"], np.uint64)
    pairs = distinct(chunk.pairs)
    got = sorted(rows_of(answers), key=lambda r: r["part"])
    both = []
    for keys, low in ((word_keys(hashes), 0), (pair_keys(hashes, pairs, chunk.vocabulary), parts)):
        totals = np.zeros(len(keys), np.uint64)
        totals[np.argsort(keys)] = np.concatenate([unpack(r["totals"]) for r in got if low <= r["part"] < low + parts])
        both.append(pack(totals))
    word_types = sum(r["types"] for r in got if r["part"] < parts)
    values = [row["chunk"], row["keys"], row["held"], row["lengths"], row["tokens"], *both, word_types]
    return pa.table([pa.array([v], f.type) for v, f in zip(values, COUNTED)], schema=COUNTED)


COUNTED = pa.schema([*list(CHUNKS)[:5], ("word_totals", pa.binary()), ("pair_totals", pa.binary()), ("types", pa.int64())])
COUNTED_FIELDS = ("chunk long, keys array<long>, held array<boolean>, lengths array<long>, tokens binary, "
                  "word_totals binary, pair_totals binary, types long")


# --- weights -----------------------------------------------------------------------

def bucket_of(counts: np.ndarray) -> np.ndarray:
    """The number of binary digits of a context's count; 0 for a context never seen."""
    return np.frexp(counts.astype(np.float64))[1]


def own_counts(of_doc: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """For each token how often its number occurs in its document."""
    keys = of_doc.astype(np.uint64) * np.uint64(size) + numbers
    place, counts = numbered(keys)
    return counts[place]


def totals_of(chunk: Chunk, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token, of its context and of the pair."""
    words = unpack(row["word_totals"]).astype(np.int64)
    pairs = unpack(row["pair_totals"]).astype(np.int64)
    return words[chunk.tokens], words[chunk.before], pairs[numbered(chunk.pairs)[0]]


def ratio(count: np.ndarray, of: np.ndarray, types: int) -> np.ndarray:
    """Place on the grid of an estimate over the uniform one; 0 if the estimate is 0."""
    some = (count > 0) & (of > 0)
    logs = np.log2(np.where(some, count, 1) / np.where(some, of, 1) * (types + 1))
    return np.where(some, np.clip(np.round(logs * PER_OCTAVE).astype(np.int64) - LOW, 1, GRID - 1), 0)


def deleted(batches: Iterator[pa.RecordBatch], tokens: int, types: int) -> Iterator[pa.RecordBatch]:
    """Training tokens of each chunk by bucket and ratios, own document deleted."""
    for batch in batches:
        for row in rows_of(batch):
            chunk = Chunk(row)
            word, context, pair = totals_of(chunk, row)
            train = np.flatnonzero(chunk.train)
            if not len(train):
                continue
            of_doc, own_word = chunk.of_doc[train], chunk.tokens[train]
            n_word = own_counts(of_doc, own_word, chunk.vocabulary)
            n_pair = own_counts(of_doc, chunk.pairs[train], chunk.vocabulary ** 2)
            # A document's count of a context is its count of the word; of the start it is 1.
            n_context = np.ones(len(train), np.int64)
            inner = chunk.before[train] != 0
            n_context[inner] = n_word[np.flatnonzero(inner) - 1]
            context = context[train] - n_context
            length = chunk.lengths[of_doc]
            cell = (bucket_of(context) * GRID + ratio(pair[train] - n_pair, context, types)) * GRID
            cell += ratio(word[train] - n_word, np.full(len(train), tokens) - length, types)
            cells, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["cell", "n"])


def learn(cells: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights (pair, word, uniform) of each bucket."""
    bucket, pair, word = cells // GRID ** 2, cells // GRID % GRID, cells % GRID
    value = lambda q: np.where(q > 0, 2.0 ** ((q + LOW) / PER_OCTAVE), 0.0)
    estimates = np.stack([value(pair), value(word), np.ones(len(cells))], axis=1)
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    for _ in range(rounds):
        shares = estimates * weights[bucket]
        shares *= (counts / shares.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, shares[:, k], BUCKETS) for k in range(3)], axis=1)
        sums[:, 1:] += 0.5  # keeps every bucket's lower orders alive
        weights = sums / sums.sum(axis=1, keepdims=True)
    # A bucket without tokens takes the weights of the one below.
    seen = np.bincount(bucket, counts, BUCKETS) > 0
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    return weights


# --- scores ------------------------------------------------------------------------

def scores(batches: Iterator[pa.RecordBatch], tokens: int, types: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in rows_of(batch):
            chunk = Chunk(row)
            word, context, pair = totals_of(chunk, row)
            mix = weights[np.minimum(bucket_of(context), BUCKETS - 1)]
            p = mix[:, 2] / (types + 1) + mix[:, 1] * (word / max(1, tokens)) + mix[:, 0] * (pair / np.maximum(context, 1))
            begins = np.cumsum(chunk.lengths) - chunk.lengths
            base = np.log10((word + 1) / (tokens + types + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["keys"], pa.int64()), pa.array(chunk.held), pa.array(chunk.lengths),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), begins)),
                pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(np.log10(p), begins))],
                names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """One row per document: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    read = docs.select(F.col(key).cast("long").alias("key"), (held_out(key) if held is None else held).alias("held"),
                       text_of(text).alias("text"))
    cut = stored(read.mapInArrow(lambda batches: chunks(batches, CHUNK_CHARS), CHUNK_FIELDS), "lm-chunks")
    size = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    tokens, parts = size[1], size[0] // PART_KEYS + 1
    sent = cut.mapInArrow(lambda batches: send(batches, parts), "part int, chunk long, keys binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(answer, "chunk long, part int, totals binary, types long")
    counted = stored(cut.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda left, right: settle(left, right, parts), COUNTED_FIELDS), "lm-counted")
    types = counted.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    grid = counted.mapInArrow(lambda batches: deleted(batches, tokens, types), "cell long, n long")
    cells = grid.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))
    fields = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = counted.mapInArrow(lambda batches: scores(batches, tokens, types, weights), fields)
    return found.select("key", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                        "base_score", "score")
