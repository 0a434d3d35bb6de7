"""Language by profiles of character n-grams.

A text counts by its letters: it is lower-cased, everything that is no letter becomes one space,
and a space stands at either end; its n-grams are all runs of 1 to 3 characters of that.  Profiles
are learned from texts of known language: each language keeps its most frequent n-grams, so the
table is bounded by ``MOST`` times the number of languages, and every n-gram of the table weighs in
every language the logarithm of its smoothed share there, in millionths, as a whole number.  A
text's language is the one with the greatest sum of weights; n-grams outside the table count for
nothing, and a text without any that is inside is ``Unknown``.

Texts are brought to that form by column functions and reach numpy in Arrow batches, where the
n-grams of many texts are met at once and none becomes a row.  Counting gives a row per n-gram,
language and task, whose number depends on alphabets and not on the corpus; each list is a distributed
top list.  Scoring looks the table up in the task (it is small by construction): one row of sums
travels for each text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.sources.tables import stored

SIZES = (1, 2, 3)
MOST = 3000
UNIT = 1_000_000
UNKNOWN = "Unknown"
PIECE = 1 << 20  # characters of texts taken together
WINDOW = 1 << 18  # places looked up together
TABLE = 1 << 24  # entries of a lookup table
HELD = 500_000  # n-grams a task counts before it passes them on


def letters(text: Column) -> Column:
    """The words of a text in lower case between single spaces, with a space at either end."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}]+", " ")


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts as the code points of all in a row and the place where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - sizes[low] + PIECE, side="right")))
        codes = np.frombuffer("".join(texts[low:high]).encode("utf-32-le"), np.uint32)
        yield codes, (ends - sizes)[low:high] - (ends[low] - sizes[low])
        low = high


def tally(codes: np.ndarray, sizes: Sequence[int] = SIZES) -> dict[str, int]:
    """How often each n-gram occurs in texts of ``letters`` that stand in a row.  Two spaces side
    by side are a border of texts, so what holds them is no n-gram of a text."""
    present = np.flatnonzero(np.bincount(codes))
    names = np.zeros(int(codes.max()) + 1, np.int64)
    names[present] = np.arange(len(present))
    names, letter = names[codes], [chr(c) for c in present.tolist()]
    out, grams = {}, [""]
    keys, bound, found = np.zeros(len(codes) + 1, np.int64), 1, np.zeros(1, np.int64)
    for n in range(1, min(max(sizes), len(codes)) + 1):
        if bound > (1 << 62) // len(letter):
            keys, bound, found = np.searchsorted(found, keys), len(found), np.arange(len(found))
        keys, bound, shorter = keys[:-1] * len(letter) + names[n - 1:], bound * len(letter), found
        if bound <= 4 * len(keys):
            counts = np.bincount(keys, minlength=bound)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            ordered = np.sort(keys)
            first = np.flatnonzero(np.diff(ordered, prepend=-1))
            found, counts = ordered[first], np.diff(first, append=len(ordered))
        heads, tails = np.divmod(found, len(letter))
        grams = [grams[head] + letter[tail] for head, tail in zip(np.searchsorted(shorter, heads).tolist(), tails.tolist())]
        if n in sizes:
            out.update((gram, count) for gram, count in zip(grams, counts.tolist()) if "  " not in gram)
    return out


class Lookup:
    """Sums of the weights of n-grams over texts of ``letters``.

    The n-grams that begin at one place are prefixes of each other, so the table is a tree of
    prefixes, numbered by length, and the longest one found at a place has the sum of all.
    """

    def __init__(self, table: Sequence[Sequence], width: int, sizes: Sequence[int] = SIZES):
        wanted = [(gram, weights) for gram, *weights in table if len(gram) in sizes and "  " not in gram]
        alphabet = sorted({c for gram, _ in wanted for c in gram})
        self.names = np.zeros(0x110000, np.int64)  # 0: a character of no n-gram
        self.names[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.letters = len(alphabet) + 1
        prefixes = sorted({gram[:n] for gram, _ in wanted for n in range(1, len(gram) + 1)}, key=len)
        nodes = {"": 1, **{prefix: i for i, prefix in enumerate(prefixes, 2)}}  # 0: none
        sums = np.zeros((len(nodes) + 1, 1 + width), np.int64)
        for gram, weights in wanted:
            sums[nodes[gram]] += (1, *weights)
        for prefix in prefixes:
            sums[nodes[prefix]] += sums[nodes[prefix[:-1]]]
        self.sums = np.ascontiguousarray(sums.T)
        self.longest = max(map(len, prefixes), default=0)
        keys = np.array([nodes[p[:-1]] * self.letters + self.names[ord(p[-1])] for p in prefixes], np.int64)
        ends = np.arange(2, len(prefixes) + 2)
        order = np.argsort(keys)
        self.keys, self.ends, self.next = keys[order], ends[order], None
        if len(sums) * self.letters <= TABLE:
            self.next = np.zeros(len(sums) * self.letters, np.int32)
            self.next[keys] = ends

    def step(self, nodes: np.ndarray, names: np.ndarray) -> np.ndarray:
        keys = nodes * np.int64(self.letters) + names
        if self.next is not None:
            return self.next[keys]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ends[at], 0)

    def __call__(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text the number of its n-grams in the table and the sums of their weights."""
        out = np.zeros((len(self.sums), len(starts)), np.int64)
        for low in range(0, len(codes), WINDOW):
            high = min(low + WINDOW, len(codes))
            names = np.zeros(high - low + self.longest, np.int64)
            ahead = self.names[codes[low:high + self.longest]]
            names[:len(ahead)] = ahead
            nodes = np.ones(high - low, np.int32)
            deepest = np.zeros(high - low, np.int32)
            for n in range(self.longest):
                nodes = self.step(nodes, names[n:n + high - low])
                deepest = np.maximum(deepest, nodes)
            first, last = np.searchsorted(starts, [low, high - 1], side="right")
            cuts = np.maximum(starts[first - 1:last] - low, 0)
            for total, weights in zip(out, self.sums):
                total[first - 1:last] += np.add.reduceat(weights[deepest], cuts)
        return out


def learn_profiles(rows: DataFrame, languages: Sequence[str], lang: str = "lang", text: str = "text",
                   sizes: Sequence[int] = SIZES, most: int = MOST) -> DataFrame:
    """``(gram, w_<language> ...)`` of texts whose language is one of ``languages``.

    Ties at the end of a language's list go to the n-gram that comes first.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(Counter)

        def rows_of():
            for name, grams in found.items():
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(grams), "gram": list(grams), "n": list(grams.values())},
                                                 pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))
            found.clear()

        for batch in batches:
            texts = defaultdict(list)
            for name, body in zip(*(column.to_pylist() for column in batch.columns)):
                texts[name].append(body)
            for name, bodies in texts.items():
                for codes, _ in pieces(bodies):
                    found[name].update(tally(codes, sizes))
                    if sum(map(len, found.values())) > HELD:
                        yield from rows_of()
        yield from rows_of()

    known = rows.filter(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("body"))
    counts = (known.mapInArrow(count, "lang string, gram string, n long").groupBy("gram")
              .agg(*[F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in languages]))
    counts = stored(counts, "gram-counts")
    # A language's list is a distributed top list; shares are over all its n-grams, listed or not.
    tops = [counts.filter(f"n_{name} > 0").orderBy(F.desc(f"n_{name}"), "gram").limit(most).select("gram") for name in languages]
    listed = reduce(DataFrame.unionByName, tops).distinct()
    totals = counts.agg(F.count("*").alias("all_grams"), *[F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}") for name in languages]).first()
    weights = [F.round(UNIT * F.log((F.col(f"n_{name}") + 1) / F.lit(totals[f"n_{name}"] + totals["all_grams"]))).cast("long").alias(f"w_{name}")
               for name in languages]
    return counts.join(F.broadcast(listed), "gram", "left_semi").select("gram", *weights)


def detect_by_profiles(docs: DataFrame, profiles: DataFrame, languages: Sequence[str], key: str = "doc_id",
                       text: str = "text", sizes: Sequence[int] = SIZES) -> DataFrame:
    """``(key, score_<language> ..., language)``: a row for each key, ties to the language listed
    first; a text that cannot be told scores 0 in all.  ``profiles`` goes to every task."""
    columns = [f"score_{name}" for name in languages]
    table = [tuple(r) for r in profiles.select("gram", *[f"w_{name}" for name in languages]).collect()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(table, len(columns), sizes)
        for batch in batches:
            found = [lookup(codes, starts) for codes, starts in pieces(batch.column(1).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.concatenate(found, axis=1))],
                                                 names=["key", "known", *columns])

    given = docs.select(F.col(key).alias("key"), letters(F.col(text)).alias("body"))
    kind = given.schema["key"].dataType.simpleString()
    sums = (given.mapInArrow(score, f"key {kind}, known long, " + ", ".join(f"`{c}` long" for c in columns))
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("known", *columns)]))
    scores = [F.col(f"score_{name}") for name in languages]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    pick = F.coalesce(*[F.when(score == best, F.lit(name)) for name, score in zip(languages, scores)])
    return sums.select(F.col("key").alias(key), *scores, F.when(F.col("known") > 0, pick).otherwise(UNKNOWN).alias("language"))
