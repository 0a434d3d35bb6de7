"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the hashes of its distinct five-word shingles.  Two sets link if their
Jaccard similarity is at least 3/4; with r <= s elements they then differ in at most
H = (r + s) / 7 elements, and s <= 4 r / 3.

*Segments.*  Sets are banded by size (powers of two).  Each band cuts the universe of hashes into
m segments.  If a set R of the band values its segments v = 0 (ignored), 1 (must agree) or 2 (may
differ by one element), and these sum to more than the largest H for its size, then any linked set
S at least as large agrees with R in some segment within its value.

*Index.*  A signature is a hash of band, segment and the subset of the set that falls in it.  R's
non-empty segments are valued 1.  Where they are too few, small segments among the band's
``deletable`` ones are valued 2 and their one-deletion neighbourhoods are indexed as well; where
they are more than needed, the surplus pays for ignoring the costliest signatures, those whose
lists are longest.  Every set probes its own band and, if a smaller partner may lie there, the
band below, with its subsets and, in deletable segments, their one-deletion neighbourhoods.

*Lists.*  Equal signatures meet by a shuffle and a sort; a sorted list is passed through as a
stream, however long, and signatures of one set alone go no further.  First every list links its
sets to its smallest ones only (a star); pairs with enough such lists are verified, which joins
most groups of near copies without forming their pairs.  Then only lists that still hold
different components are looked at, without the signatures that the surplus pays for: short ones
by pairs across components, those that stay long by blocks of sets, whose pairs are counted
within a task and never become rows.

*Verification* is exact, on the sets themselves (64-bit hashes).  Texts that are equal are one set
from the start; texts are read again for the sets that take part in a pair.  Components are those
of ``common.components``.

Sets for which no valuation suffices (all elements in very few segments; next to never) are held
against all sets, in blocks.

Defined cases: a null or wordless text has an empty set and links with nothing, copies of it
included; a text of fewer than five words has its whole word sequence as its one shingle; rows
with one key and different texts are different documents; rows without a key may link others but
give no component id; repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import components, distinct, running, small, text_of
from vacantia.sources.tables import stored

SHINGLE = 5
SEGMENT_SHARE = 0.45  # segments of a band per element of its largest set
LEAST_SEGMENTS = 16
DELETABLE = 8  # segments with deletions in bands of large sets; in bands of small ones all
SMALL_BAND = 5  # bands below this are of small sets
WORDS_KEPT = 300_000  # word hashes that a worker remembers
FEW = 500_000  # keys or digests that may be broadcast
STAR_ROUNDS = 1
STAR = 4  # a pair of a star has more than this part of the surplus in lists
COSTLY = 32  # rows of a list that is worth ignoring
BLOCK_ELEMENTS = 1 << 18  # of a block of sets, and
BLOCK_SETS = 1 << 11  # sets of it at most
COLUMNS = 1024
BLOCK = 500  # sets without a valuation in one pass

PLAIN, RAISED, DELETED, OFFERED, BELOW = 1, 2, 4, 8, 16  # roles of a signature
HARD = (1 << 16) - 1  # surplus of a set without a valuation


# --- sets --------------------------------------------------------------------------

class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


WORD_HASHES = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    out = values ^ (values >> np.uint64(33))
    out = out * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out = out * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    rolled = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n - size + 1 + i]
    return distinct(mixed(rolled))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 4 * len(a) < 3 * len(b):
        return False
    common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * common >= 75 * (len(a) + len(b) - common)


# --- signatures --------------------------------------------------------------------

def needed(size: int) -> int:
    """The sum that a set's values must reach."""
    return (size + 4 * size // 3) // 7 + 1


def segments(band: int) -> int:
    largest = (2 << band) - 1
    return max(int(np.ceil(SEGMENT_SHARE * largest)), min(largest, LEAST_SEGMENTS))


def deletable(band: int) -> int:
    return segments(band) if band < SMALL_BAND else DELETABLE


def cut(elements: np.ndarray, weights: np.ndarray, band: int):
    """Non-empty segments of a set in a band: number, first element, size, sum of weights."""
    number = ((elements >> np.uint64(32)) * np.uint64(segments(band))) >> np.uint64(32)
    first = np.flatnonzero(np.diff(number, prepend=np.uint64(2**63)))
    return number[first], first, np.diff(first, append=len(elements)), np.add.reduceat(weights, first)


def named(sums: np.ndarray, number: np.ndarray, band: int) -> np.ndarray:
    return mixed(sums + number * np.uint64(0xD6E8FEB86659FD93) + np.uint64((band + 1) * 0xA0761D6478BD642F % 2**64))


def deletions(weights, number, first, size, sums, band) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the deletable segments of two elements or more without one element each,
    and the segment (its place among the non-empty ones) of each."""
    chosen = np.flatnonzero((number < deletable(band)) & (size >= 2))
    if not len(chosen):
        return np.zeros(0, np.uint64), chosen
    of = np.repeat(chosen, size[chosen])
    begin = np.cumsum(size[chosen]) - size[chosen]
    element = np.repeat(first[chosen] - begin, size[chosen]) + np.arange(len(of))
    return named(sums[of] - weights[element], number[of], band), of


def signatures(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The signatures of a set, their roles and the set's surplus of values."""
    size = len(elements)
    weights = mixed(elements + np.uint64(0x9FB21C651E98DF25))
    band = size.bit_length() - 1
    number, first, count, sums = cut(elements, weights, band)
    surplus, hard = len(number) - needed(size), False
    roles = np.full(len(number), PLAIN, np.int64)
    dropped, of = deletions(weights, number, first, count, sums, band)
    offers = np.full(len(dropped), OFFERED, np.int64)
    if surplus < 0:
        able = distinct(of)
        raised = able[np.argsort(count[able], kind="stable")[:-surplus]]
        roles[raised] |= RAISED
        offers[np.isin(of, raised)] |= DELETED
        if len(raised) < -surplus:
            hard = True
        surplus = 0
    out, kinds = [named(sums, number, band), dropped], [roles, offers]
    if band and -(-3 * size // 4) < 1 << band:
        number, first, count, sums = cut(elements, weights, band - 1)
        dropped, _ = deletions(weights, number, first, count, sums, band - 1)
        out += [named(sums, number, band - 1), dropped]
        kinds += [np.full(len(number), BELOW, np.int64), np.full(len(dropped), OFFERED, np.int64)]
    return np.concatenate(out), np.concatenate(kinds), HARD if hard else min(surplus, HARD - 1)


SIGNATURES = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("meta", pa.int64())])


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of each text, ``meta`` being size, surplus and role; a row of role 0 holds the
    size of the set alone."""
    held, rows = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(3)],
                                          schema=SIGNATURES)

    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            elements = shingle_set(text.as_py())
            if len(elements):
                sigs, roles, surplus = signatures(elements)
                sigs = np.append(sigs, mixed(np.array([node % 2**64], np.uint64)))
                roles = np.append(roles, 0)
            else:
                sigs, roles, surplus = mixed(np.array([node % 2**64], np.uint64)), np.zeros(1, np.int64), 0
            held.append((sigs.view(np.int64), np.full(len(sigs), node, np.int64),
                         np.int64(len(elements) << 21 | surplus << 5) | roles))
            rows += len(sigs)
            if rows >= 100_000:
                yield out()
                held, rows = [], 0
    if rows:
        yield out()


def size_of(meta: Column) -> Column:
    return F.shiftright(meta, 21)


def surplus_of(meta: Column) -> Column:
    return F.shiftright(meta, 5).bitwiseAND(F.lit(HARD))


def has(meta: Column, roles: int) -> Column:
    return meta.bitwiseAND(F.lit(roles)) != 0


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature, those that share theirs with another row, and those of role 0.

    Only the last row is carried from batch to batch, so a list may have any length.
    """
    held = [np.zeros(0, np.int64)] * 3
    before = None  # the signature of the row before the held one

    def passed(columns, last):
        sig = columns[0]
        same = np.concatenate([[before is not None and before == sig[0]], sig[1:] == sig[:-1], [False]])
        out = same[:-1] | same[1:] | (columns[2] & 31 == 0)
        if not last:
            out[-1] = False
        return pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], schema=SIGNATURES)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        yield passed(columns, False)
        if len(columns[0]) > 1:
            before = columns[0][-2]
        held = [c[-1:] for c in columns]
    if len(held[0]):
        yield passed(held, True)


# --- join --------------------------------------------------------------------------

def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, digest)`` of each row."""
    read = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return read.withColumn("digest", F.unhex(F.md5("text")))


def classes(rows: DataFrame) -> DataFrame:
    """``(digest, rep, n, node)`` of the texts that several rows share, or that need a made-up node.

    A text's node is its smallest key; without a key, or if another text has the same smallest
    key, it is a negative number made of the digest.
    """
    every = rows.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    again = every.groupBy("rep").agg(F.count("*").alias("texts")).filter("texts > 1 or rep is null")
    named = every.join(again.withColumnRenamed("rep", "r"), F.col("rep").eqNullSafe(F.col("r")), "left")
    made = -F.abs(F.shiftright(F.xxhash64("digest"), 2)) - 1
    return stored(named.filter("n > 1 or texts is not null").select(
        "digest", "rep", "n", F.when(F.col("texts").isNull(), F.col("rep")).otherwise(made).alias("node")), "copies")


def with_node(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` with the ``node`` of their text and whether they are the first row with it."""
    joined = rows.join(small(copies.withColumnRenamed("node", "own_node"), FEW), "digest", "left")
    return (joined.withColumn("node", F.coalesce("own_node", "key"))
            .withColumn("is_first", F.col("n").isNull() | F.col("key").eqNullSafe(F.col("rep")))
            .drop("rep", "n", "own_node"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets link."""
    def test(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64))
                    for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def made_sets(rows: DataFrame) -> DataFrame:
    """``(node, elements binary)`` of rows with ``node`` and ``text``."""
    def make(batches):
        for batch in batches:
            made = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "elements"])

    return rows.select("node", "text").mapInArrow(make, "node long, elements binary")


def sets_of(first_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the nodes in pairs."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    return made_sets(first_rows.join(small(wanted, FEW), "node", "left_semi"))


def check(pairs: DataFrame, first_rows: DataFrame, name: str) -> DataFrame:
    pairs = stored(pairs, f"{name}-pairs")
    return stored(verified(pairs, stored(sets_of(first_rows, pairs), f"{name}-sets")), f"{name}-links")


def mixed_lists(listed: DataFrame, component: DataFrame | None) -> DataFrame:
    """Rows of the lists that hold several components (at first every node is one), with the
    list's ``cost``, its number of rows.  Stored."""
    rows = listed.filter(has(F.col("meta"), 31)).select("sig", "node", "meta", size_of(F.col("meta")).alias("size"))
    if component is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(small(component, FEW), "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = Window.partitionBy("sig")
    counted = rows.select("*", F.count("*").over(whole).alias("cost"), F.min("component").over(whole).alias("low"),
                          F.max("component").over(whole).alias("high"))
    return stored(counted.filter("low < high").drop("low", "high"), "mixed-lists")


def stars(rows: DataFrame, surplus: DataFrame) -> DataFrame:
    """Pairs of a node with the most popular node of its lists.

    A node's popularity is the number of rows in all its lists.  The text that others were copied
    from shares lists with each of them, more than they do among themselves, and so becomes the
    middle of their lists.  A pair counts if it meets in enough lists; being a short cut only, it
    may miss links.
    """
    popular = stored(rows.groupBy("node").agg(F.sum("cost").alias("popularity")), "popularity")
    known = rows.join(small(popular, FEW), "node")
    middle = F.max(F.struct("popularity", "node", "size", "component")).over(Window.partitionBy("sig"))
    met = (known.withColumn("m", middle).filter(
        (F.col("m.component") != F.col("component")) & (3 * F.col("size") <= 4 * F.col("m.size"))
        & (3 * F.col("m.size") <= 4 * F.col("size"))))
    return (met.groupBy(F.col("m.node").alias("b"), F.col("node").alias("a")).agg(F.count("*").alias("n"))
            .join(small(surplus, FEW), "a").filter(F.col("n") * STAR > F.col("surplus")).select("a", "b"))


def allocated(rows: DataFrame) -> DataFrame:
    """The index side of mixed lists after the surplus is spent, with ``shared``, the number of
    these lists that a pair must share, and ``costly``.

    Linked sets differ in at most as many segments as the values allow for, so they share at least
    one list more than the smaller set's surplus; a set gives up its costliest lists for as much
    of the surplus as it has costly ones, and the rest of the surplus asks for that many shared
    lists more.
    """
    plain = has(F.col("meta"), PLAIN) & ~has(F.col("meta"), RAISED)
    costly = F.col("cost") >= COSTLY
    by_cost = Window.partitionBy("node", plain & costly).orderBy(F.desc("cost"), "sig")
    surplus = surplus_of(F.col("meta"))
    ranked = (rows.filter(has(F.col("meta"), PLAIN | DELETED)).withColumn("rank", F.row_number().over(by_cost))
              .withColumn("ignored", plain & costly & (F.col("rank") <= surplus)))
    ignored = F.sum(F.col("ignored").cast("long")).over(Window.partitionBy("node"))
    return (ranked.withColumn("shared", surplus - ignored + 1).filter(~F.col("ignored"))
            .select("sig", costly.alias("costly"), *[F.col(c).alias(f"i_{c}") for c in ("node", "meta", "size", "component", "shared")]))


def fits() -> Column:
    agrees = has(F.col("meta"), PLAIN | BELOW)
    order = F.struct("i_size", "i_node") < F.struct("size", "node")
    return ((F.col("i_component") != F.col("component")) & order & (3 * F.col("size") <= 4 * F.col("i_size"))
            & ((has(F.col("i_meta"), PLAIN | DELETED) & agrees)
               | (has(F.col("i_meta"), RAISED) & has(F.col("meta"), OFFERED))))


def across(indexed: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs in lists that are not costly, across components."""
    cheap = rows.filter(F.col("cost") < COSTLY)
    return (indexed.filter("not costly").join(cheap, "sig").filter(fits())
            .groupBy(F.col("i_node").alias("a"), F.col("node").alias("b"))
            .agg(F.count("*").alias("n"), F.max("i_shared").alias("shared")).filter("n >= shared").select("a", "b"))


def in_blocks(indexed: DataFrame, rows: DataFrame, first_rows: DataFrame) -> DataFrame:
    """Links in the costly lists that no surplus paid for, without forming their pairs.

    The sets in such lists are laid out by their most popular partner, so that similar ones lie
    together, and cut into blocks of bounded size.  Blocks that meet in a list are held against
    each other in one task, which returns no more links than it takes to join what is linked.
    """
    stuck = stored(indexed.filter("costly").select("sig", F.col("i_node").alias("node")), "stuck")
    met = stored(rows.join(stuck.select("sig").distinct(), "sig", "left_semi").select("sig", "node", "component", "cost", "size"), "met")
    popular = met.groupBy("node").agg(F.sum("cost").alias("popularity"), F.min("component").alias("component"),
                                      F.max("size").alias("size"))
    middle = F.max(F.struct("popularity", "m")).over(Window.partitionBy("sig"))
    family = (met.select("sig", "node").join(popular.withColumnRenamed("node", "m"), F.col("node") == F.col("m"))
              .withColumn("middle", middle["m"]).groupBy("node", "component", "size", "middle").agg(F.count("*").alias("n"))
              .groupBy("node", "component", "size").agg(F.max(F.struct("n", "middle"))["middle"].alias("family")))
    room = F.greatest("size", F.lit(BLOCK_ELEMENTS // BLOCK_SETS))
    placed = running(family, [F.col("family"), F.col("node")], "families", place=room)
    placed = stored(placed.select("node", "component", F.floor(F.col("place") / BLOCK_ELEMENTS).alias("block")), "blocks")
    of_list = lambda table: table.join(placed.select("node", "block"), "node").select("sig", "block").distinct()
    pairs = (of_list(stuck).withColumnRenamed("block", "c").join(of_list(met), "sig")
             .select(F.least("c", "block").alias("x"), F.greatest("c", "block").alias("y")).distinct())
    pairs = stored(pairs, "block-pairs")
    wanted = stored(placed.select("node"), "stuck-nodes")
    sets = made_sets(first_rows.join(small(wanted, FEW), "node", "left_semi"))
    members = stored(sets.join(placed, "node"), "block-sets")
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return (sides.join(members, "block").groupBy("x", "y")
            .applyInArrow(block_links, "a long, b long"))


def block_links(table: pa.Table) -> pa.Table:
    """Links between the sets of two blocks (or within one) of different components, enough of
    them to join all that are linked."""
    x = table.column("x")[0].as_py()
    block = table.column("block").to_numpy()
    nodes, component = table.column("node").to_numpy(), table.column("component").to_numpy()
    sets = [np.frombuffer(e.as_buffer(), np.uint64) for e in table.column("elements")]
    size = np.array([len(s) for s in sets], np.int64)
    first = np.flatnonzero(block == x)
    second = np.flatnonzero(block != x) if (block != x).any() else first
    owner = np.repeat(np.arange(len(sets)), size)
    elements, column = np.unique(np.concatenate(sets), return_inverse=True)
    # Only elements on both sides count; they are taken some columns at a time.
    on_first, on_second = np.zeros(len(elements), np.int64), np.zeros(len(elements), np.int64)
    np.add.at(on_first, column[np.isin(owner, first)], 1)
    np.add.at(on_second, column[np.isin(owner, second)], 1)
    both = (on_first > 0) & (on_second > 0) & (on_first + on_second > (2 if first is second else 1))
    number = np.cumsum(both) - 1
    owner, column = owner[both[column]], number[column[both[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(first), len(second)), np.float32)
    for start in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - start] = 1
        common += dense[first] @ dense[second].T
    union = size[first][:, None] + size[second][None, :] - common
    hits = np.argwhere((100 * common >= 75 * union) & (component[first][:, None] != component[second][None, :]))
    root = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    a, b = [], []
    for i, j in hits.tolist():
        p, q = find(component[first[i]]), find(component[second[j]])
        if p != q:
            root[p] = q
            a.append(nodes[first[i]])
            b.append(nodes[second[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def without_valuation(sizes: DataFrame, first_rows: DataFrame) -> DataFrame:
    """Links of the sets without a valuation, each block held against all texts."""
    hard = stored(sizes.filter(surplus_of(F.col("meta")) == HARD).select("node"), "hard")
    found = [hard.select(F.col("node").alias("a"), F.col("node").alias("b")).filter("false")]
    nodes = [r["node"] for r in hard.limit(BLOCK).collect()]
    while nodes:
        block = first_rows.filter(F.col("node").isin(nodes)).dropDuplicates(["node"]).select("node", "text").collect()
        chosen = [(r["node"], shingle_set(r["text"])) for r in block]

        def against(batches, chosen=chosen):
            for batch in batches:
                a, b = [], []
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own = shingle_set(text.as_py())
                    hits = [other for other, elements in chosen if other != node and linked(own, elements)]
                    a += [node] * len(hits)
                    b += hits
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        found.append(stored(first_rows.select("node", "text").mapInArrow(against, "a long, b long"), "hard-links"))
        hard = hard.filter(~F.col("node").isin(nodes))
        nodes = [r["node"] for r in hard.limit(BLOCK).collect()]
    return reduce(DataFrame.unionByName, found)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``(key, digest, node, is_first, size, component)`` and the texts shared by rows.

    ``component`` is the smallest node reachable; both tables are stored.
    """
    rows = texts(docs, key, text)
    narrow = stored(rows.drop("text"), "digests")
    copies = classes(narrow)
    first_rows = with_node(rows, copies).filter("is_first")
    spread = (first_rows.select("node", "text").mapInArrow(sign, "sig long, node long, meta long")
              .repartition("sig").sortWithinPartitions("sig", "meta", "node"))
    listed = stored(spread.mapInArrow(lists, "sig long, node long, meta long"), "lists")
    sizes = listed.filter(~has(F.col("meta"), 31)).select("node", "meta")
    surplus = stored(sizes.groupBy(F.col("node").alias("a")).agg(F.max(surplus_of(F.col("meta"))).alias("surplus")), "surplus")
    links, joined = without_valuation(sizes, first_rows), None
    for _ in range(STAR_ROUNDS):
        rows = mixed_lists(listed, joined)
        links = links.unionByName(check(stars(rows, surplus), first_rows, "star"))
        joined = components(links)
    rows = mixed_lists(listed, joined)
    indexed = stored(allocated(rows), "allocated")
    links = links.unionByName(check(across(indexed, rows), first_rows, "across"))
    links = links.unionByName(stored(in_blocks(indexed, rows, first_rows), "block-links"))
    joined = components(links)
    per_node = (sizes.groupBy("node").agg(F.max(size_of(F.col("meta"))).alias("size"))
                .join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    return stored(with_node(narrow, copies).join(per_node, "node"), "grouped"), copies


def shingle_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, n_shingles, component_id`` (the smallest key of the group).

    Copies of a text without words are not linked: each is its own group.
    """
    grouped, _ = groups(docs, key, text)
    least = grouped.filter("size > 0").groupBy("component").agg(F.min("key").alias("least"))
    own = F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("key"))
    return grouped.join(least, "component", "left").select(
        "key", F.col("size").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest key, with its own columns.

    Decisions are made per distinct text: a group keeps one text, and of a kept text's rows one.
    Documents without words are all kept.
    """
    grouped, copies = groups(docs, key, text)
    worded = grouped.filter("size > 0")
    stays = worded.groupBy("component").agg(F.min(F.struct(F.col("key").isNull(), "key", "digest")).alias("s"))
    goes = stored(worded.join(stays, "component").filter(F.col("digest") != F.col("s.digest"))
                  .select("digest").distinct(), "near-copies")
    shared = stored(copies.filter("n > 1").join(worded.select("digest").distinct(), "digest", "left_semi")
                    .select("digest", "rep", F.lit(True).alias("shared")), "shared-texts")
    packed = docs.select(F.struct(*docs.columns).alias("document"), F.col(key).alias("key"),
                         F.unhex(F.md5(text_of(text))).alias("digest"))
    left = packed.join(small(goes, FEW), "digest", "left_anti").join(small(shared, FEW), "digest", "left")
    single = left.filter("shared is null")
    once = left.filter(F.col("shared") & F.col("key").eqNullSafe(F.col("rep"))).dropDuplicates(["digest"])
    return single.select("document.*").unionByName(once.select("document.*"))
