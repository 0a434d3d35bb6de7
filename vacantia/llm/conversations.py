"""Repair of conversations' structure by an auction over a lattice of edits.

A conversation should be empty or read ``s?(ua)+`` by its roles' initials.  Each row can be kept (0),
given the role user or assistant (3) or deleted (4, the only way for a blank row or one seen before);
an empty row of user or assistant can be inserted anywhere (3); a truncated row that stays adds 3.
The cheapest edits are a shortest path in a lattice: a node is a number of rows done and the last
initial written (none, s, u, a), an arc is an edit.

*Auction.*  Each node has a price, 0 at first, never above its distance to the end.  A path grows
from an origin: if the price of its last node is below the cheapest arc and next price, the price
is raised to that and the path contracts by a node; otherwise the path is extended along that arc.
The origins are all nodes, from the last row to the first, and prices are kept, so that a path ends
at the first node that was an origin before; each price is then exact.

*Tight arcs.*  With exact prices the cheapest paths are those of tight arcs, whose cost is the
difference of the prices at their ends, and every tight arc leads on to the end.  The least of the
cheapest rows of edits (initials D, I, K, R, in ASCII order) takes the first tight arc at each node.

*Long conversations* are cut into parts of at most ``PART_ROWS`` rows and ``PART_CHARS`` characters
wherever they lie, so none needs to fit one task.  An auction per exit gives a part's 4 x 4 table
of costs; tables are multiplied (minimum of sums) in groups of ``FAN`` parts, level by level, which
gives the prices at every border; with these each part maps entry to exit, maps are composed the
same way, and each part is traced from the node at which the conversation enters it.  Rows seen
before are found across parts by digest.

Defined cases: conversations are rows of equal id, null among them; rows come by turn, nulls first,
equal turns by role and a hash of the text; null role or text is one space; initials other than s,
u, a, and an empty role's, cannot be kept; repeated rows are duplicates; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.sources.tables import stored

PART_ROWS = 256
PART_CHARS = 1_000_000
FAN = 512
SPACE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40

START, S, U, A = range(4)  # the last initial written
WRITES_USER, WRITES_ASSISTANT = {START: U, S: U, A: U}, {U: A}
KEEPS = {"s": {START: S}, "u": WRITES_USER, "a": WRITES_ASSISTANT}
WRITES = {**WRITES_USER, **WRITES_ASSISTANT}  # by a new role or an inserted row
ROLES = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
#: What a row's kind says: its initial, in upper case if it is truncated, or that it must go.
GONE = "-"

PART = ("conv_id {id}, conv_key string, part long, complete boolean, messages array<struct<role:string,text:string>>, "
        "turns array<long>, firsts array<binary>, edits string, cost long, blank long, duplicate long, "
        "truncated long, illegal long, n_turns long, min_turn long, max_turn long")


# --- lattice -----------------------------------------------------------------------

def row_arcs(kind: str) -> list[list[tuple[str, int, int]]]:
    """The edits of a row of this kind from each state: ``(initial, cost, next state)``, by initial."""
    more = TRUNCATED if kind.isupper() else 0
    arcs = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if kind != GONE:
            kept = KEEPS.get(kind.lower(), {}).get(state)
            if kept is not None:
                own.append(("K", more, kept))
            own.append(("R", REROLE + more, WRITES[state]))
        arcs.append(own)
    return arcs


ARCS: dict[str, list[list[tuple[str, int, int]]]] = {}


def arcs_of(kind: str) -> list[list[tuple[str, int, int]]]:
    if kind not in ARCS:
        ARCS[kind] = row_arcs(kind)
    return ARCS[kind]


def auction(kinds: str, exits: list[int], last: bool) -> list[int]:
    """Exact prices of the nodes ``4 * rows done + state``: least cost to the end of the part plus
    that exit's; ``NEVER`` where no exit can be reached.  Rows may be inserted behind the last row
    only in a conversation's ``last`` part: elsewhere that place belongs to the next part."""
    n = len(kinds)
    prices = [NEVER] * (4 * n + 4)
    for place in range(n, -1, -1):
        base = 4 * place
        inserts = place < n or last
        ahead = arcs_of(kinds[place]) if place < n else None

        def arcs(state):
            """Costs with the settled price behind them, and next states of this place."""
            if ahead is None:
                settled = [exits[state]]
            else:
                settled = [cost + prices[base + 4 + to] for _, cost, to in ahead[state]]
            return min(settled), WRITES[state] if inserts else None

        options = [arcs(state) for state in range(4)]
        # Nodes that can leave this place at all, by inserted rows or not.
        able = [cost < NEVER for cost, _ in options]
        for _ in range(3):
            able = [a or (to is not None and able[to]) for a, (_, to) in zip(able, options)]
        price, settled_here = [0] * 4, [False] * 4
        for origin in range(4):
            if not able[origin]:
                continue
            path = [origin]
            while not settled_here[path[-1]]:
                at = path[-1]
                leave, to = options[at]
                stay = INSERT + price[to] if to is not None and able[to] else NEVER
                best = min(leave, stay)
                if price[at] < best:
                    price[at] = best
                    if len(path) > 1:
                        path.pop()
                elif leave == best:  # a settled node, or the end
                    break
                else:
                    path.append(to)
            settled_here[origin] = True
        for state in range(4):
            if able[state]:
                prices[base + state] = price[state]
    return prices


def trace(kinds: str, prices: list[int], entry: int, last: bool) -> tuple[str, list[int], int]:
    """The least row of tight arcs from ``entry``: initials, states after each, exit state."""
    n, place, state = len(kinds), 0, entry
    edits, states = [], []
    while place < n or last:
        here = prices[4 * place + state]
        if place == n and here == 0:
            break
        arcs = [(c, cost, place + 1, to) for c, cost, to in arcs_of(kinds[place])[state]] if place < n else []
        arcs.append(("I", INSERT, place, WRITES[state]))
        edit, _, place, state = min(a for a in arcs if a[1] + prices[4 * a[2] + a[3]] == here)
        edits.append(edit)
        states.append(state)
    return "".join(edits), states, state


ENDS = [0, NEVER, NEVER, 0]  # nothing, or a row of the assistant


def table(kinds: str, last: bool) -> list[int]:
    """Costs from each entry to each exit, entry by entry."""
    if last:  # one exit, the end, counted as state 0
        column = auction(kinds, ENDS, True)[:4]
        return [x for c in column for x in (c, NEVER, NEVER, NEVER)]
    columns = [auction(kinds, [0 if q == q2 else NEVER for q2 in range(4)], False)[:4] for q in range(4)]
    return [columns[q][e] for e in range(4) for q in range(4)]


def rewritten(roles: list[str], texts: list[str], edits: str, states: list[int]) -> list[dict]:
    """The messages that the edits leave."""
    out, row = [], 0
    for edit, state in zip(edits, states):
        if edit == "I":
            out.append({"role": ROLES[state], "text": ""})
            continue
        if edit != "D":
            out.append({"role": roles[row] if edit == "K" else ROLES[state], "text": texts[row]})
        row += 1
    return out


def described(roles, texts, turns, again: Callable[[int], bool], before: tuple | None) -> tuple[str, dict]:
    """The rows' kinds and the part's counts; ``before`` is the initial and turn of the row before."""
    kinds, found = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
    last, last_turn = before or (None, None)
    for i, (role, text, turn) in enumerate(zip(roles, texts, turns)):
        body, initial = text.strip(SPACE), role[:1]
        if not body:
            fault, kind = "blank", GONE
        elif again(i):
            fault, kind = "duplicate", GONE
        else:
            known = initial in KEEPS
            fault, kind = (None, initial if known else "x") if body[-1] in ".!?" else ("truncated", initial.upper() if known else "X")
        kinds.append(kind)
        if fault:
            found[fault] += 1
        if last is not None and last + initial not in LEGAL:
            found["illegal"] += 1
        if turn is not None and turn != last_turn:
            found["n_turns"] += 1
        last, last_turn = initial, turn
    numbered = [t for t in turns if t is not None]
    return "".join(kinds), found | {"min_turn": min(numbered, default=None), "max_turn": max(numbered, default=None)}


# --- parts -------------------------------------------------------------------------

def first_seen(roles: list[str], texts: list[str]) -> list[bool]:
    seen = set()
    return [not (pair in seen or seen.add(pair)) for pair in zip(roles, texts)]


def whole(conv, roles, texts, turns) -> dict:
    """A conversation that lies in one part, repaired."""
    firsts = first_seen(roles, texts)
    kinds, found = described(roles, texts, turns, lambda i: not firsts[i], None)
    prices = auction(kinds, ENDS, True)
    edits, states, _ = trace(kinds, prices, START, True)
    return {**conv, "part": 0, "complete": True, "messages": rewritten(roles, texts, edits, states),
            "turns": None, "firsts": None, "edits": edits, "cost": prices[START], **found}


def raw(conv, part, roles, texts, turns) -> dict:
    """A part of a conversation that may go on elsewhere, as it is."""
    firsts = [hashlib.sha256(f"{len(r)}:{r}:{t}".encode()).digest() if new else None
              for r, t, new in zip(roles, texts, first_seen(roles, texts))]
    return {**conv, "part": part, "complete": False, "messages": [{"role": r, "text": t} for r, t in zip(roles, texts)],
            "turns": turns, "firsts": firsts}


def sliced(rows: Iterator[tuple], most_rows: int, most_chars: int) -> Iterator[dict]:
    """Parts of the sorted rows of one range.  The range's first and last conversation may have
    rows in other ranges."""
    first, cut, part = True, False, 0
    key, conv, roles, texts, turns, size = None, None, [], [], [], 0

    for conv_id, conv_key, turn, role, text in rows:
        new = conv_key != key
        if roles and (new or len(roles) >= most_rows or size + len(text) > most_chars):
            if new and not first and not cut:
                yield whole(conv, roles, texts, turns)
            else:
                yield raw(conv, part, roles, texts, turns)
                part += 1
            cut = not new
            first &= not new
            roles, texts, turns, size = [], [], [], 0
        if new:
            key, conv, cut = conv_key, {"conv_id": conv_id, "conv_key": conv_key}, False
        roles.append(role)
        texts.append(text)
        turns.append(turn)
        size += len(text)
    if roles:
        yield raw(conv, part, roles, texts, turns)


def batches_of(rows: Iterator[dict], schema: pa.Schema, most: int = 500, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(m["text"]) for m in row.get("messages") or ())
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_schema(spark: SparkSession, schema) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


def cut(turns: DataFrame, conv: str, turn: str, role: str, text: str, rows: int, chars: int) -> DataFrame:
    """Rows in order, in parts; conversations that lie within one part of one range are repaired."""
    ordered = turns.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv_key"),
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    kind = ordered.schema["conv_id"].dataType.simpleString()
    order = ["conv_key", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order[:-1])
    schema = PART.format(id=kind)
    shape = arrow_schema(ordered.sparkSession, schema)

    def run(batches):
        def rows_of():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))
        offset = TaskContext.get().partitionId() << 33
        found = sliced(rows_of(), rows, chars)
        yield from batches_of((r | {"part": r["part"] + offset} for r in found), shape)

    return ordered.mapInArrow(run, schema)


def scan(elements: DataFrame, state: list[int], compose: Callable, step: Callable, backward: bool) -> DataFrame:
    """For each ``(conv_key, part, element)`` the state before it, ``(conv_key, part, state)``.

    Elements of a conversation are composed in groups of ``FAN``, the groups' likewise, until one
    is left; states are then handed down.  No task sees more than a group.
    """
    levels = [elements]
    while levels[-1].agg(F.max("part")).first()[0]:
        def composed(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part", ascending=not backward)
            total = group["element"].iloc[0]
            for element in group["element"].iloc[1:]:
                total = compose(total, element)
            return pd.DataFrame({"conv_key": group["conv_key"].iloc[:1].values,
                                 "part": [int(group["part"].iloc[0]) // FAN], "element": [list(map(int, total))]})
        up = (levels[-1].groupBy("conv_key", F.expr(f"part div {FAN}").alias("group"))
              .applyInPandas(composed, "conv_key string, part long, element array<long>"))
        levels.append(stored(up, "conversation-levels"))
    states = levels[-1].select("conv_key", "part", F.lit(state).cast("array<long>").alias("state"))

    def handed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", ascending=not backward)
        now, before = list(group["state"].iloc[0]), []
        for element in group["element"]:
            before.append(list(map(int, now)))
            now = step(element, now)
        return pd.DataFrame({"conv_key": group["conv_key"], "part": group["part"], "state": before})

    for level in reversed(levels[:-1]):
        above = states.select("conv_key", F.col("part").alias("group"), "state")
        states = (level.withColumn("group", F.expr(f"part div {FAN}")).join(above, ["conv_key", "group"])
                  .groupBy("conv_key", "group").applyInPandas(handed, "conv_key string, part long, state array<long>"))
    return states


def least_sums(later, earlier) -> list[int]:
    """The table of an earlier part and, behind it, a later one."""
    one, two = np.array(earlier).reshape(4, 4), np.array(later).reshape(4, 4)
    return np.minimum((one[:, :, None] + two[None, :, :]).min(axis=1), NEVER).ravel().tolist()


def prices_before(element, after) -> list[int]:
    both = np.array(element).reshape(4, 4) + np.array(after)[None, :]
    return np.minimum(both.min(axis=1), NEVER).tolist()


def numbered(parts: DataFrame) -> DataFrame:
    """Parts numbered from 0 within their conversation, with what the row before them was."""
    ranges = parts.groupBy(F.expr("part >> 33").alias("range_no")).count()
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    dense = (parts.withColumn("range_no", F.expr("part >> 33")).join(F.broadcast(starts), "range_no")
             .withColumn("place", F.col("start") + F.expr(f"part & {(1 << 33) - 1}")))
    dense = stored(dense.drop("range_no", "start"), "conversation-parts")
    extent = dense.groupBy("conv_key").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    ends = dense.select("conv_key", (F.col("place") + 1).alias("place"), F.struct(
        F.element_at("messages.role", -1).substr(1, 1).alias("initial"), F.element_at("turns", -1).alias("turn")).alias("before"))
    return (dense.join(extent, "conv_key").join(ends, ["conv_key", "place"], "left")
            .withColumns({"part": F.col("place") - F.col("first_place"), "last": F.col("place") == F.col("last_place")})
            .drop("place", "first_place", "last_place"))


def across(parts: DataFrame) -> DataFrame:
    """Conversations that lie in several parts, or may do so, repaired."""
    spark = parts.sparkSession
    rows = stored(numbered(parts), "conversation-numbered")
    seen = (rows.select("conv_key", "part", F.posexplode("firsts").alias("row", "digest")).filter("digest is not null")
            .groupBy("conv_key", "digest").agg(F.min(F.struct("part", "row")).alias("first"))
            .groupBy("conv_key", "first.part").agg(F.collect_list("first.row").alias("new_rows")))
    ready = rows.drop("firsts").join(seen, ["conv_key", "part"], "left")
    schema = "conv_key string, part long, last boolean, kinds string, counts map<string,long>"
    kinds_shape, parts_shape = arrow_schema(spark, schema), arrow_schema(spark, parts.schema)

    def describe(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                new, before = set(r["new_rows"] or ()), r["before"]
                kinds, counts = described(r["roles"], r["texts"], r["turns"], lambda i: i not in new,
                                          (before["initial"], before["turn"]) if before else None)
                out.append({"conv_key": r["conv_key"], "part": r["part"], "last": r["last"], "kinds": kinds,
                            "counts": list(counts.items())})
            yield pa.RecordBatch.from_pylist(out, kinds_shape)

    kinds = stored(ready.select("conv_key", "part", "last", F.col("messages.role").alias("roles"), F.col("messages.text").alias("texts"),
                                "turns", "before", "new_rows").mapInArrow(describe, schema), "conversation-kinds")

    def elements(of: Callable):
        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                values = pa.array([of(r) for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("conv_key"), batch.column("part"), values],
                                                 names=["conv_key", "part", "element"])
        return run

    def exits(r) -> list[int]:
        """The exit of each entry, with the prices behind the part known."""
        if r["last"]:
            return [0] * 4
        prices = auction(r["kinds"], r["state"], False)
        return [trace(r["kinds"], prices, entry, False)[2] for entry in range(4)]

    shape_of = "conv_key string, part long, element array<long>"
    tables = stored(kinds.mapInArrow(elements(lambda r: table(r["kinds"], r["last"])), shape_of), "conversation-tables")
    # The end counts as state 0 behind the last part, see ``table``.
    behind = scan(tables, [0, NEVER, NEVER, NEVER], least_sums, prices_before, backward=True)
    priced = stored(kinds.join(behind, ["conv_key", "part"]), "conversation-prices")
    maps = stored(priced.mapInArrow(elements(exits), shape_of), "conversation-maps")
    entries = scan(maps, [START], lambda one, two: [two[x] for x in one], lambda f, at: [f[at[0]]], backward=False)
    final = (rows.select("conv_id", "conv_key", "part", "messages")
             .join(priced.withColumnRenamed("state", "behind"), ["conv_key", "part"])
             .join(entries, ["conv_key", "part"]))

    def finish(batches):
        def repaired():
            for batch in batches:
                for r in batch.to_pylist():
                    prices = auction(r["kinds"], ENDS if r["last"] else r["behind"], r["last"])
                    entry = r["state"][0]
                    edits, states, leave = trace(r["kinds"], prices, entry, r["last"])
                    roles, texts = ([m[k] for m in r["messages"]] for k in ("role", "text"))
                    after = 0 if r["last"] else r["behind"][leave]
                    yield {"conv_id": r["conv_id"], "conv_key": r["conv_key"], "part": r["part"], "complete": False,
                           "messages": rewritten(roles, texts, edits, states), "edits": edits,
                           "cost": prices[entry] - after, **dict(r["counts"])}
        yield from batches_of(repaired(), parts_shape)

    return final.mapInArrow(finish, parts.schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           rows: int = PART_ROWS, chars: int = PART_CHARS) -> DataFrame:
    """Repaired parts: ``conv_id, conv_key, part, complete, messages, edits, cost``, counts.

    ``messages`` are the rows to keep, in order, ``edits`` the edits' initials; parts of a
    conversation follow each other by ``part``; ``complete`` says that there is only one.
    """
    parts = stored(cut(turns, conv, turn, role, text, rows, chars), "conversation-cut")
    found = parts.filter("complete").unionByName(across(parts.filter("not complete")))
    return found.drop("turns", "firsts")


def report(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: counts, cost and audit, the edits' initials."""
    parts = F.sort_array(F.collect_list(F.struct("part", "edits")))
    span = F.max("max_turn") - F.min("min_turn") + 1 - F.sum("n_turns")
    return repaired.groupBy("conv_key").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(span, F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("audit"))


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_key, sha256)`` of the messages, ``role:text``, joined by line breaks.

    Such a digest can only be formed in order: the parts of a long conversation pass one task as
    a stream of sorted rows, of which one is held at a time.
    """
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    one = repaired.filter("complete").select("conv_key", F.sha2(lines, 256).alias("sha256"))

    def run(batches):
        key, state, begun, out = None, None, False, []
        for batch in batches:
            for conv_key, text in zip(batch.column("conv_key").to_pylist(), batch.column("lines")):
                if conv_key != key:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state, begun = conv_key, hashlib.sha256(), False
                if text.is_valid:
                    state.update((b"\n" if begun else b"") + text.as_py().encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv_key", "sha256"])
                out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["conv_key", "sha256"])

    several = (repaired.filter("not complete").select("conv_key", "part", F.when(F.size("messages") > 0, lines).alias("lines"))
               .repartition("conv_key").sortWithinPartitions("conv_key", "part"))
    return one.unionByName(several.mapInArrow(run, "conv_key string, sha256 string"))
