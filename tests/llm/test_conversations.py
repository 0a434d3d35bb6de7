import hashlib
import heapq
import random
import zlib

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from vacantia.llm import conversations as C
from vacantia.llm.queries import QUERIES, damaged

SPACE = " \t\n\v\f\r"
TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Counts, cost, audit and messages of ordered rows ``(turn, role, text)``, by a search that
    takes partial repairs in order of cost and initials."""
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for to in states[state]:
            if to != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, ({"u": "user", "a": "assistant"}[to], ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                _, role, text = rows[i]
                for to in states[state]:
                    if role[:1] == to:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, (role, text))))
                    if to != "s":
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to, (*out, ({"u": "user", "a": "assistant"}[to], text))))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def random_rows(rng, n, turns=None):
    texts = ["Yes.", "no", "", " \n", "What?", "Well!  ", "a. b", "Ü."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", "assist"]
    return [(turns[i] if turns else i, rng.choice(roles), rng.choice(texts) + rng.choice(["", str(rng.randrange(40)) + "."]))
            for i in range(n)]


def solve(rows):
    return C.whole({}, [r for _, r, _ in rows], [t for _, _, t in rows], [n for n, _, _ in rows])


def test_auction_finds_the_cheapest_repair():
    rng = random.Random(13)
    for _ in range(600):
        rows = random_rows(rng, rng.randrange(1, 14))
        found, wanted = solve(rows), brute(rows)
        assert (found["blank"], found["duplicate"], found["truncated"], found["illegal"], found["cost"], found["edits"]) == wanted[1:7]
        lines = "\n".join(f"{m['role']}:{m['text']}" for m in found["messages"])
        assert hashlib.sha256(lines.encode()).hexdigest() == wanted[7]


def test_prices_are_exact_and_feasible():
    rng = random.Random(14)
    for _ in range(200):
        kinds = "".join(rng.choices("suaxSUAX-", k=rng.randrange(1, 30)))
        prices = C.auction(kinds, C.ENDS, True)
        for place, kind in enumerate(kinds):
            for state in range(4):
                here = prices[4 * place + state]
                arcs = [cost + prices[4 * place + 4 + to] for _, cost, to in C.arcs_of(kind)[state]]
                arcs.append(C.INSERT + prices[4 * place + C.WRITES[state]])
                assert here == min(arcs)


def test_costs_of_parts_multiply():
    rng = random.Random(15)
    for _ in range(50):
        parts = ["".join(rng.choices("suaxSUAX-", k=rng.randrange(1, 9))) for _ in range(3)]
        total = C.table(parts[2], True)
        for part in (parts[1], parts[0]):
            total = C.least_sums(total, C.table(part, False))
        assert [total[4 * e] for e in range(4)] == C.auction("".join(parts), C.ENDS, True)[:4]


def results(table):
    out = C.report(table).join(C.digests(table), "conv_key")
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in out.collect()}


@pytest.mark.parametrize("rows, fan", [(256, 512), (7, 2), (1, 3)])
def test_conversations_cut_anywhere(spark, monkeypatch, rows, fan):
    monkeypatch.setattr(C, "FAN", fan)
    rng = random.Random(16)
    data = {c: random_rows(rng, rng.choice([1, 2, 5, 8])) for c in range(40)} | {99: random_rows(rng, 150)}
    table = spark.createDataFrame([(c, *r) for c, rs in data.items() for r in rs], TURNS)
    table = table.withColumns({"part": F.lit("x"), "PRICE": F.lit(1), "edits": F.lit("D")}).repartition(3)
    found = results(C.repair(table, rows=rows))
    assert found == {c: brute(rs) for c, rs in data.items()}


def test_parts_bounded_by_characters(spark):
    rng = random.Random(17)
    rows = [(i, r, t + "x" * 50 + ".") for i, r, t in random_rows(rng, 30)]
    parts = C.repair(spark.createDataFrame([(1, *r) for r in rows], TURNS), chars=200)
    assert parts.count() > 5
    assert results(parts)[1] == brute(rows)


def test_null_repeated_and_no_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (5, 2, "user", "A."), (5, 2, "user", "A."), (5, None, "assistant", "B.")]
    found = results(C.repair(spark.createDataFrame(rows, TURNS)))
    assert found[None] == brute([(None, " ", " "), (1, "user", "Hi.")])
    assert found[5] == brute([(None, "assistant", "B."), (2, "user", "A."), (2, "user", "A.")])
    empty = C.repair(spark.createDataFrame([], TURNS))
    assert empty.count() == 0 and C.report(empty).count() == 0 and C.digests(empty).count() == 0


def test_long_texts_and_equal_turns(spark):
    rows = [(0, "user", "x " * 400_000 + "."), (0, "assistant", "y" * 900_000)]
    found = results(C.repair(spark.createDataFrame([(1, *r) for r in rows], TURNS)))
    assert found[1] == brute(sorted(rows, key=lambda r: r[1]))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role or " ", " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. {t}!") for c in (1, None) for t in [*range(60), None]] + [(7, 1, None, None)]
    found = [tuple(r) for r in damaged(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(found, key=repr) == sorted(damage(rows), key=repr)


def test_query_against_brute_force(spark, engine):
    rows = engine.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    wanted = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    by_conv = {}
    for conv, *row in damage(rows):
        by_conv.setdefault(conv, []).append(tuple(row))
    for conv, own in by_conv.items():
        wanted[conv] = brute(sorted(own, key=lambda r: (r[0] is not None, r[0])))
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = QUERIES["op13_conversation_auction"](spark, FOLDER).collect()
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in found} == wanted and len(found) == len(wanted)
