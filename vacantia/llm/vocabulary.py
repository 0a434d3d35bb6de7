"""A minimal acyclic transducer: sorted terms to ordinals and back.

Built in one pass over sorted terms: whatever the next term does not share with the last one is
final, and a finished state equal to a registered one (same arcs, same mark) is replaced by it.  An
arc weighs as many terms as come before the first one through it, so that the weights along a term
add up to its place among all terms, and a place leads back to its term.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

FIELDS = "first_arc binary, labels binary, targets binary, weights binary, finals binary"


class Transducer:
    """States are numbered from the leaves, the root last; arcs lie by state and label."""

    def __init__(self, first_arc: bytes, labels: bytes, targets: bytes, weights: bytes, finals: bytes):
        self.first_arc, self.targets, self.weights = (np.frombuffer(x, "<i4") for x in (first_arc, targets, weights))
        self.labels, self.finals = np.frombuffer(labels, np.uint8), np.frombuffer(finals, np.uint8)
        self.root = len(self.finals) - 1
        self.steps = None

    @staticmethod
    def build(terms: Iterable[bytes]) -> dict[str, bytes]:
        """The fields of the transducer of distinct terms in ascending order."""
        register: dict[tuple, int] = {}
        counts, finals, rows = [], [], []

        def finished(state: list) -> int:
            mark, labels, targets = state
            shape = (mark, bytes(labels), tuple(targets))
            number = register.get(shape)
            if number is None:
                number = register[shape] = len(rows)
                rows.append((labels, targets))
                finals.append(mark)
                counts.append(mark + sum(counts[t] for t in targets))
            return number

        path, last = [[0, [], []]], None
        for term in terms:
            shared = 0
            if last is not None:
                if term <= last:
                    raise ValueError("terms must be distinct and in ascending order")
                most = min(len(term), len(last))
                while shared < most and term[shared] == last[shared]:
                    shared += 1
                while len(path) > shared + 1:
                    number = finished(path.pop())
                    path[-1][1].append(last[len(path) - 1])
                    path[-1][2].append(number)
            path += [[0, [], []] for _ in term[shared:]]
            path[-1][0] = 1
            last = term
        while len(path) > 1:
            number = finished(path.pop())
            path[-1][1].append(last[len(path) - 1])
            path[-1][2].append(number)
        # The root is a state of its own, so that it is the last.
        rows.append((path[0][1], path[0][2]))
        finals.append(path[0][0])
        weights = []
        for (_, targets), mark in zip(rows, finals):
            before = mark
            for target in targets:
                weights.append(before)
                before += counts[target]
        return {
            "first_arc": np.cumsum([0, *(len(targets) for _, targets in rows)]).astype("<i4").tobytes(),
            "labels": b"".join(bytes(labels) for labels, _ in rows),
            "targets": np.array([t for _, targets in rows for t in targets], "<i4").tobytes(),
            "weights": np.array(weights, "<i4").tobytes(), "finals": bytes(finals)}

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The place of each term, -1 for a term that is none; all terms take a step at a time."""
        if self.steps is None:
            # Arc 0 leads nowhere; the dead state lies behind the root.
            self.classes = np.zeros(256, np.int64)
            used = np.unique(self.labels)
            self.classes[used] = np.arange(1, len(used) + 1)
            self.width = len(used) + 1
            self.steps = np.zeros((self.root + 2) * self.width, np.int32)
            arcs = np.arange(len(self.labels), dtype=np.int32)
            owner = np.repeat(np.arange(self.root + 1), np.diff(self.first_arc))
            self.steps[owner * self.width + self.classes[self.labels]] = arcs + 1
            self.to = np.concatenate([[self.root + 1], self.targets]).astype(np.int64)
            self.gain = np.concatenate([[0], self.weights]).astype(np.int64)
            self.accepts = np.append(self.finals, 0).astype(bool)
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        order = np.argsort(-sizes, kind="stable")
        text = self.classes[np.frombuffer(b"".join(terms), np.uint8)]
        starts = (np.cumsum(sizes) - sizes)[order]
        going = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        state, place = np.full(len(terms), self.root), np.zeros(len(terms), np.int64)
        for step, m in enumerate(going.tolist()):
            arc = self.steps[state[:m] * self.width + text[starts[:m] + step]]
            state[:m] = self.to[arc]
            place[:m] += self.gain[arc]
        out = np.empty(len(terms), np.int64)
        out[order] = np.where(self.accepts[state], place, -1)
        return out

    def term(self, ordinal: int) -> bytes:
        """The term at a place."""
        state, out = self.root, bytearray()
        while ordinal or not self.finals[state]:
            lo, hi = self.first_arc[state], self.first_arc[state + 1]
            arc = lo + int(np.searchsorted(self.weights[lo:hi], ordinal, side="right")) - 1
            out.append(self.labels[arc])
            ordinal -= int(self.weights[arc])
            state = self.targets[arc]
        return bytes(out)


