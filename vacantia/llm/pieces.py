"""Encoding and decoding with a merge-type sentence-piece model, exact, by backtracking.

Merging joins, again and again, the two neighbours whose joined text is the best-scored piece, the
leftmost of equals.  What it ends with is the only row of pieces in which every two neighbours are
compatible, that is, merging the text of the two alone ends with these two: as long as nothing is
joined across a border of the row, each two neighbours evolve as they do alone.  So an encoder may
guess and check:

*Longest matches.*  An Aho-Corasick automaton over the pieces gives the longest piece that begins
at each character; ``shorter`` leads from a piece to the next shorter one that begins it.  Pieces
that merging never makes are left out of both.

*Compatibility.*  Two neighbours are checked by merging both texts again, side by side, in the
order of the merges: they fit unless a merge across their border comes first.  Each piece's own
merges are kept, so only its border piece and its next score are looked at; answers are remembered.

*Failed positions.*  A prefix of the text has one row only, so a position from which no piece goes
on is marked in a bit field and never tried again.

Texts are normalised by the library, then cut where no piece can lie across: before a space mark
that follows something else, if no piece of the model holds one there, around characters that no
piece has, and before a last character that no piece holds behind the one before it.  Distinct cuts are encoded once per worker while they stay in a bounded memory; whole texts
are encoded, of any length.  Characters that no piece has become their bytes' pieces.

Decoding is the library's.  Both are one narrow pass without a shuffle.

Defined cases: a null text is empty and has no ids; repeated rows and null keys come back as often
as they go in; an empty table gives an empty result; other columns are not read, whatever their
names.  Models that are not of merge type, lack byte pieces or hold unused or user-defined pieces
are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import text_of

MARK = "▁"  # stands for a space
REMEMBERED = 700_000  # cuts and pairs a worker remembers, each
LONG = 64  # characters of a cut that is not remembered
NO_MERGE = float("-inf")
BATCH_CHARS = 1_000_000  # of the texts that are held as ids at a time


def merged(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[str, str, float]]]:
    """The pieces that merging makes of a short text, and how: the first and the last piece before
    each merge and its score, then both at the end with no further merge."""
    parts, steps = list(text), []
    while True:
        best, at = None, 0
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            return parts, [*steps, (parts[0], parts[-1], NO_MERGE)]
        steps.append((parts[0], parts[-1], best))
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor
        self.library = library = SentencePieceProcessor(model_file=model)
        numbers = range(library.get_piece_size())
        of_byte = {int(library.id_to_piece(i)[3:5], 16): i for i in numbers if library.is_byte(i)}
        if len(of_byte) < 256 or any(library.is_unused(i) for i in numbers):
            raise ValueError("the model must have a piece for each byte and no unused pieces")
        self.of_byte = [of_byte[b] for b in range(256)]
        ids = {library.id_to_piece(i): i for i in numbers
               if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
        self.scores = {piece: library.get_score(i) for piece, i in ids.items()}
        letters = sorted(set("".join(ids)))
        merges = {p: merged(p, self.scores) for p in [*ids, *(c for c in letters if c not in ids)]}
        self.texts = [p for p, (parts, _) in merges.items() if len(parts) == 1]
        self.steps = [merges[p][1] for p in self.texts]
        self.ids = [(ids[p],) if p in ids else self.bytes_of(p) for p in self.texts]
        self.sizes = [len(p) for p in self.texts]
        self.back = [n - 1 for n in self.sizes]
        token_of = {p: t for t, p in enumerate(self.texts)}
        self.shorter = [next((token_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in token_of), -1)
                        for p in self.texts]
        self.automaton = ahocorasick.Automaton()
        for piece, token in token_of.items():
            self.automaton.add_word(piece, token)
        self.automaton.make_automaton()
        self.side_by_side = {p[i:i + 2] for p in ids for i in range(len(p) - 1)}
        # Borders that no piece lies across.
        strange = re.escape("".join(c for c in map(chr, range(128)) if c not in letters and c != MARK))
        if any(MARK in p.lstrip(MARK) for p in ids):
            self.cut = re.compile(rf"[^{strange}]+|[{strange}]" if strange else r"(?s).+")
        else:
            self.cut = re.compile(rf"{MARK}*[^{MARK}{strange}]+|{MARK}+" + (f"|[{strange}]" if strange else ""))
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def check(self) -> None:
        """Raise an error if the library does not encode the pieces' own texts as merging does."""
        for piece in self.scores:
            text = piece.replace(MARK, " ")
            if self(text) != self.library.encode(text):
                raise ValueError(f"not a merge-type model, or with user-defined pieces: {piece!r}")

    def bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple(self.of_byte[b] for b in char.encode())

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text again ends with these two."""
        pair = left * len(self.texts) + right
        found = self.compatible.get(pair)
        if found is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            found = self.compatible[pair] = self.stay_apart(self.steps[left], self.steps[right])
        return found

    def stay_apart(self, left: list[tuple], right: list[tuple]) -> bool:
        i = j = 0
        scores = self.scores
        while True:
            _, one, before = left[i]
            two, _, behind = right[j]
            across = scores.get(one + two, NO_MERGE)
            # Of equal scores the leftmost merge comes first.
            if across > before and across >= behind and across > NO_MERGE:
                return False
            if before >= behind:
                if before == NO_MERGE:
                    return True
                i += 1
            else:
                j += 1

    def row(self, longest: list[int], begin: int, stop: int) -> list[int]:
        """The tokens of the characters from ``begin`` to ``stop``, all of which some piece has."""
        sizes, shorter, answers, width = self.sizes, self.shorter, self.compatible, len(self.texts)
        failed = None  # a bit for each position, once there is one
        tokens: list[int] = []
        at, token, last = begin, longest[begin], -1
        while at < stop:
            while token >= 0:
                end = at + sizes[token]
                if failed is None or not failed[end - begin >> 3] >> (end - begin & 7) & 1:
                    if last < 0:
                        break
                    answer = answers.get(last * width + token)
                    if self.fits(last, token) if answer is None else answer:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, last = end, token
                token = longest[at]
            else:
                if failed is None:
                    failed = bytearray((stop - begin >> 3) + 1)
                failed[at - begin >> 3] |= 1 << (at - begin & 7)
                token = tokens.pop()
                at -= sizes[token]
                token = shorter[token]
                last = tokens[-1] if tokens else -1
        return tokens

    def encoded(self, cut: str) -> list[int]:
        """The ids of a cut, by backtracking."""
        longest, back, ids = [-1] * (len(cut) + 1), self.back, self.ids
        for end, token in self.automaton.iter(cut):
            longest[end - back[token]] = token  # a later end is a longer piece
        out: list[int] = []
        begin = 0
        while begin < len(cut):
            if longest[begin] < 0:
                out += self.bytes_of(cut[begin])
                begin += 1
                continue
            stop = longest.index(-1, begin)
            for token in self.row(longest, begin, stop):
                out += ids[token]
            begin = stop
        return out

    def learnt(self, cut: str) -> bytes:
        """The ids of a cut that is new, as little-endian 32-bit numbers; a last character that no
        piece holds behind the one before it, such as a comma, is a cut of its own."""
        if 1 < len(cut) <= LONG and cut[-2:] not in self.side_by_side:
            ids = self.remembered(cut[:-1]) + self.remembered(cut[-1])
        else:
            ids = np.array(self.encoded(cut), "<i4").tobytes()
        if len(cut) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[cut] = ids
        return ids

    def remembered(self, cut: str) -> bytes:
        ids = self.known.get(cut)
        return self.learnt(cut) if ids is None else ids

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        cuts = self.cut.findall(self.library.normalize(text))
        parts = list(map(self.known.get, cuts))
        if None in parts:
            parts = [self.remembered(cut) if ids is None else ids for cut, ids in zip(cuts, parts)]
        return b"".join(parts)

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


ENCODERS: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """One encoder per worker; what it remembers serves the worker's later tasks."""
    if model not in ENCODERS:
        ENCODERS[model] = Encoder(model)
    return ENCODERS[model]


def lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def some(batch: pa.RecordBatch, sizes: Iterable[int], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of rows up to ``most`` in size or of one row."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size + 1
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)``, a row for each document."""
    encoder(model).check()

    def run(batches):
        to_ids = encoder(model)
        for whole in batches:
            for batch in some(whole, (len(t.as_py()) for t in whole.column(1)), BATCH_CHARS):
                ids = [to_ids.packed(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids)], names=["key", "ids"])

    texts = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``(key, ids, text)`` of ``(key, ids)``: the texts that the library makes of the ids."""
    def run(batches):
        library = encoder(model).library
        for whole in batches:
            for batch in some(whole, pc.list_value_length(whole.column(1)).to_pylist(), BATCH_CHARS):
                flat = pc.list_flatten(batch.column(1)).to_numpy().tolist()
                ends = np.cumsum([0, *pc.list_value_length(batch.column(1)).to_pylist()]).tolist()
                texts = [library.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                                 names=["key", "ids", "text"])

    rows = encoded.select("key", "ids")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, text string")
