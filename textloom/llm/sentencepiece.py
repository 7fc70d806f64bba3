"""SentencePiece encoding and decoding as a max-plus scan over a model's pieces.

A unigram model's segmentation is the path of greatest total score. A model of
merges joins neighbours by rank instead; its segmentation is the one path on
which every two neighbouring pieces, merged afresh on their own, stay those
two. So there the last piece belongs to the state, and a step to a piece that
does not stay beside it costs minus infinity: again a max-plus problem, whose
ids are those of the library.

A giant document is cut into chunks. A chunk's transfer matrix holds, for every
state to enter and to leave it, the best score between: how far a piece reaches
over the boundary, and for merges which piece that is. Matrices are joined by
the max-plus product, which is associative, so a tree of products gives the
whole, some chunks at a time; going down the tree fixes the state at each
boundary, and each chunk is then traced back on its own.

Scores are whole numbers: the model's, finely rounded, and for unigram models
below them a hash of the piece times its place in its word, which settles ties
between other pieces or another order. So the best path is the same however a
document is cut.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import keyed_text, slices, stash

BLANK = "▁"
#: Characters of a text beyond which it is cut, and of a chunk.
GIANT, CHUNK = 100_000, 32_768
MEMO_WORDS, MEMO_LENGTH = 500_000, 64
#: Chunks, or products of chunks, that one task joins.
FAN = 16
#: Pairs of pieces that a worker remembers before it starts anew.
MEMO_PAIRS = 2_000_000
#: Steps to one of a score, and bits of the tie below it.
STEPS, TIE = 1 << 20, 96
#: A character that no piece has costs this much more than the worst piece. Fixed value of the format.
UNKNOWN_COST = 10.0
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: The type of a model that joins neighbours by rank. Fixed value of the format.
BY_MERGES = 2
NONE = -(1 << 200)

Matrix = list[list[int]]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces of a .model file with identity normalisation and byte fallback, read as a unigram model."""

    #: Characters before a chunk that are needed to tell its states.
    lead = 0

    def __init__(self, message: list[tuple[int, int | bytes]]) -> None:
        self.dummy, squeeze, charsmap = True, True, b""
        for number, value in message:
            if number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy = bool(v)
                    elif n == 4:
                        squeeze = bool(v)
        if charsmap or squeeze:
            raise ValueError("only models that leave the text as it is can be decoded to the same text")
        scores: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.out: list[bytes] = []
        for number, value in message:
            if number != 1:
                continue
            fields = dict(_fields(value))
            piece, kind = fields[1].decode(), fields.get(3, NORMAL)
            score = struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0
            k = len(self.out)
            if kind == NORMAL:
                scores[piece] = (score, k)
                self.out.append(piece.replace(BLANK, " ").encode())
            elif kind == BYTE:
                b = int(piece[1:-1], 16)
                self.byte_ids[b] = k
                self.out.append(bytes([b]))
            else:
                self.out.append(b"")
        worst = min(s for s, _ in scores.values())
        self.unknown = self._whole(worst - UNKNOWN_COST, -1)
        self.pieces = {p: (*self._whole(s, k), k) for p, (s, k) in scores.items()}
        self.longest = max(map(len, self.pieces))
        #: The pieces as a tree of characters: (children, score, hash, id), id -1 where no piece ends.
        self.root: tuple = ({}, 0, 0, -1)
        for p in sorted(self.pieces, key=len):
            node = self.root
            for c in p[:-1]:
                node = node[0].setdefault(c, ({}, 0, 0, -1))
            node[0][p[-1]] = (node[0].get(p[-1], ({},))[0], *self.pieces[p])
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        #: No piece goes on over the start of a blank run or over a line end: a text falls apart there.
        self.parts = not any((b == BLANK and a != BLANK) or "\n" in (a, b) for a, b in pairs)
        self.memo: dict[str, tuple[bytes, int]] = {}

    @staticmethod
    def _whole(score: float, k: int) -> tuple[int, int]:
        """A score in steps above the bits of the tie, and the piece's hash."""
        return round(score * STEPS) << TIE, int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=4).digest(), "big")

    def places(self, s: str, offset: int) -> list[int]:
        """For each place of s, how far it is from the start of its word; s itself starts `offset` into one."""
        out, start = [], -offset
        starts = {m.start() for m in _word.finditer(s)} if self.parts else set()
        for i in range(len(s)):
            if i in starts and (i or not offset):
                start = i
            out.append(i - start)
        return out

    def ending(self, s: str, j: int, least: int, rel: list[int] | range) -> Iterator[tuple[int, int, int]]:
        """(start, score, id) of each piece of s that ends at j and starts at least or later; id -1: a character that no piece has."""
        single = False
        for i in range(j - 1, max(least, j - self.longest) - 1, -1):
            found = self.pieces.get(s[i:j])
            if found:
                single |= i == j - 1
                yield i, found[0] + found[1] * (1 + rel[i]), found[2]
        if not single and j - 1 >= least:
            yield j - 1, self.unknown[0] + self.unknown[1] * (1 + rel[j - 1]), -1

    def best(self, s: str, start: int, ends: int, rel: list[int] | range) -> tuple[list[int], list[int], list[int]]:
        """From start to each place up to ends: the best score, where its last piece starts, and that piece."""
        score, back, last = [NONE] * (ends + 1), [-1] * (ends + 1), [-1] * (ends + 1)
        score[start] = 0
        for j in range(start + 1, ends + 1):
            top = NONE
            for i, own, k in self.ending(s, j, start, rel):
                if score[i] > NONE and score[i] + own > top:
                    top, back[j], last[j] = score[i] + own, i, k
            score[j] = top
        return score, back, last

    def _ids(self, s: str, back: list[int], last: list[int], start: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            i, k = back[end], last[end]
            out.append([k] if k >= 0 else [self.byte_ids[b] for b in s[i:end].encode("utf-8", "surrogatepass")])
            end = i
        return [k for own in reversed(out) for k in own]

    def segment(self, s: str) -> tuple[bytes, int]:
        """Ids (as bytes of 32-bit numbers) and score of one word in which blanks are already marks."""
        n, root, unknown, tie = len(s), self.root, *self.unknown
        score, back, last = [NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0
        for i in range(n):
            had, place, node = score[i], i + 1, root
            single = False
            for j in range(i, n):
                node = node[0].get(s[j])
                if node is None:
                    break
                if node[3] >= 0:
                    single |= j == i
                    new = had + node[1] + node[2] * place
                    if new > score[j + 1]:
                        score[j + 1], back[j + 1], last[j + 1] = new, i, node[3]
            if not single:
                new = had + unknown + tie * place
                if new > score[place]:
                    score[place], back[place], last[place] = new, i, -1
        return array("i", self._ids(s, back, last, 0, n)).tobytes(), score[n]

    def marked(self, text: str) -> str:
        """The text as the model sees it."""
        return (BLANK if self.dummy and text else "") + text.replace(" ", BLANK)

    def words(self, s: str) -> list[str]:
        """The parts of a marked text over whose borders no piece goes."""
        return _word.findall(s) if self.parts else [s]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of a text."""
        memo, ids, total = self.memo, [], 0
        for w in self.words(self.marked(text)):
            own = memo.get(w)
            if own is None:
                own = self.segment(w)
                if len(w) <= MEMO_LENGTH:
                    if len(memo) > MEMO_WORDS:
                        memo.clear()
                    memo[w] = own
            ids.append(own[0])
            total += own[1]
        return np.frombuffer(b"".join(ids), "<i4"), as_score(total)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that are no character become U+FFFD."""
        out = self.out
        data = b"".join([out[k] for k in ids])
        return (data[1:] if self.dummy and data[:1] == b" " else data).decode("utf-8", "replace")

    def transfer(self, s: str, lead: int, size: int, offset: int, final: bool) -> Matrix:
        """Best scores of a chunk (s: `lead` characters before it, its `size` characters, then those after it that a piece may still take) for each entry and exit. offset: how far into a word it starts; final: it has only the exit 0."""
        states, cut, rel = self.longest, self._cuts(s, size), self.places(s, offset)
        exits = 1 if final else states
        if cut is None:
            return [self._leave(s, self._from(s, a, size, rel), size, exits, rel) for a in range(states)]
        first, last = cut
        middle = sum(self.encode_part(w)[1] for w in self.words(s[first:last]))
        tail, place = s[last:], rel[last:]
        after = self._leave(tail, self._from(tail, 0, size - last, place), size - last, exits, place)
        out = []
        for a in range(states):
            head = self.best(s, a, first, rel)[0][first]
            out.append([NONE if head == NONE or x == NONE else head + middle + x for x in after])
        return out

    def encode_part(self, w: str) -> tuple[bytes, int]:
        own = self.memo.get(w)
        return own if own is not None else self.segment(w)

    def _cuts(self, s: str, size: int) -> tuple[int, int] | None:
        """The first and last border of words that every path meets, the first where all entries have begun."""
        if not self.parts or size <= self.longest:
            return None
        at = [m.start() for m in _word.finditer(s) if self.longest <= m.start() <= size]
        return (at[0], at[-1]) if at else None

    def _from(self, s: str, start: int, size: int, rel: list[int]) -> list[int]:
        if start > size:
            return [NONE] * (len(s) + 1)
        return self.best(s, start, size, rel)[0] + [NONE] * (len(s) - size)

    def _leave(self, s: str, score: list[int], size: int, exits: int, rel: list[int]) -> list[int]:
        """Best score of each exit b: the last piece starts before `size` and ends b characters beyond it."""
        out = []
        for b in range(exits):
            j, top = size + b, NONE
            if b == 0:
                top = score[size]
            elif j <= len(s):
                for i, own, _ in self.ending(s, j, 0, rel):
                    if i < size and score[i] > NONE:
                        top = max(top, score[i] + own)
            out.append(top)
        return out

    def trace(self, s: str, lead: int, size: int, offset: int, final: bool, enter: int, leave: int) -> list[int]:
        """The chunk's ids on the best path between two boundary states."""
        rel = self.places(s, offset)
        score, back, last = self.best(s, enter, size, rel)
        if not leave:
            return self._ids(s, back, last, enter, size)
        j = size + leave
        i, k = max(((score[i] + own, i, k) for i, own, k in self.ending(s, j, 0, rel) if i < size and score[i] > NONE))[1:]
        tail = [k] if k >= 0 else [self.byte_ids[b] for b in s[i:j].encode("utf-8", "surrogatepass")]
        return self._ids(s, back, last, enter, i) + tail


class Merges(Model):
    """The pieces of a .model file that joins neighbours by rank.

    A state at a boundary is the piece that holds the character before it, as
    (start, end, id) in the chunk's characters; id -1: a character that no
    piece has. The only state before the first chunk is its start, the only
    one after the last its end.
    """

    def __init__(self, message: list[tuple[int, int | bytes]]) -> None:
        super().__init__(message)
        self.lead = self.longest
        self.text = {k: p for p, (*_, k) in self.pieces.items()}
        self.score = {p: x >> TIE for p, (x, *_) in self.pieces.items()}
        self.by_id = {k: x >> TIE for p, (x, _, k) in self.pieces.items()} | {-1: self.unknown[0] >> TIE}
        #: For each piece what is known of those that follow it, and how many answers there are.
        self.followers: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.histories: dict[int, tuple[list[float], list[str], list[str]]] = {}

    def history(self, k: int) -> tuple[list[float], list[str], list[str]]:
        """How a piece comes about from its characters: before each merge and after the last, that merge's score (none: minus infinity), the first and the last part.

        The neighbours that form the best piece are joined, the first of equal ones, as long as there are any.
        """
        own = self.histories.get(k)
        if own is None:
            parts, own = list(self.text[k]), ([], [], [])
            while True:
                found = [(self.score[x], -i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in self.score]
                best = max(found, default=(float("-inf"), 0))
                for row, x in zip(own, (best[0], parts[0], parts[-1]), strict=True):
                    row.append(x)
                if not found:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.histories[k] = own
        return own

    def stay(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a (-1: nothing that merges): the characters of both, merged afresh, become those two.

        Both come about side by side, the better merge first, unless a merge over the border is due before.
        """
        scores_b, first, _ = self.history(b)
        if first[-1] != self.text[b]:
            return False
        if a < 0:
            return True
        scores_a, _, last = self.history(a)
        i = j = 0
        while True:
            over, x, y = self.score.get(last[i] + first[j]), scores_a[i], scores_b[j]
            if over is not None and over > x and over >= y:
                return False
            if x == y == float("-inf"):
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def after(self, last: int) -> dict[int, bool]:
        """What is known of the pieces that follow `last`."""
        if self.known > MEMO_PAIRS:
            self.followers.clear()
            self.known = 0
        return self.followers.setdefault(last, {})

    def walk(self, s: str, start: int, last: int, end: int, like: list[int] | None = None) -> tuple[list[int], list[int], int]:
        """From a place and the piece before it to all places up to end: the last piece of each (-2: not met; -1: a character that no piece has), its start, and where the walk stopped.

        It stops before end where the last pieces have been those of ``like``
        at as many places as a piece can be long: from there on they are the same.
        """
        n, root, stay = max(end, start) + 1, self.root, self.stay
        ends, back = [-2] * n, [0] * n
        ends[start], same = last, 0
        for i in range(start, end):
            now = ends[i]
            if like is not None:
                same = same + 1 if now == like[i] else 0
                if same > self.longest:
                    return ends, back, i
            if now == -2:
                continue
            known = self.followers.get(now)
            if known is None:
                known = self.after(now)
            node, single = root, False
            for j in range(i + 1, n):
                node = node[0].get(s[j - 1])
                if node is None:
                    break
                k = node[3]
                if k >= 0:
                    single = single or j == i + 1
                    good = known.get(k)
                    if good is None:
                        good = known[k] = stay(now, k)
                        self.known += 1
                    if good:
                        ends[j], back[j] = k, i
            if not single:
                ends[i + 1], back[i + 1] = -1, i
        return ends, back, end

    def total(self, ends: list[int], back: list[int], start: int, at: int) -> int:
        """The score of the pieces from start to a place that was met."""
        found = 0
        while at > start:
            found += self.by_id[ends[at]]
            at = back[at]
        return found

    def segment(self, s: str) -> tuple[bytes, int]:
        """Ids (as bytes of 32-bit numbers) and score of one word in which blanks are already marks."""
        ends, back, at = self.walk(s, 0, -1, len(s))
        ids, score = array("i"), 0
        while at > 0:
            k, start = ends[at], back[at]
            score += self.by_id[k]
            if k >= 0:
                ids.append(k)
            else:
                ids.extend([self.byte_ids[b] for b in reversed(s[start:at].encode("utf-8", "surrogatepass"))])
            at = start
        ids.reverse()
        return ids.tobytes(), score << TIE

    def states(self, s: str, at: int) -> list[tuple[int, int, int]]:
        """The states of a boundary of s."""
        if at in (0, len(s)):
            return [(at, at, -1)]
        out = []
        for i in range(max(0, at - self.longest), at):
            node = self.root
            for j in range(i, len(s)):
                node = node[0].get(s[j])
                if node is None:
                    break
                if node[3] >= 0 and j + 1 >= at and self.stay(-1, node[3]):
                    out.append((i, j + 1, node[3]))
        return out if s[at - 1] in self.root[0] and self.root[0][s[at - 1]][3] >= 0 else [*out, (at - 1, at, -1)]

    def transfer(self, s: str, lead: int, size: int, offset: int, final: bool) -> Matrix:
        border = lead + size
        exits, out, first = self.states(s, border), [], None
        for _, start, last in self.states(s, lead):
            ends, back, stop = self.walk(s, start, last, border, first and first[0])
            if first is not None and stop < border:  # goes on as the first did
                ahead = NONE if ends[stop] == -2 else self.total(ends, back, start, stop) - self.total(*first, stop) << TIE
                out.append([NONE if NONE in (x, ahead) else x + ahead for x in out[0]])
                continue
            row = []
            for i, _, k in exits:
                if final or start > i:
                    held = final and ends[border] != -2
                else:
                    held = ends[i] != -2 and (k < 0 or self.stay(ends[i], k))
                row.append(self.total(ends, back, start, i) + (0 if final else self.by_id[k]) << TIE if held else NONE)
            out.append(row)
            first = first or (ends, back, start)
        return out

    def trace(self, s: str, lead: int, size: int, offset: int, final: bool, enter: int, leave: int) -> list[int]:
        border = lead + size
        _, start, last = self.states(s, lead)[enter]
        ends, back, _ = self.walk(s, start, last, border)
        i, j, k = self.states(s, border)[leave]
        own = self._ids(s, back, ends, start, i)
        if final:
            return own
        return own + ([k] if k >= 0 else [self.byte_ids[b] for b in s[i:j].encode("utf-8", "surrogatepass")])


_word = re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
_models: dict[str, Model] = {}


def read(path: str) -> Model:
    """The model of a file, of the class that its type asks for."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    kind = next((v for number, value in message if number == 2 for n, v in _fields(value) if n == 3), 1)
    return (Merges if kind == BY_MERGES else Model)(message)


def model(path: str) -> Model:
    """The model of this Python worker for a file."""
    if path not in _models:
        _models[path] = read(path)
    return _models[path]


def as_score(total: int) -> float:
    """The model's score of a whole-number total."""
    return (total >> TIE) / STEPS


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: from each entry of a to each exit of b by the best state between."""
    columns = list(zip(*b, strict=True))
    return [[max((x + y for x, y in zip(row, col, strict=False) if x > NONE and y > NONE), default=NONE) for col in columns] for row in a]


def boundary_states(matrices: list[Matrix], enter: int = 0, leave: int = 0) -> list[int]:
    """The best path's states before, between and after some matrices, between a given first and last one; ties: the least."""
    rows = [[(x, -1) for x in matrices[0][enter]]]
    for m in matrices[1:]:
        had = rows[-1]
        rows.append([max(((had[s][0] + m[s][b], -s) for s in range(len(m)) if had[s][0] > NONE and m[s][b] > NONE), default=(NONE, 0)) for b in range(len(m[0]))])
    at = [leave]
    for row in reversed(rows[1:]):
        at.append(-row[at[-1]][1])
    return [enter, *reversed(at)]


def chunks(own: Model, s: str, size: int = CHUNK) -> list[tuple[str, int, int, int]]:
    """(characters with those before and after them that its states need, how many are before, own length, how far into a word it starts) of each chunk; none is shorter than a piece."""
    count = max(1, len(s) // max(size, own.longest + 1))
    cuts = [len(s) * k // count for k in range(count + 1)]
    starts = [m.start() for m in _word.finditer(s)] if own.parts else [0]
    into = [c - starts[bisect_right(starts, c) - 1] if starts else 0 for c in cuts]
    return [(s[max(0, a - own.lead) : b + own.longest - 1], min(a, own.lead), b - a, k) for a, b, k in zip(cuts, cuts[1:], into, strict=False)]


RESULT = "ids array<int>, n_tokens long, score double, round_trip boolean"


def _result(ids: list, kinds: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kinds), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "ids", "n_tokens", "score", "round_trip"]
    )


PARENT = f"k div {FAN}"
MATRIX = pa.list_(pa.list_(pa.string()))


def _written(m: Matrix) -> list[list[str]]:
    """A matrix as text, as its whole numbers have more than 64 bits."""
    return [list(map(str, row)) for row in m]


def _matrices(rows: pa.Table) -> list[Matrix]:
    return [[list(map(int, row)) for row in m] for m in rows["matrix"].to_pylist()]


def _joined(key: tuple, rows: pa.Table) -> pa.Table:
    """The product of at most FAN neighbouring matrices."""
    return pa.table({"mark": pa.array([key[0].as_py()], pa.binary()), "k": pa.array([key[1].as_py()], pa.int64()), "matrix": pa.array([_written(reduce(product, _matrices(rows.sort_by("k"))))], MATRIX)})


def _parted(key: tuple, rows: pa.Table) -> pa.Table:
    """The states around each of at most FAN matrices between those around their product."""
    order = rows.sort_by("k")
    at = boundary_states(_matrices(order), order["enter"][0].as_py(), order["leave"][0].as_py())
    return pa.table({"mark": order["mark"], "k": order["k"], "enter": pa.array(at[:-1], pa.int32()), "leave": pa.array(at[1:], pa.int32()), "total": order["total"]})


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, ids, n_tokens, score, round_trip), one per input row.

    score: the total of the pieces' scores. round_trip: the ids decode to the
    text itself (false only if it holds the blank mark U+2581). A null text
    counts as empty: no ids. Repeated giant texts are worked out once.
    Repeated rows and null ids are kept; extra columns are left out; an empty
    table gives no rows.

    Texts of up to `giant` characters are encoded where they are read; longer
    ones go in chunks of about `chunk` to all tasks, and at most FAN matrices
    of them meet in one.
    """
    keyed = keyed_text(docs, doc_id, text)
    id_field = keyed.schema["doc_id"].dataType.simpleString()
    long_text = F.length("text") > giant

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for t in piece.column(1).to_pylist():
                    ids, score = own.encode(t or "")
                    rows.append((ids, len(ids), score, own.decode(ids.tolist()) == (t or "")))
                yield _result(piece.column(0), piece.schema.field(0).type, rows)

    small = keyed.filter(~F.coalesce(long_text, F.lit(False))).mapInArrow(direct, f"doc_id {id_field}, {RESULT}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = model(path), set()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                mark = hashlib.sha256(t.encode()).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                parts = chunks(own, own.marked(t), chunk)
                for k, (s, lead, n, into) in enumerate(parts):
                    numbers = (pa.array([x], pa.int64()) for x in (k, len(parts), lead, n, into))
                    yield pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([s]), *numbers], ["mark", "s", "k", "of", "lead", "size", "into"])

    pieces = stash(keyed.filter(long_text).select("text").mapInArrow(cut, "mark binary, s string, k long, of long, lead long, size long, into long").repartition("mark", "k").dropDuplicates(["mark", "k"]), "chunks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            rows = [_written(own.transfer(s, lead, n, into, k == of - 1)) for s, k, of, lead, n, into in zip(*(batch.column(c).to_pylist() for c in range(1, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, MATRIX)], ["mark", "k", "matrix"])

    levels = [stash(pieces.mapInArrow(measure, "mark binary, k long, matrix array<array<string>>"), "transfers")]
    most = pieces.agg(F.max("of")).first()[0] or 1
    while most > 1:
        levels.append(stash(levels[-1].withColumn("group", F.expr(PARENT)).groupBy("mark", "group").applyInArrow(_joined, "mark binary, k long, matrix array<array<string>>"), "transfers"))
        most = -(-most // FAN)
    ways = levels[-1].select("mark", "k", F.lit(0).alias("enter"), F.lit(0).alias("leave"), F.col("matrix")[0][0].alias("total"))
    for level in reversed(levels[:-1]):
        above = ways.select("mark", F.col("k").alias("group"), "enter", "leave", "total")
        ways = level.withColumn("group", F.expr(PARENT)).join(above, ["mark", "group"]).groupBy("mark", "group").applyInArrow(_parted, "mark binary, k long, enter int, leave int, total string")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            ids = [own.trace(s, lead, n, into, k == of - 1, a, b) for s, k, of, lead, n, into, a, b in zip(*(batch.column(c).to_pylist() for c in range(1, 9)), strict=True)]
            score = pa.array([as_score(int(x)) for x in batch.column(9).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), score, pa.array(ids, pa.list_(pa.int32()))], ["mark", "k", "score", "ids"])

    traced = pieces.join(ways, ["mark", "k"]).select("mark", "s", "k", "of", "lead", "size", "into", "enter", "leave", "total").mapInArrow(trace, "mark binary, k long, score double, ids array<int>")
    whole = traced.groupBy("mark").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("ids"), F.first("score").alias("score"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            good = [hashlib.sha256(own.decode(ids).encode()).digest() == mark for mark, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], ["mark", "ids", "score", "round_trip"])

    checked = whole.mapInArrow(check, "mark binary, ids array<int>, score double, round_trip boolean")
    large = keyed.filter(long_text).select("doc_id", F.unhex(F.sha2("text", 256)).alias("mark")).join(checked, "mark").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "score", "round_trip")
    return small.unionByName(large)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text of its ids; null ids give a null text, an unknown id is an error. One pass, no shuffle."""
    from textloom.llm.common import extended

    kept = encoded.drop(out)
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for piece in slices(batch):
                texts = [None if x is None else own.decode(x) for x in piece.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, out])

    return kept.mapInArrow(run, extended(kept.schema, **{out: "string"}))
