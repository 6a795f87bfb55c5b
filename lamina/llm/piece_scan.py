"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The vocabulary is a BPE model, whose encoding is no best-scoring path in the
usual sense.  It is one in this lattice: nodes are pieces at places of the text,
an edge joins neighbours that stay apart when the two are merged on their own
(weight 0; else minus infinity).  A sequence of pieces is the model's encoding
if and only if each neighbouring pair is such an edge, so exactly one path from
the text's start to its end has weight 0.

A state at a boundary is the piece that covers the character before it.  Texts
longer than a chunk become rows of their own: each chunk yields the max-plus
matrix from entry states to exit states; a document's matrices are combined
associatively, forward from its start and backward from its end, which leaves
one state at each boundary; then each chunk is traced back on its own.

No piece spans a safe cut, between two characters that no piece holds side by
side, so there a matrix has one row; words and segments between safe cuts are
solved by the same lattice, those of a block together (``solve``), and remembered.

Edge cases: null and empty texts have no pieces; rows with null or equal ids are
encoded each; U+2581 in a text is the space mark, so it decodes to a space.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from .common import BLOCK_BYTES, materialize, release, text_blocks

CHUNK_CHARS = 32768
SPACE = "▁"
#: A word with all spaces before it, or the spaces at the end.
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: What a task remembers, in two generations of half as many: some 200 bytes each.
CACHED_WORDS, CACHED_CHARS = 440_000, 40
CACHED_PAIRS = 100_000
#: Segments solved together, and how many are worth it.
SOLVED_UNITS, SOLVED_LEAST = 32_768, 64
#: Slots of a worker's table of edges (8 bytes each), at most half of them in use.
EDGE_SLOTS = 1 << 20
#: Characters on both sides of a chunk: two of the longest pieces fit.
CONTEXT = 64


def fields(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message: number -> values (whole numbers, or bytes)."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def check_model(proto: bytes) -> None:
    """Raise for a model whose encoding this lattice does not give.

    It must be a BPE model with byte fallback, identity normalisation, white
    space kept as it is, a leading space mark, and no user-defined pieces.
    """
    # Field numbers of the public model format.
    model, trainer_no, normalizer_no = fields(proto), 2, 3
    trainer, normalizer = fields(model.get(trainer_no, [b""])[0]), fields(model.get(normalizer_no, [b""])[0])
    kinds = {fields(p).get(3, [1])[0] for p in model.get(1, [])}
    wrong = [
        why
        for why, bad in (
            ("its type is not BPE", trainer.get(3, [1])[0] != 2), ("it has no byte fallback", not trainer.get(35, [0])[0]), ("it normalises text", bool(normalizer.get(2, [b""])[0])),
            ("it adds no space mark in front", not normalizer.get(3, [1])[0]), ("it drops white space", bool(normalizer.get(4, [1])[0])), ("it does not mark spaces", not normalizer.get(5, [1])[0]),
            ("it puts space marks behind words", bool(trainer.get(24, [0])[0])), ("it has user-defined pieces", 4 in kinds),
        )
        if bad
    ]
    if wrong:
        raise ValueError("this model cannot be encoded by a scan: " + ", ".join(wrong))


class Trie:
    """Pieces by their first characters as arrays: from node v, character class c leads to base[v] + c if check says v there."""

    def __init__(self, pieces: list[str]):
        self.classes = np.zeros(0x110000, np.uint16)  # 0: in no piece
        chars = sorted({c for p in pieces for c in p})
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: k for k, c in enumerate(chars, 1)}
        tree: dict = {}
        for k, p in enumerate(pieces):
            node = tree
            for c in p:
                node = node.setdefault(number[c], {})
            node[0] = k
        room = len(chars) + 2
        taken, top, free, wide, level = bytearray(4 * room), 0, 1, 1, [(0, tree)]
        taken[0] = 1
        found: list[tuple] = []  # node, base, piece, node above
        above = {0: -1}
        while level:
            below = []
            for at, node in sorted(level, key=lambda x: -len(x[1])):
                k = node.pop(0, -1)
                if not node:
                    found.append((at, 0, k, above[at]))
                    continue
                if len(taken) < top + 3 * room:
                    taken.extend(bytes(len(taken)))
                least, tries = min(node), 0
                if len(node) == 1:  # any free slot will do
                    free = taken.find(0, free)
                    first = taken.find(0, max(free, least))
                else:
                    first = taken.find(0, max(wide, least))
                    while any([taken[first - least + c] for c in node]):
                        first, tries = taken.find(0, first + 1), tries + 1
                    wide = first if tries > 4 else wide
                found.append((at, first - least, k, above[at]))
                for c, child in node.items():
                    slot = first - least + c
                    taken[slot], above[slot], top = 1, at, max(top, slot)
                    below.append((slot, child))
            level = below
        rows = np.array(found, np.int32)
        self.base, self.check, self.piece = np.zeros(top + room, np.int32), np.full(top + room, -1, np.int32), np.full(top + room, -1, np.int32)
        self.base[rows[:, 0]], self.piece[rows[:, 0]], self.check[rows[:, 0]] = rows[:, 1], rows[:, 2], rows[:, 3]


class Edges:
    """Which pairs of pieces (numbers) the lattice joins: a table by hash, the same size for any text."""

    def __init__(self, holds):
        self.holds, self.slots = holds, np.full(EDGE_SLOTS, -1, np.int64)  # twice the key, and whether it is an edge
        self.used, self.shift = 0, np.uint64(64 - (EDGE_SLOTS.bit_length() - 1))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """1, 0, or -1 where a pair is not known."""
        at = self.slot(keys)
        found = self.slots[at]
        out = np.where(found < 0, np.int64(-1), found & 1)
        other = np.flatnonzero((found >= 0) & (found >> 1 != keys))
        at = at[other]
        while len(other):
            at = (at + 1) & (EDGE_SLOTS - 1)
            found = self.slots[at]
            out[other] = np.where(found < 0, -1, found & 1)
            on = np.flatnonzero((found >= 0) & (found >> 1 != keys[other]))
            other, at = other[on], at[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if self.used + len(keys) > EDGE_SLOTS // 2:
            self.slots[:], self.used = -1, 0
            keys, values = keys[: EDGE_SLOTS // 2], values[: EDGE_SLOTS // 2]
        self.used += len(keys)
        entries, at = keys * 2 + values, self.slot(keys)
        while len(entries):
            empty = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[empty]] = entries[empty]
            on = np.flatnonzero(self.slots[at] != entries)  # of several for one slot, one is in
            entries, at = entries[on], (at[on] + 1) & (EDGE_SLOTS - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        got = self.look(keys)
        unknown = np.flatnonzero(got < 0)
        if len(unknown):
            new, where = np.unique(keys[unknown], return_inverse=True)
            values = np.array([self.holds(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int64)
            got[unknown] = values[where]
            self.add(new, values)
        return got == 1


class Pieces:
    """A BPE piece vocabulary and its lattice."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(model.serialized_model_proto())
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in normal}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        if 2 * self.longest > CONTEXT:
            raise ValueError(f"pieces of {self.longest} characters need more than {CONTEXT} on both sides of a chunk")
        self.bytes_of = [b""] * n
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        self.byte_id = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
        # Two characters that no piece holds side by side are a safe cut.
        self.joints = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.spaced = not any(j[1] == SPACE != j[0] for j in self.joints)  # a space after a word is a safe cut
        self.tail: dict = {}  # pieces by their last characters, from the end
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}  # by what follows their first space mark
        self.older_pairs, self.older_words = {}, {}  # the generation before
        self.whole = {p for p in self.id_of if len(p) == 1 or self.merge(p) == [p]}
        for p in self.whole:
            node = self.tail
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        # Numbered for ``solve``: whole pieces, characters that pieces hold but that are none, and last any other character.
        self.named = [*sorted(self.whole), *sorted({c for p in self.whole for c in p} - self.whole)]
        self.trie, named = Trie(self.named), self.named
        self.edges = Edges(lambda a, b: self.merge(named[a] + named[b]) == [named[a], named[b]])
        self.lengths = np.array([*map(len, named), 1], np.int32)
        self.numbers = np.array([self.id_of.get(p, -1) for p in [*named, ""]], np.int32)

    def forget(self) -> None:
        """No text is remembered from one task to the next (edges are, in a small table): idle workers share the executor's memory with what follows."""
        for held in (self.pairs, self.words, self.older_pairs, self.older_words):
            held.clear()
        release()

    def merge(self, text: str) -> list[str]:
        """Neighbours merged by the best score, leftmost first: the model's definition, for short strings."""
        parts, score, none = list(text), self.score.get, -np.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def edge(self, left: str, right: str) -> bool:
        """Whether the lattice joins two neighbouring pieces."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS // 2:
                self.older_pairs, self.pairs = self.pairs, {}
            found = self.older_pairs.get(key)
            if found is None:
                found = self.merge(left + right) == [left, right]
            self.pairs[key] = found
        return found

    def ending(self, text: str, j: int, least: int = 0) -> list[str]:
        """Pieces of the text that end at j and start at ``least`` or later, short ones first; an unknown character is one."""
        node, out, i = self.tail, [], j
        while i > least:
            node = node.get(text[i - 1])
            if node is None:
                break
            i -= 1
            if "" in node:
                out.append(node[""])
        return out or [text[j - 1]]

    def walk(self, text: str, start: int, first: str | None, stop: int) -> dict[int, str]:
        """Last pieces at each end of the one path, up to ``stop``, that begins at ``start``.

        ``first``: the piece before ``start`` (None: nothing, or a safe cut).
        """
        last: dict[int, str | None] = {start: first}
        tail, pairs, edge = self.tail, self.pairs, self.edge
        for j in range(start + 1, stop + 1):
            # At most one piece that ends here continues a path, so the first found will do.
            node, i = tail, j
            while i > start:
                node = node.get(text[i - 1])
                if node is None:
                    break
                i -= 1
                p = node.get("")
                if p is not None and i in last:
                    before = last[i]
                    if before is None or (pairs[before, p] if (before, p) in pairs else edge(before, p)):
                        last[j] = p
                        break
            if text[j - 1] not in tail and j - 1 in last:  # an unknown character stands alone
                last[j] = text[j - 1]
        return last

    def trace(self, last: dict, start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id_of.get(p)
            out += [i] if i is not None else [self.byte_id[b] for b in p.encode()]
        return out

    def path(self, text: str, start: int, end: int, first: str | None) -> bytes:
        return np.array(self.ids(self.trace(self.walk(text, start, first, end), start, end)), "<i4").tobytes()

    def solve(self, units: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of segments (not empty) between safe cuts, by one walk over the lattices of all.

        Row j of ``last`` holds the last piece of each segment's one path to its place j.
        """
        if len(units) < SOLVED_LEAST:
            return [self.path(u, 0, len(u), None) for u in units]
        sizes = np.array([len(u) for u in units])
        order = np.argsort(-sizes, kind="stable")
        sizes, high, many = sizes[order], int(sizes.max()), len(units)
        points = np.frombuffer("".join([units[i] for i in order.tolist()]).encode("utf-32-le"), "<u4")
        of = np.repeat(np.arange(many), sizes)
        place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chars = np.zeros((high + 1, many), np.uint16)
        chars[place, of] = self.trie.classes[points]
        longer = np.searchsorted(-sizes, -np.arange(high), side="left").tolist()  # how many have a character at j
        base, check, piece, other = self.trie.base, self.trie.check, self.trie.piece, len(self.named)
        last = np.full((high + 1, many), -1, np.int32)
        for j in range(high):
            at = np.arange(many) if j == 0 else np.flatnonzero(last[j, : longer[j]] >= 0)
            before, node = last[j, at], np.zeros(len(at), np.int32)
            last[j + 1, at[chars[j, at] == 0]] = other  # an unknown character stands alone
            for k in range(j, min(high, j + self.longest)):
                to = base[node] + chars[k, at]
                on = np.flatnonzero(check[to] == node)
                at, node, before = at[on], to[on], before[on]
                if not len(at):
                    break
                # At most one piece that ends here continues a path, so the first found will do.
                found = np.flatnonzero((piece[node] >= 0) & (last[k + 1, at] < 0))
                left, right, ends = before[found], piece[node[found]], at[found]
                good = (left < 0) | (left == other)
                ask = np.flatnonzero(~good)
                good[ask] = self.edges(left[ask], right[ask])
                last[k + 1, ends[good]] = right[good]
        taken = np.full((many, high), -1, np.int32)
        at, end = np.arange(many), sizes.copy()
        while len(at):
            p = last[end, at]
            end = end - self.lengths[p]
            taken[at, end] = p
            on = np.flatnonzero(end > 0)
            at, end = at[on], end[on]
        used = taken >= 0
        pieces, of, place = taken[used], *np.nonzero(used)
        ids, counts = self.numbers[pieces], np.ones(len(pieces), np.int64)
        spelled = np.flatnonzero(ids < 0)  # characters given by their bytes
        if len(spelled):
            codes, which = np.unique(points[(np.cumsum(sizes) - sizes)[of[spelled]] + place[spelled]], return_inverse=True)
            spellings = [self.ids([chr(c)]) for c in codes.tolist()]
            counts[spelled] = np.array([len(x) for x in spellings])[which]
            starts = (np.cumsum(counts) - counts)[spelled]
            ids = np.repeat(ids, counts)
            for k, x in enumerate(spellings):
                mine = starts[which == k]
                for t, i in enumerate(x):
                    ids[mine + t] = i
        ends = 4 * np.cumsum(np.bincount(of, counts, many)).astype(np.int64)
        data, out, low = ids.astype("<i4").tobytes(), [b""] * many, 0
        for i, stop in zip(order.tolist(), ends.tolist()):
            out[i], low = data[low:stop], stop
        return out

    def segments(self, text: str) -> list[str]:
        """A text cut at its safe cuts."""
        joints = self.joints
        cuts = [0, *[i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joints], len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def units(self, texts) -> dict[str, bytes]:
        """Ids (int32 bytes) of each text, which starts and ends at safe cuts; long ones are cut further."""
        cut = {t: self.segments(t) for t in texts if len(t) > CACHED_CHARS + 1}
        short = list({t for t in texts if t not in cut} | {p for parts in cut.values() for p in parts if len(p) <= CACHED_CHARS + 1})
        out = {}
        for k in range(0, len(short), SOLVED_UNITS):
            part = short[k : k + SOLVED_UNITS]
            out.update(zip(part, self.solve(part)))
        for t, parts in cut.items():
            out[t] = b"".join([out.get(p) or self.long(p) for p in parts])
        return out

    def long(self, text: str) -> bytes:
        """Ids (int32 bytes) of a long segment without a safe cut."""
        return self.scan(text) if len(text) > CHUNK_CHARS else self.path(text, 0, len(text), None)

    def encode_all(self, marked: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of texts with their spaces marked; the new words of all are solved together."""
        if not self.spaced:
            got = self.units({t for t in marked if t})
            return [got[t] if t else b"" for t in marked]
        if len(self.words) >= CACHED_WORDS // 2:  # words in use move on to the new generation
            self.older_words, self.words = self.words, {}
        words, older, rows, heads, new = self.words, self.older_words, [], [], set()
        for t in marked:
            if t.startswith(SPACE) and not t.endswith(SPACE) and SPACE + SPACE not in t:
                heads.append("")
                rows.append(t[1:].split(SPACE))
            else:  # a space after a word is a safe cut
                runs = RUNS.findall(t)
                heads.append(runs.pop(0) if runs and runs[0][0] != SPACE else "")
                rows.append([r[1:] for r in runs])
            new.update(rows[-1])
        new.difference_update(words)
        for w in [w for w in new if w in older]:
            words[w] = older[w]
            new.discard(w)
        got = self.units([*[SPACE + w for w in new], *{h for h in heads if h}])
        words.update({w: got.pop(SPACE + w) for w in new if len(w) <= CACHED_CHARS})
        return [got.get(h, b"") + b"".join([words.get(w) or got[SPACE + w] for w in row]) for h, row in zip(heads, rows)]

    def encode(self, marked: str) -> bytes:
        """Ids (int32 bytes) of a text with its spaces marked."""
        return self.encode_all([marked])[0]

    def decode(self, ids) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw

    # The scan. A state is (start, end) of a piece with start < boundary <= end.

    def states(self, text: str, boundary: int) -> list[tuple[int, int]]:
        """States that a boundary of the text may have; (boundary, boundary) at the text's start."""
        if boundary == 0:
            return [(0, 0)]
        out = []
        for end in range(boundary, min(len(text), boundary + self.longest - 1) + 1):
            out += [(end - len(p), end) for p in self.ending(text, end, max(0, boundary - self.longest)) if end - len(p) < boundary]
        return out

    def is_cut(self, text: str, i: int) -> bool:
        """Whether i is a safe cut."""
        return i == 0 or i == len(text) or text[i - 1 : i + 1] not in self.joints

    def transfer(self, text: str, low: int, high: int):
        """(entry states, exit states, max-plus matrix) of the text's characters low..high."""
        entries, exits = self.states(text, low), self.states(text, high)
        matrix = np.full((len(entries), len(exits)), -np.inf)
        first = next((i for i in range(low + self.longest, high) if self.is_cut(text, i)), None)
        final = next((i for i in range(high - 1, low + self.longest - 1, -1) if self.is_cut(text, i)), None)
        far = max(e for _, e in exits)
        if first is None or final is None:
            for r, (a, b) in enumerate(entries):
                last = self.walk(text, b, text[a:b] or None, far)
                for c, (start, end) in enumerate(exits):
                    stays = (a, b) == (start, end)  # the piece covers the whole chunk
                    if stays or (end > b and last.get(end) is not None and end - len(last[end]) == start):
                        matrix[r, c] = 0.0
            return entries, exits, matrix
        # All paths meet at the first cut and go on alike from the last: one column of entries, one row of exits.
        enters = [first in self.walk(text, b, text[a:b] or None, first) for a, b in entries]
        last = self.walk(text, final, None, far)
        leaves = [end in last and last[end] is not None and end - len(last[end]) == start for start, end in exits]
        matrix[np.ix_(enters, leaves)] = 0.0
        return entries, exits, matrix

    def parts(self, text: str, entry: tuple[int, int], leave: tuple[int, int]) -> tuple[bytes, str, bytes]:
        """What lies between two states: ids (int32 bytes) up to the first safe cut, the text to the last one, ids from there."""
        start, end, before = entry[1], leave[1], text[entry[0] : entry[1]] or None
        first = next((i for i in range(start + (before is not None), end) if self.is_cut(text, i)), None)
        if first is None:
            return self.path(text, start, end, before), "", b""
        last = next(i for i in range(end - 1, first - 1, -1) if self.is_cut(text, i))
        return self.path(text, start, first, before) if first > start else b"", text[first:last], self.path(text, last, end, None)

    def between(self, chunks: list[tuple]) -> list[bytes]:
        """Ids (int32 bytes) of the pieces of each chunk: (text, entry state, leave state)."""
        parts = [self.parts(*c) for c in chunks]
        return [a + ids + b for (a, _, b), ids in zip(parts, self.encode_all([p[1] for p in parts]))]

    def scan(self, text: str, chunk: int = 4096) -> bytes:
        """Ids (int32 bytes) of a long text or segment as one process does it: matrices, scan, traces."""
        bounds = [*range(0, len(text), chunk), len(text)]
        parts = [self.transfer(text, a, b) for a, b in zip(bounds, bounds[1:])]
        at = resolve([p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts])
        return b"".join(self.between([(text, a, b) for a, b in zip(at, at[1:])]))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(matrices: list[np.ndarray], combine) -> list[np.ndarray]:
    """All prefix products by halving (associative): [m0, m0 m1, ...]."""
    if len(matrices) < 2:
        return list(matrices)
    paired = prefixes([combine(a, b) for a, b in zip(matrices[::2], matrices[1::2])], combine)
    out = []
    for i, m in enumerate(matrices):
        out.append(paired[i // 2] if i % 2 else (combine(paired[i // 2 - 1], m) if i else m))
    return out


def resolve(entries: list, exits: list, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The state at each boundary, first and last included."""
    end = max(e for _, e in exits[-1])
    goal = np.array([[0.0 if e == end else -np.inf] for _, e in exits[-1]])
    forward = prefixes([matrices[0][:1], *matrices[1:]], product)  # the start has one state
    backward = prefixes([goal, *matrices[::-1]], lambda a, b: product(b, a))
    out = [entries[0][0]]
    for k in range(len(matrices)):
        through = forward[k][0] + backward[len(matrices) - 1 - k][:, 0]
        out.append(exits[k][int(np.argmax(through))])
    return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def mark(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, ids array<int>) of every row; texts longer than a chunk go through the scan."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = chosen.schema[0].dataType.simpleString()
    longer = F.coalesce(F.length("text") > chunk_chars, F.lit(False))

    def short(batches):
        vocab = pieces(model_path)
        for batch in batches:
            for block in text_blocks(batch):
                ids = vocab.encode_all([mark(t or "") for t in block.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([block.column(0), _lists(ids)], names=["id", "ids"])
                del ids
        vocab.forget()

    alone = chosen.where(~longer).mapInArrow(short, f"id {id_type}, ids array<int>")
    return alone.unionByName(_scanned(chosen.where(longer), model_path, id_type, chunk_chars)).select(F.col("id").alias(id_col), "ids")


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"), type=pa.int32()))


def _scanned(giants: DataFrame, model_path: str, id_type: str, chunk: int) -> DataFrame:
    """Chunk rows, their matrices, the states per document, and the traces."""
    context = CONTEXT
    rows = giants.groupBy("id", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = rows.withColumn("text", F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))).withColumn("n", F.length("text"))
    cut = rows.select("id", "key", "copies", "text", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("k", "low"))
    left = F.greatest(F.col("low") - context, F.lit(0))
    right = F.least(F.col("low") + chunk + context, F.col("n"))
    cut = cut.select("id", "key", "copies", "n", "k", "low", left.alias("off"), F.least(F.col("low") + chunk, F.col("n")).alias("high"), F.expr("substring(text, greatest(low - %d, 0) + 1, least(low + %d, n) - greatest(low - %d, 0))" % (context, chunk + context, context)).alias("part"))
    cut = materialize(cut, "chunks")

    def measure(batches):
        vocab = pieces(model_path)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                entries, exits, matrix = vocab.transfer(r.part, r.low - r.off, r.high - r.off)
                shift = lambda s: [v + int(r.off) for p in s for v in p]  # noqa: B023, E731
                out.append((r.key, r.id, r.k, shift(entries), shift(exits), (matrix == 0).ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "id", "k", "entries", "exits", "open"])
            release()
        vocab.forget()

    matrices = cut.select("key", "id", "k", "low", "high", "off", "part").mapInPandas(measure, f"key long, id {id_type}, k int, entries array<int>, exits array<int>, open array<boolean>")

    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        pairs = lambda v: list(zip(list(v)[::2], list(v)[1::2]))
        entries, exits = [pairs(v) for v in pdf["entries"]], [pairs(v) for v in pdf["exits"]]
        tables = [np.where(np.array(list(o), dtype=bool).reshape(len(a), len(b)), 0.0, -np.inf) for o, a, b in zip(pdf["open"], entries, exits)]
        at = resolve(entries, exits, tables)
        return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "k": pdf["k"], "entry": [list(map(int, s)) for s in at[:-1]], "leave": [list(map(int, s)) for s in at[1:]]})

    at = matrices.groupBy("key", "id").applyInPandas(settle, f"key long, id {id_type}, k int, entry array<int>, leave array<int>")
    at = at.withColumnRenamed("key", "key2").withColumnRenamed("id", "id2").withColumnRenamed("k", "k2")
    known = cut.join(at, (cut.key == at.key2) & cut.id.eqNullSafe(at.id2) & (cut.k == at.k2)).select("id", "key", "copies", "k", "low", "high", "off", "part", "entry", "leave")

    step = max(1, BLOCK_BYTES // chunk)

    def trace(batches):
        vocab = pieces(model_path)
        for pdf in batches:
            for at in range(0, max(1, len(pdf)), step):
                some = pdf.iloc[at : at + step]
                state = lambda s, off: tuple(int(v) - off for v in s)
                ids = vocab.between([(r.part, state(r.entry, r.off), state(r.leave, r.off)) for r in some.itertuples()])
                yield some[["id", "key", "copies", "k"]].assign(ids=[np.frombuffer(x, "<i4") for x in ids])
                release()
        vocab.forget()

    traced = known.mapInPandas(trace, f"id {id_type}, key long, copies long, k int, ids array<int>")
    whole = traced.groupBy("id", "key", "copies").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("id", "ids")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids decode to null, bytes that are no UTF-8 to U+FFFD."""
    ship(rows.sparkSession)
    chosen = rows.select(F.col(id_col), F.col(ids_col))

    def run(batches):
        vocab = pieces(model_path)
        for batch in batches:
            texts = [None if not v.is_valid else vocab.decode(v.values.to_numpy(zero_copy_only=False).tolist()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[id_col, "text"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, text string")
