"""Operator 9: encoding and decoding with a merge-type piece model, with seeded merge-dropout.

Encoding starts from single characters and takes, from an agenda, the best candidate merge (highest
score, then leftmost) until none is left. With dropout each candidate is skipped when a keyed hash of
(seed, document, position of the part, its place in the part) falls below the rate, so every occurrence
of a part draws anew; all segmentations decode to the same text. With rate 0 the ids are those of the
model's own library.

No piece holds a character before a space mark, so the parts between spaces are independent. A part's
outcome depends only on which of the candidates it meets are skipped, so the cache holds a tree for
each part of up to TREE symbols: a node is the run with a given set of skips, and lists the candidates
met since the last of them; an occurrence goes to the child of the first one that it skips, until it
skips none. Missing nodes run through their agendas side by side, one merge a round each, in numpy.
Longer and rarer parts run once for each occurrence; wide ones first fall apart where no piece holds two
neighbouring characters, as no merge reaches across. The cache is bounded and changes no result, and
texts of many megabytes are encoded in blocks that begin with a part.

Edge cases: null and empty texts have no ids and decode to the empty text; characters without a piece,
and the space mark itself, become byte pieces, so every text decodes to itself; rows that repeat a
doc_id give repeated results; rows without a doc_id are encoded as document 0; extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from . import scan

MODEL = "piece_bpe_32k.model"
#: VARIANTS 0: each occurrence draws anew; n: a part has n keys at most, of which occurrences draw one.
RATE, SEED, VARIANTS = 0.1, 1, 0
#: Cached parts and candidates of tree nodes per worker, about 200 MB.
MOST_PARTS, MOST_CANDIDATES = 300_000, 4_000_000
#: Parts of up to so many symbols have trees, once met so often; so many occurrences go down them at once.
TREE, OFTEN, STEP = 10, 3, 1 << 17
#: Parts beyond this many symbols have agendas of their own, on a heap.
WIDE = 48
MARK = "▁"
_NEVER = np.int32(2**31 - 1)


class Pieces:
    """The vocabulary as arrays, and the merges it implies."""

    def __init__(self, path: str) -> None:
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.names = [own.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(self.names[i][3:5], 16): i for i in range(n) if own.is_byte(i)}
        normal = [i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        # the piece of each character, by code point; a space is the mark, the mark itself has none
        self.of_point = np.full(0x110000, -1, np.int32)
        for name, i in self.ids.items():
            if len(name) == 1 and name != MARK:
                self.of_point[ord(name)] = i
        self.of_point[32] = self.ids[MARK]
        # rank of a merge: by score, high first
        order = sorted(normal, key=lambda i: (-own.get_score(i), i))
        rank, last = {}, None
        for i in order:
            if last is None or own.get_score(i) != last[0]:
                last = (own.get_score(i), len(rank))
            rank[i] = last[1]
        keys, ranks, merged = [], [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    ranks.append(rank[i])
                    merged.append(i)
        at = np.argsort(np.array(keys))
        self.keys, self.ranks, self.merged = np.array(keys, np.int64)[at], np.array(ranks, np.int32)[at], np.array(merged, np.int32)[at]
        # open addressing: a slot holds a pair's key (-1: free), its rank and the piece it becomes
        self._merges: dict[int, tuple[int, int]] | None = None
        self.slot_keys, self.slot_ranks, self.slot_pieces = np.full(1 << 20, -1, np.int64), np.full(1 << 20, _NEVER, np.int32), np.zeros(1 << 20, np.int32)
        rest, self.probes = np.arange(len(at)), 0
        while len(rest):
            slot = self._slot(self.keys[rest], self.probes)
            free = self.slot_keys[slot] < 0
            self.slot_keys[slot[free]] = self.keys[rest[free]]
            rest = rest[self.slot_keys[slot] != self.keys[rest]]
            self.probes += 1
        for probe in range(self.probes):
            slot = self._slot(self.keys, probe)
            mine = self.slot_keys[slot] == self.keys
            self.slot_ranks[slot[mine]], self.slot_pieces[slot[mine]] = self.ranks[mine], self.merged[mine]
        # neighbours inside some piece; between any other two characters no merge can reach
        inside = {(x, y) for piece in self.ids for x, y in pairwise(piece)}
        self.inside = np.sort(np.array([self.ids[x] << 16 | self.ids[y] for x, y in inside if x in self.ids and y in self.ids], np.int64))
        shown = set(normal)
        raw = [bytes([int(x[3:5], 16)]) if own.is_byte(i) else x.replace(MARK, " ").encode() if i in shown else b"" for i, x in enumerate(self.names)]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair; rank _NEVER where the two do not merge. A negative symbol
        makes a negative key, which no pair has."""
        key = left.astype(np.int64) << 16 | right
        at = self._slot(key, 0)
        held = self.slot_keys[at]
        ranks, merged = np.where(held == key, self.slot_ranks[at], _NEVER), self.slot_pieces[at]
        rest = np.flatnonzero((held >= 0) & (held != key) & (key >= 0))
        for probe in range(1, self.probes):
            if not len(rest):
                break
            at = self._slot(key[rest], probe)
            held = self.slot_keys[at]
            same = held == key[rest]
            ranks[rest[same]], merged[rest[same]] = self.slot_ranks[at[same]], self.slot_pieces[at[same]]
            rest = rest[(held >= 0) & ~same]
        return ranks, merged

    def merges(self) -> dict[int, tuple[int, int]]:
        """(rank, merged piece) by pair."""
        if self._merges is None:
            self._merges = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        return self._merges

    def cuts(self, symbols: np.ndarray) -> np.ndarray:
        """Where a run of symbols falls apart: no piece holds the two characters there side by side."""
        key = symbols[:-1].astype(np.int64) << 16 | symbols[1:]
        near = self.inside[np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)] == key
        return np.flatnonzero(~near) + 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) + probe) & ((1 << 20) - 1)


def skipped(rate: float, key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keyed decision on the candidate that joins [start, middle) and [middle, end) of a part."""
    if rate <= 0:
        return np.zeros(len(key), bool)
    return drawn(rate, key, placed(start, middle, end))


def placed(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The candidate's place as a spread 64-bit value."""
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    with np.errstate(over="ignore"):
        return scan.mix((place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def drawn(rate: float, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (scan.mix(key + place) >> np.uint64(11)) < np.uint64(rate * 2.0**53)


_64 = (1 << 64) - 1


def _mix(x: int) -> int:
    """scan.mix() of one value."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _64
    return x ^ x >> 31


def _draw(rate: float, key: int) -> Callable[[int, int, int], bool]:
    """skipped() of single candidates of one part."""
    bound = int(rate * 2.0**53)

    def one(start: int, middle: int, end: int) -> bool:
        place = _mix((((start << 42) ^ (middle << 21) ^ end) + 1) * 0x9E3779B97F4A7C15 & _64)
        return bound > 0 and _mix((key + place) & _64) >> 11 < bound

    return one


_WEIGHTS = scan.stream(77, 1 << 12) | np.uint64(1)


def part_keys(points: np.ndarray, sizes: np.ndarray, seed: int, variants: np.ndarray) -> np.ndarray:
    """A keyed hash of each (part, variant); points: the code points of all parts in a row."""
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        place = (np.arange(len(points)) - np.repeat(first, sizes)) % len(_WEIGHTS)
        sums = np.add.reduceat(scan.mix(points.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place], first) if len(sizes) else np.zeros(0, np.uint64)
        return scan.mix(sums + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + variants.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def segment(pieces: Pieces, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of all parts in a row: their agendas advance together, each by its best merge a round."""
    return _run(pieces, symbols, sizes, lambda row, *place: skipped(rate, keys[row], *place), lambda i: _draw(rate, int(keys[i])))


def _run(pieces: Pieces, symbols: np.ndarray, sizes: np.ndarray, skip: Callable, one: Callable, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """segment() with any skip(rows, start, middle, end), for a single candidate one(row)(start, middle,
    end); met receives the candidates of each row in their order."""
    ends = np.cumsum(sizes)
    first, lengths, owner, base = ends - sizes, sizes, np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    if (wide := np.flatnonzero(sizes > WIDE)).size:  # runs of their own between the cuts of a wide part
        more = [first[i] + pieces.cuts(symbols[first[i] : ends[i]]) for i in wide]
        first = np.sort(np.concatenate([first, *more]))
        owner = np.searchsorted(ends, first, "right")
        lengths, base = np.diff(first, append=len(symbols)), first - (ends - sizes)[owner]
    counts, blocks, owners = np.zeros(len(first), np.int64), [], []
    low = 0
    for high in (5, 8, 12, 18, 28, WIDE):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for some in np.split(rows, range(1 << 14, len(rows), 1 << 14)):
            if len(some):
                ids, count = _side_by_side(pieces, symbols, first[some], lengths[some], owner[some], base[some], skip, high, met)
                counts[some] = count
                blocks.append(ids)
                owners.append(np.repeat(some, count))
    for i in np.flatnonzero(lengths > WIDE):
        own = owner[i]
        found = agenda(pieces, symbols[first[i] : first[i] + lengths[i]], int(base[i]), lambda *place, own=own: skip(np.full(len(place[0]), own), *place), one(own))
        counts[i] = len(found)
        blocks.append(found)
        owners.append(np.full(len(found), i))
    counted = np.bincount(owner, counts, len(sizes)).astype(np.int64)
    if not blocks:
        return np.zeros(0, np.int32), counted
    return np.concatenate(blocks)[np.argsort(np.concatenate(owners), kind="stable")], counted


_GONE = np.int32(-(2**31))


def _side_by_side(pieces: Pieces, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray, owner: np.ndarray, base: np.ndarray, skip: Callable, width: int, met: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of at most ``width`` symbols, a piece in the cell of its first symbol and linked to its neighbours."""
    n, far = len(first), int(base.max())
    col = np.arange(width, dtype=np.int32)
    mask = (col < lengths[:, None]).ravel()
    ids = np.full(n * width, _GONE, np.int32)
    ids[mask] = symbols[_ragged(first, lengths)]
    after, before = np.tile(col + 1, n), np.tile(col - 1, n)
    rank, piece = np.full(n * width, _NEVER, np.int32), np.empty(n * width, np.int32)

    def offer(row: np.ndarray, cell: np.ndarray, right: np.ndarray) -> None:
        """Put the pairs of each cell with the one to its right on the agenda, but those skipped."""
        found, joined = pieces.find(ids[cell], ids[right])
        good = np.flatnonzero(found != _NEVER)
        row, cell, right, found = row[good], cell[good], right[good], found[good]
        start = row * width
        place = [cell - start, right - start, after[right]]
        if far:
            place = [x + base[row] for x in place]
        row = owner[row]
        if met is not None:
            met.append((row, *place))
        found[skip(row, *place)] = _NEVER
        rank[cell], piece[cell] = found, joined[good]

    cell = np.flatnonzero(mask[:-1] & mask[1:] & (np.arange(1, n * width) % width != 0))
    offer(cell // width, cell, cell + 1)
    live, table = np.arange(n), rank.reshape(n, width)
    while True:
        cell = live * width + table[live].argmin(axis=1)
        go = rank[cell] != _NEVER
        live, cell = live[go], cell[go]
        if not len(live):
            left = ids != _GONE
            return ids[left], np.bincount(np.flatnonzero(left) // width, minlength=n)
        start = live * width
        right = start + after[cell]
        ids[cell], ids[right] = piece[cell], _GONE
        rank[cell] = rank[right] = _NEVER
        after[cell] = after[right]
        inner = np.flatnonzero(after[cell] < lengths[live])
        behind = (start + after[cell])[inner]
        before[behind] = (cell - start)[inner]
        ahead = np.flatnonzero(before[cell] >= 0)
        front = (start + before[cell])[ahead]
        rank[front] = _NEVER
        offer(np.concatenate([live[ahead], live[inner]]), np.concatenate([front, cell[inner]]), np.concatenate([cell[ahead], behind]))


def agenda(pieces: Pieces, symbols: np.ndarray, base: int, skip: Callable, one: Callable) -> np.ndarray:
    """The same for one run of any length, with a heap and links between neighbours.

    base: the run's place in its part; one(start, middle, end): skip() of a single candidate. The heap
    holds rank and cell as one number; a candidate whose pair has changed since is told by its rank.
    """
    n = len(symbols)
    ids, after, before = symbols.astype(np.int32), np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    merges, size = pieces.merges(), n + 1
    found, _ = pieces.find(ids[:-1], ids[1:])
    cell = np.flatnonzero(found != _NEVER)
    cell = cell[~skip(cell + base, cell + base + 1, cell + base + 2)]
    heap = (found[cell].astype(np.int64) * size + cell).tolist()
    heapq.heapify(heap)

    def now(a: int) -> tuple[int, int]:
        """(rank, piece) of the pair at a; rank -1 for none, or a skipped one."""
        b = int(after[a])
        if b >= n:
            return -1, 0
        pair = merges.get(int(ids[a]) << 16 | int(ids[b])) if ids[a] >= 0 and ids[b] >= 0 else None
        return (-1, 0) if pair is None or one(a + base, b + base, int(after[b]) + base) else pair

    while heap:
        rank, a = divmod(heapq.heappop(heap), size)
        if ids[a] == _GONE:
            continue
        same, piece = now(a)
        if same != rank:
            continue
        b = after[a]
        ids[a], ids[b], after[a] = piece, _GONE, after[b]
        if after[a] < n:
            before[after[a]] = a
        for c in (int(before[a]), a):
            if c >= 0 and (rank := now(c)[0]) >= 0:
                heapq.heappush(heap, rank * size + c)
    return ids[ids != _GONE]


def _code(row: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    return row.astype(np.int64) << 18 | start.astype(np.int64) << 12 | middle.astype(np.int64) << 6 | end


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.all, self.n = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all, np.zeros(max(len(self.all), len(values)), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that start at first, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str, rate: float, seed: int, variants: int) -> None:
        self.pieces = Pieces(path)
        self.rate, self.seed, self.variants = rate, seed, variants if rate > 0 else 0
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        # of each part: where its symbols are, its keyed hash, how often it was met, the root of its tree (-1: none)
        self.symbols, self.first, self.sizes, self.hashes, self.times, self.root = _Rows(np.int32), _Rows(np.int64), _Rows(np.int64), _Rows(np.uint64), _Rows(np.int64), _Rows(np.int64)
        # of each node: its part, the node and candidate it forks from, where its candidates and its ids are
        self.part, self.parent, self.fork = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)
        self.met, self.n_met, self.start, self.size = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)
        # of each candidate of a node: start, middle and end in six bits each, the spread place, the child that skips it
        self.code, self.place, self.child = _Rows(np.int32), _Rows(np.uint64), _Rows(np.int64)
        self.pool = _Rows(np.int32)

    def encode(self, doc_ids: list[int], texts: list[str], places: list[int] | None = None) -> list[np.ndarray]:
        """Piece ids of whole texts; with places, of blocks() and the numbers of their first parts."""
        # a space opens the next part; further spaces before it stay with it
        split = [_parts(t) for t in texts] if places is None else [_split(t[1:]) for t in texts]
        if self.root.n > MOST_PARTS or self.child.n > MOST_CANDIDATES:
            self._clear()
        numbers = self.numbers
        fresh = list(set().union(*split).difference(numbers))
        if fresh:
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))
            symbols, sizes, hashes = self._symbols(fresh, np.zeros(len(fresh), np.int64))
            self.first.add(self.symbols.n + np.cumsum(sizes) - sizes)
            self.symbols.add(symbols)
            self.sizes.add(sizes)
            self.hashes.add(hashes)
            self.times.add(np.zeros(len(fresh), np.int64))
            self.root.add(np.full(len(fresh), -1))
        lengths = [len(x) for x in split]
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, sum(lengths))
        first = np.cumsum([0, *lengths])
        with np.errstate(over="ignore"):
            who = np.repeat(scan.mix(np.array(doc_ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed)), lengths)
            begin = first[:-1] - (0 if places is None else np.array(places, np.int64))
            where = (np.arange(len(flat)) - np.repeat(begin, lengths)).astype(np.uint64)
            keys = scan.mix(scan.mix(who + where) ^ who)
            if self.variants:
                keys = scan.mix(self.hashes.all[flat] + keys % np.uint64(self.variants) * np.uint64(0xD1B54A32D192ED03))
        n = self.root.n
        self.times.all[:n] += np.bincount(flat, minlength=n)
        often = (self.times.all[:n] >= OFTEN) & (self.sizes.all[:n] <= TREE) if self.rate > 0 else self.times.all[:n] > 0
        often = np.flatnonzero(often & (self.root.all[:n] < 0))
        self.root.all[often] = self.part.n + np.arange(len(often))
        self._grow(often, np.full(len(often), -1), np.full(len(often), -1))
        node = self.root.all[flat]
        long = np.flatnonzero(node < 0)
        if self.rate > 0:
            for a in range(0, len(flat), STEP):
                self._descend(node[a : a + STEP], keys[a : a + STEP])
        start, size = self.start.all[node], self.size.all[node]
        pool = self.pool.all[: self.pool.n]
        if len(long):
            sizes = self.sizes.all[flat[long]]
            ids, own = segment(self.pieces, self.symbols.all[_ragged(self.first.all[flat[long]], sizes)], sizes, keys[long], self.rate)
            start[long], size[long] = len(pool) + np.cumsum(own) - own, own
            pool = np.concatenate([pool, ids])
        out = pool[_ragged(start, size)]
        out = np.where(out < -1, -2 - out, out)
        cut = np.concatenate([[0], np.cumsum(size)])[first]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _descend(self, node: np.ndarray, keys: np.ndarray) -> None:
        """Move each occurrence from its root to the node of the skips that it draws."""
        todo = np.flatnonzero(node >= 0)
        while len(todo):
            at = node[todo]
            counts = self.n_met.all[at]
            edge = _ragged(self.met.all[at], counts)
            hit = np.flatnonzero(drawn(self.rate, np.repeat(keys[todo], counts), self.place.all[edge]))
            row = np.searchsorted(np.cumsum(counts), hit, "right")
            lead = np.flatnonzero(np.diff(row, prepend=-1))  # the first skip of each
            row, edge = row[lead], edge[hit[lead]]
            missing, where = np.unique(edge[self.child.all[edge] < 0], return_index=True)
            if len(missing):
                parents = at[row[self.child.all[edge] < 0][where]]
                self.child.all[missing] = self.part.n + np.arange(len(missing))
                self._grow(self.part.all[parents], parents, missing)
            todo = todo[row]
            node[todo] = self.child.all[edge]

    def _grow(self, parts: np.ndarray, parents: np.ndarray, forks: np.ndarray) -> None:
        """Nodes of the parts: their parents' skips and the candidates at forks (-1: a root)."""
        n, sizes = len(parts), self.sizes.all[parts]
        rows, up, edge, skips = np.arange(n), parents, forks, []
        while len(go := np.flatnonzero(edge >= 0)):
            rows, up, edge = rows[go], up[go], edge[go]
            skips.append(rows << 18 | self.code.all[edge])
            up, edge = self.parent.all[up], self.fork.all[up]
        skips = np.sort(np.concatenate([*skips, [-1]]))

        def skip(row: np.ndarray, *place: np.ndarray) -> np.ndarray:
            want = _code(row, *place)
            return skips[np.searchsorted(skips, want, "right") - 1] == want

        met = [] if self.rate > 0 else None
        ids, counts = _run(self.pieces, self.symbols.all[_ragged(self.first.all[parts], sizes)], sizes, skip, lambda i: _draw(0.0, 0), met)
        self.part.add(parts)
        self.parent.add(parents)
        self.fork.add(forks)
        self.start.add(self.pool.n + np.cumsum(counts) - counts)
        self.size.add(counts)
        self.pool.add(ids)
        row, *place = [np.concatenate(x) for x in zip(*met, strict=True)] if met else [np.zeros(0, np.int64)] * 4
        order = np.argsort(row, kind="stable")
        row, place = row[order], [x[order] for x in place]
        code = _code(row, *place)
        # a child lists what it meets behind its fork; up to there it is its parent's run
        passed = np.full(n, -1)
        last = np.flatnonzero(code == np.where(forks >= 0, np.arange(n) << 18 | self.code.all[forks], -1)[row])
        passed[row[last]] = last
        left = np.flatnonzero(np.arange(len(row)) > passed[row])
        counts = np.bincount(row[left], minlength=n)
        self.met.add(self.child.n + np.cumsum(counts) - counts)
        self.n_met.add(counts)
        self.code.add(code[left] & (1 << 18) - 1)
        self.place.add(placed(*[x[left] for x in place]))
        self.child.add(np.full(len(left), -1))

    def _symbols(self, parts: list[str], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, sizes, keys) of the parts: a piece a character; other characters, and a literal
        space mark, as byte pieces -2 - id, which merge with nothing."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        keys = part_keys(points, sizes, self.seed, variants)
        symbols = self.pieces.of_point[points]
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            owner = np.repeat(np.arange(len(parts)), sizes)
            raws = [chr(x).encode() for x in points[odd].tolist()]
            more = np.array([len(x) for x in raws])
            times = np.ones(len(points), np.int64)
            times[odd] = more
            symbols = np.repeat(symbols, times)
            symbols[symbols < 0] = [-2 - self.pieces.bytes_of[b] for x in raws for b in x]
            sizes = np.bincount(np.repeat(owner, times), minlength=len(parts))
        return symbols, sizes, keys

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8, without the space that encoding puts first."""
        return self.marked(ids).removeprefix(b" ")

    def marked(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8, as a block holds it."""
        p = self.pieces
        size = p.sizes[ids]
        return p.raw[_ragged(p.starts[ids], size)].tobytes()


def _parts(text: str) -> list[str]:
    """The parts of a text, after one space put first; none for no text."""
    return _split(text) if text else []


def _split(text: str) -> list[str]:
    """Runs of spaces with the characters behind them; the first run has one space more than the text."""
    words = text.split(" ")
    if "" not in words:
        return [" " + x for x in words]
    out, spaces = [], 0
    for x in words:
        spaces += 1
        if x:
            out.append(" " * spaces + x)
            spaces = 0
    if spaces:
        out.append(" " * spaces)
    return out


#: Characters of a block of a very long text.
BLOCK = 1 << 21
_OPENS = re.compile("(?<! ) ")


def blocks(text: str) -> Iterator[tuple[str, int]]:
    """(block, number of its first part) of a text with one space put first, cut where a part begins.

    Blocks are encoded one by one, so memory follows a block; only a single part of more than BLOCK
    characters makes a block that is much longer.
    """
    text, at, parts = " " + text, 0, 0
    while at < len(text):
        found = _OPENS.search(text, at + BLOCK)
        end = found.start() if found else len(text)
        yield text[at:end], parts
        parts, at = parts + len(_split(text[at + 1 : end])), end


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS) -> Encoder:
    """One encoder per worker and setting."""
    key = (model, rate, seed, variants)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model if os.sep in model else public_tokenizers.path(model), rate, seed, variants)
    return _ENCODERS[key]


def encode(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS, ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text_crc32, lossless[, ids]) of every document.

    text_crc32 is that of the decoded text; lossless tells that it equals the text (null: empty).
    """
    kind = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean" + ", ids array<int>" * ids

    names = ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless", *["ids"] * ids]

    def one(own: Encoder, doc_id: int, text: str) -> tuple:
        """The results of a text beyond BLOCK characters."""
        n, ids_sum, text_sum, same, kept, lead = 0, 0, 0, True, [], 1
        for block, place in blocks(text):
            found = own.encode([doc_id], [block], [place])[0]
            back = own.marked(found)
            n, same = n + len(found), same and back == block.encode()
            ids_sum, text_sum, lead = zlib.crc32(found.astype("<u4").tobytes(), ids_sum), zlib.crc32(back[lead:], text_sum), 0
            kept += [found] * ids
        return n, ids_sum, text_sum, same, *[np.concatenate(kept)] * ids

    def some(own: Encoder, doc_ids: list[int], texts: list[str]) -> Iterator[tuple]:
        found = own.encode(doc_ids, texts)
        for x, text in zip(found, texts, strict=True):
            back = own.decode(x)
            yield len(x), zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(back), back == text.encode(), *[x] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model, rate, seed, variants)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * ids]
        for batch in batches:
            offsets, _ = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets, 2 * BLOCK):
                doc_ids, texts = [x or 0 for x in batch.column(0).slice(a, b - a).to_pylist()], batch.column(1).slice(a, b - a).to_pylist()
                rows = [one(own, doc_ids[0], texts[0])] if b - a == 1 and len(texts[0]) > BLOCK else some(own, doc_ids, texts)
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, kind)
