"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every piece that stands at a place, and one for a character without a piece,
which spells its UTF-8 bytes as byte pieces. Pieces never hold a space mark after another character, so a text's
lattice falls into units (space marks and what follows them) that can be filtered and sampled one by one with the
same result. A piece weighs (1 / (rank + RANK)) ** alpha. The forward pass sums the weights of all ways to each
place; the backward pass draws, from the end, the piece that ends there in proportion. Draws come from a hash of
the row's key, the unit's number and the step, so a row is segmented alike wherever it is computed.

Units are taken in groups of GROUP characters (one longer unit is a group of its own), however long a text is. Forward
passes run for all new units of a group at once and are kept up to about KEEP edges in a task; backward steps run for
all units of a group at once.

Defined cases: null texts and empty texts have no pieces (decoded: null and empty); control pieces never match
text; a literal space mark is spelled in bytes, so decoding gives back every text; a null key counts as 0;
repeated rows get equal pieces; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, mix, slices

MARK = "▁"
#: Stands for a literal space mark; a lone surrogate is in no valid text.
LITERAL = "\ud800"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
RANK = 10.0
#: Edges of lattices that a task keeps, about: 24 bytes each, at most doubled by spare room. Beyond it all are dropped.
KEEP = 1_500_000
#: Characters of units that are filtered and sampled at once.
GROUP = 1 << 17
#: Shares of a state are whole numbers below this, so draws don't depend on what else a task has seen.
ONE = (1 << 32) - 1
CHAR = 21  # bits of a code point


class _Growing:
    """An array that takes values at its end; its room doubles when it runs out. Only what was used takes memory."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(2 * KEEP, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.room):
            more = np.empty(max(need, 2 * len(self.room)), self.room.dtype)
            more[: self.n] = self.view
            self.room = more
        self.room[self.n : need] = values
        self.n = need

    @property
    def view(self) -> np.ndarray:
        return self.room[: self.n]


class PieceSampler:
    def __init__(self, path: str, alpha: float = 1.0, seed: int = 0):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [0] * 256
        self.spelled: list[bytes] = [b""] * n
        ranked = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.spelled[i] = piece.replace(MARK, " ").encode()
                ranked.append((-sp.get_score(i), i, piece))
        ranked.sort()
        self.rest = -2 * alpha * np.log(len(ranked) + RANK)
        self.seed = np.uint64(zlib.crc32(str(seed).encode()))
        self._trie([(p, i, -alpha * np.log(k + RANK)) for k, (_, i, p) in enumerate(ranked)])
        self.arrays: list[_Growing] = []
        self._reset()

    def forget(self) -> None:
        """What a task leaves to the next one in its process: the pieces, but no states or edges."""
        self.arrays = []
        self._reset()

    def _trie(self, pieces: list[tuple[str, int, float]]) -> None:
        """Sorted (node, character) keys with the child of each, and the piece and log weight of each node."""
        nodes: dict[int, int] = {}
        ids, weights = [-1], [0.0]
        for piece, i, w in pieces:
            at = 0
            for c in piece:
                key = at << CHAR | ord(c)
                if key not in nodes:
                    nodes[key] = len(ids)
                    ids.append(-1)
                    weights.append(0.0)
                at = nodes[key]
            ids[at], weights[at] = i, w
        keys = np.array(list(nodes), np.int64)
        # open addressing: a key lies at its place or at one of the next ones, up to `far` behind it
        self.slots = int(8 * len(keys)).bit_length()
        place, child = self._place(keys), np.array(list(nodes.values()), np.int64)
        self.keys, self.child, self.far = np.full((1 << self.slots) + len(keys), -1, np.int64), np.full((1 << self.slots) + len(keys), -1, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            at = place[left] + self.far
            free = self.keys[at] < 0
            self.keys[at[free][::-1]] = keys[left[free][::-1]]
            here = self.keys[at] == keys[left]
            self.child[at[here]] = child[left[here]]
            left, self.far = left[~here], self.far + 1
        self.piece, self.logw = np.array(ids, np.int64), np.array(weights)

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots)).view(np.int64)

    def _next(self, key: np.ndarray) -> np.ndarray:
        """The nodes below nodes by characters (node << CHAR | character), -1 where there is none."""
        at = self._place(key)
        found = self.keys[at]
        out = np.where(found == key, self.child[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        for k in range(1, self.far):
            if not len(left):
                break
            at = self._place(key[left]) + k
            found = self.keys[at]
            here = found == key[left]
            out[left[here]] = self.child[at[here]]
            left = left[~here & (found >= 0)]
        return out

    def _reset(self) -> None:
        """Drop all states and edges. Their room stays, unless it has doubled."""
        self.base: dict[str, int] = {}
        if self.arrays and max(len(a.room) for a in self.arrays) == 2 * KEEP:
            for a in self.arrays:
                a.n = 0
            return
        #: the shares, first states, offsets and sizes of all edges, the pool of ids, and which states begin a unit
        self.arrays = [_Growing(t) for t in (np.int64, np.int32, np.int32, np.int32, np.int32, bool)]

    def _filter(self, units: list[str]) -> None:
        """Add the states and edges of new units."""
        n = np.array([len(u) for u in units])
        text = "".join(units)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(n) - n
        unit = np.repeat(np.arange(len(units)), n)
        end = (begin + n)[unit]
        # all pieces from all places, one more character at a time
        at, node, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        starts, sizes, ids, logw = [], [], [], []
        while len(at):
            node = self._next(node << CHAR | chars[at + size])
            ok = node >= 0
            at, node, size = at[ok], node[ok].astype(np.int64), size + 1
            is_piece = self.piece[node] >= 0
            if size == 1:
                lone = np.ones(len(chars), bool)
                lone[at[is_piece]] = False
                lone = np.flatnonzero(lone)
            starts.append(at[is_piece])
            sizes.append(np.full(int(is_piece.sum()), size))
            ids.append(self.piece[node[is_piece]])
            logw.append(self.logw[node[is_piece]])
            more = at + size < end[at]
            at, node = at[more], node[more]
        start = np.concatenate([*starts, lone])
        size = np.concatenate([*sizes, np.ones(len(lone), np.int64)])
        ids = np.concatenate([*ids, np.full(len(lone), -1)])
        logw = np.concatenate([*logw, np.full(len(lone), self.rest)])
        stop = start + size
        # by place of the end, longest first; no two edges have equal ones
        most = int(size.max()) + 1
        order = np.sort((stop * most + most - size) << 32 | np.arange(len(stop))) & 0xFFFFFFFF
        start, stop, ids, logw = start[order], stop[order], ids[order], logw[order]
        of = unit[start]
        # the sums of all ways, for the t-th place of every unit in turn; state: place plus one for each unit before
        ways = np.full(len(chars) + len(units), -np.inf)
        ways[begin + np.arange(len(units))] = 0.0
        first, last = start + of, stop + of
        depth = stop - begin[of]
        by_depth = np.argsort(depth.astype(np.uint16) if int(n.max()) < 1 << 16 else depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(n.max()) + 2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            e = by_depth[lo:hi]
            x, state = ways[first[e]] + logw[e], last[e]
            new = np.flatnonzero(np.diff(state, prepend=-1))
            top = np.maximum.reduceat(x, new)
            counts = np.diff(new, append=len(e))
            ways[state[new]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, counts)), new))
        share = np.exp(ways[first] + logw - ways[last])
        new = np.flatnonzero(np.diff(last, prepend=-1))
        counts = np.diff(new, append=len(last))
        rank = np.arange(len(last)) - np.repeat(new, counts)
        for r in range(1, int(counts.max())):
            e = np.flatnonzero(rank == r)
            share[e] += share[e - 1]
        share = np.minimum(share * ONE, ONE).astype(np.int64)
        share[new + counts - 1] = ONE
        states, pooled = self.arrays[5].n, self.arrays[4].n
        spelled = [[self.bytes[x] for x in (MARK if text[i] == LITERAL else text[i]).encode()] for i in start[ids < 0]]
        lens = np.ones(len(ids), np.int64)
        lens[ids < 0] = [len(x) for x in spelled]
        offset = np.cumsum(lens) - lens
        pool = np.zeros(int(lens.sum()), np.int32)
        pool[offset[ids >= 0]] = ids[ids >= 0]
        if spelled:
            few = lens[ids < 0]
            pool[np.repeat(offset[ids < 0], few) + np.arange(int(few.sum())) - np.repeat(np.cumsum(few) - few, few)] = np.concatenate(spelled)
        begins = np.zeros(len(ways), bool)
        begins[begin + np.arange(len(units))] = True
        added = ((last + states << 32) + share, first + states, offset + pooled, lens, pool, begins)
        for a, x in zip(self.arrays, added, strict=True):
            a.add(x)
        self.base.update(zip(units, (begin + n + np.arange(len(units)) + states).tolist(), strict=True))

    def encode(self, texts: list[str | None], keys: list[int | None]) -> list[np.ndarray]:
        """The sampled ids of each text."""
        units, counts = [], []
        for t in texts:
            of_text = UNIT.findall(MARK + (t.replace(MARK, LITERAL) if MARK in t else t).replace(" ", MARK)) if t else ()
            units += of_text
            counts.append(len(of_text))
        if not units:
            return [np.zeros(0, np.int32) for _ in texts]
        counts = np.array(counts)
        with np.errstate(over="ignore"):
            key = mix(np.array([k or 0 for k in keys], np.int64).view(np.uint64) + (self.seed << np.uint64(32)))
            number = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
            draw = mix(np.repeat(key, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # units don't depend on each other, so they are taken in groups of a bounded number of characters
        chars = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(chars, np.arange(GROUP, int(chars[-1]), GROUP), "right"), [len(units)]]))
        groups = [self._sample(units[lo:hi], draw[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        ids, of_unit = (np.concatenate([g[k] for g in groups]) for k in (0, 1))
        upto = np.concatenate([[0], np.cumsum(of_unit)])[np.cumsum(counts)]
        return np.split(ids, upto[:-1])

    def _sample(self, units: list[str], draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sampled ids of all units in turn, and how many each unit has."""
        if self.arrays[0].n > KEEP:
            self._reset()
        known = self.base
        new = [u for u in set(units) if u not in known]
        if new:
            self._filter(new)
        ends = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        cum, start, offset, size, pool, first_of = (a.view for a in self.arrays)
        # equal units side by side, so that their edges are looked up while they are near
        live = np.argsort(ends)
        state, steps = ends[live], []
        length = np.zeros(len(ends), np.int64)
        while len(live):
            with np.errstate(over="ignore"):
                u = (mix(draw[live] + np.uint64(len(steps) + 1)) >> np.uint64(32)).astype(np.int64)
            edge = np.searchsorted(cum, (state << 32) + np.minimum(u, ONE - 1), side="right")
            steps.append((live, edge))
            length[live] += 1
            state = start[edge].astype(np.int64)
            more = ~first_of[state]
            state, live = state[more], live[more]
        edges = np.empty(int(length.sum()), np.int64)
        last = np.cumsum(length) - 1
        for k, (who, edge) in enumerate(steps):
            edges[last[who] - k] = edge
        sizes = size[edges].astype(np.int64)
        if int(sizes.max()) == 1:
            return pool[offset[edges]], length
        ends_at = np.cumsum(sizes)
        ids = pool[np.repeat(offset[edges] - (ends_at - sizes), sizes) + np.arange(int(ends_at[-1]))]
        return ids, np.add.reduceat(sizes, last - length + 1)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:].decode()


@lru_cache(maxsize=1)
def sampler(path: str, alpha: float, seed: int) -> PieceSampler:
    return PieceSampler(path, alpha, seed)


def encode(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id and ids (null for a null text) for every row of docs."""
    return _run(docs, path, alpha, seed, False)


def digest(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and whether decoding gives the text."""
    return _run(docs, path, alpha, seed, True)


def _run(docs: DataFrame, path: str, alpha: float, seed: int, digested: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, alpha, seed)
        s.forget()
        for batch in batches:
            for b in slices(batch):
                texts, keys = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                ids = s.encode(texts, keys)
                if digested:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": b.column("doc_id"), "n_pieces": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                        "lossless": pa.array([s.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    })
                else:
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array([None if t is None else x for x, t in zip(ids, texts, strict=True)], pa.list_(pa.int32()))})
        s.forget()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" if digested else "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; ids null gives text null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = PieceSampler(path)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array([None if x is None else s.decode(np.array(x)) for x in b.column("ids").to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
