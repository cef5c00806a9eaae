"""Exact n-gram Jaccard self-join by universe-partition pigeonhole.

Sets are the distinct 5-word shingles of a text (the whole sequence, if it has fewer words), as 48-bit hashes. Two
sets with n and m elements are linked when 4 * |both| >= 3 * |either|, so they differ in at most (n + m) / 7 elements.

Sizes are cut into bands. A band has a layout: a hash deals the universe of elements out to its segments. The larger
of two linked sets, with n elements, sees at most H = floor(2 n / 7) differences, so among any H + 1 of its non-empty
segments one is equal on both sides. A set takes part in the layout of its own band and of the band that holds the
largest size it can be linked with.

1. Index: every non-empty segment's subset gives a key; sets that share a key are candidates. A key with more than
   `hot` sets is not paired. As linked sets share all of their other keys but one for each difference, candidates that
   share fewer go before any elements move.
2. Allocation: a set of n that has floor((n + m) / 7) + 1 non-hot keys in each of its layouts, for the largest size m
   it can meet there, shares one of them with every set it is linked with, larger or smaller (the other side shares
   the key, and its heat), and loses nothing by leaving its hot ones out. The others are short, and pairs of two short
   sets remain.
3. Short sets are compared with one set under a few of their hot keys, turn by turn with other keys and other sets, and
   join its component if they are linked. A hot key whose short sets are by then all of one component needs no further
   look, so it counts like a cold one; sets that have enough of both are settled, as every set that they are linked
   with is either compared or in their component. What a hot key holds is folded to its components before it moves.
4. The sets that remain are indexed again with fewer, larger segments, by each subset and its one-deletion
   neighbourhood: a segment whose keys are all cold now stands for two differences, as equal or within one insertion
   or deletion.
5. Sets that are short again share an element among the n - ceil(3 n / 4) + 1 first of each, where elements that few
   of these sets have come first. They are compared with the smallest set under each such element, where many pairs
   are left with a few further ones, and then with all sets under it that aren't yet in the same component, but for
   pairs whose elements before it already differ too much. Pairs are verified where they meet, and only links that join
   components become rows. Nothing is capped.

Candidates are held against bitmaps (a bit that differs is an element that differs, so none is lost), then verified
on the hashes, for each set with its smallest and then its largest partner first; candidates that are by then in one
component need no look, all others are verified too. Equal sets are one class before all this, so copies cost one set.

A bounded number of pairs or sets (ONE_PAIRS, ONE_SETS, ONE_BYTES) is settled by one task instead of by the steps that
are left, with equal results.

Keys travel in packed blocks, at most `hot` + 1 a key and block, and meet in buckets that number with the input.
The hot keys reach executors as a bitmap of a bit for every 16 elements, 2**MOST_BITS bits at most; a false hit makes a
set short, which costs time only.

Defined cases: no words or a null text: empty set, size 0, linked with nothing; a null doc_id has a size but no
component; rows that repeat a doc_id with other texts count as one node; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, mix, slices, word_hashes, workers, written
from .graph import components

SHINGLE = 5
HOT = 24
#: Sizes of the bitmaps of hot keys; the largest takes 32 MB.
LEAST_BITS, MOST_BITS = 20, 28
WINDOW_KEYS = 500_000
#: Keys of a bucket, about.
BUCKET_KEYS = 1_500_000
#: Turns in which short sets are compared with one set under each of STARS hot keys; they end early if they settle few.
TURNS, STARS = 4, 2
#: Parts into which the sets under a key are dealt for that.
SALTS = 8
#: Names of sets (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Further centres are tried while more pairs than this meet for each row that is left, and at most so many times.
FEW_PAIRS = 8
CENTRE_ROUNDS = 4
#: Sets under an element that are compared in one task with each other, or with as many others.
CELL = 1024
#: What one task may settle by itself: pairs, or sets that are all compared with each other, and bytes of their elements.
ONE_PAIRS, ONE_SETS, ONE_BYTES = 50_000, 4096, 32 << 20
#: Components' rows (16 bytes each) that are broadcast to joins; more are joined by a shuffle.
NEAR_ROWS = 200_000
#: Smallest sizes of the bands; 3 is the least size that links with another, of 4.
BANDS = np.array([3, *(4 << k for k in range(40))], np.int64)
#: Sizes in a set's name: those from one of these up to below the next are one class, exact up to 64.
CLASS_BITS = 8
SIZES = np.array([*range(64), *(64 * 2 ** (np.arange(192) / 8)).astype(np.int64)], np.int64)
#: Bytes of an element that is sent or kept.
ELEMENT = 6
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' elements: text number and hash, sorted by both, and the size of each set."""
    words, counts = word_hashes(texts)
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(begin + counts, counts) - np.arange(len(words))
    with np.errstate(over="ignore"):
        full = np.flatnonzero(left >= SHINGLE)
        h = np.zeros(len(full), np.uint64)
        for j in range(SHINGLE):
            h = h * _STEP + words[full + j]
        at = text[full]
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            more = np.zeros(len(short), np.uint64)
            for j in range(SHINGLE - 1):
                use = counts[short] > j
                more[use] = more[use] * _STEP + words[begin[short][use] + j]
            h, at = np.concatenate([h, more + counts[short].astype(np.uint64)]), np.concatenate([at, short])
        h = mix(h) >> np.uint64(64 - 8 * ELEMENT)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
        h, at = h[new], at[new]
    return at, h, np.bincount(at, minlength=len(counts)).astype(np.int64)


def fingerprints(at: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set, whose low bits are the class of its size; 0 for the empty one."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(h + np.uint64(1)), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
            out[full] = name >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | (np.searchsorted(SIZES, n[full], "right") - 1).astype(np.uint64)
    return out.view(np.int64)


def _segments(band: np.ndarray, deletions: bool) -> np.ndarray:
    """How many segments the layout of a band has."""
    need = 2 * (2 * BANDS[band] - 1) // 7 + 1
    return (0.62 * need).astype(np.int64) + 4 if deletions else (1.15 * need).astype(np.int64) + 4


def keys(at: np.ndarray, h: np.ndarray, n: np.ndarray, deletions: bool, steps: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every key: its value, the set's number, the segment's number (of all here) and whether it leaves one out.

    at must be 0, 1, ... over sets in turn. steps: the layouts of the sets' own bands (0) and of the next ones (1).
    """
    band = np.searchsorted(BANDS, n, "right") - 1
    far = np.searchsorted(BANDS, 4 * n // 3, "right") - 1
    got = []
    with np.errstate(over="ignore"):
        for step in steps:
            use = (band >= 0) & (band + step <= far)
            mine = use[at]
            a, x = at[mine], h[mine]
            if not len(a):
                continue
            layout = band[a] + step
            m = _segments(layout, deletions).astype(np.uint64)
            salt = mix((layout.astype(np.uint64) + np.uint64(1000 if deletions else 1)) * _STEP)
            seg = ((mix(x ^ salt) >> np.uint64(32)) * m) >> np.uint64(32)
            code = a.astype(np.uint64) << np.uint64(40) | seg
            order = np.argsort(code)
            code, x, salt = code[order], mix(x[order]), salt[order]
            new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(new, append=len(code))
            total = np.add.reduceat(x, new)
            who = (code[new] >> np.uint64(40)).astype(np.int64)
            tag = salt[new] + (code[new] & np.uint64((1 << 40) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            number = np.arange(len(new)) + sum(len(g[1]) for g in got)
            got.append((mix(total ^ mix(tag + size.astype(np.uint64))), who, number, np.zeros(len(new), bool)))
            if deletions:
                # a segment of one element has no subset to leave: empty segments never meet
                rich = np.repeat(size > 1, size)
                of = np.repeat(np.arange(len(new)), size)[rich]
                got.append((mix((total[of] - x[rich]) ^ mix(tag[of] + size[of].astype(np.uint64) - np.uint64(1))), who[of], number[of], np.ones(len(of), bool)))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([g[i] for g in got]) for i in range(4))


def _place(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's bucket, and its 32 bits within the bucket."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Bits:
    """A bitmap; places beyond the set ones are False."""

    def __init__(self, bits: int, places: np.ndarray):
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8)
        np.bitwise_or.at(self.data, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return (self.data[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _spot(bucket: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Where a key's bit is in the bitmap of hot keys."""
    with np.errstate(over="ignore"):
        return (mix(bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _layouts(n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each layout's step, which sets take part in it, and how many keys they need for the largest partner there."""
    band = np.searchsorted(BANDS, n, "right") - 1
    far = np.searchsorted(BANDS, 4 * n // 3, "right") - 1
    for step in (0, 1):
        most = np.minimum(4 * n // 3, BANDS[band + step + 1] - 1)
        yield step, (band >= 0) & (band + step <= far), (n + most) // 7 + 1


def heat_of(at: np.ndarray, h: np.ndarray, n: np.ndarray, hot: Bits, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, list[np.ndarray]]]]:
    """Which sets have too few cold keys in a layout they take part in; for each layout how many each set lacks, and
    where its hot keys are in the bitmap."""
    short, out = np.zeros(len(n), bool), []
    for step, use, need in _layouts(n):
        key, who, _, _ = keys(at, h, n, False, (step,))
        spot = _spot(*_place(key, buckets), hot.bits)
        is_hot = hot[spot]
        lacks = np.where(use, need - np.bincount(who[~is_hot], minlength=len(n)), 0)
        short |= lacks > 0
        order = np.argsort(who[is_hot], kind="stable")
        spots = np.split(spot[is_hot][order].astype(np.int32), np.cumsum(np.bincount(who[is_hot], minlength=len(n)))[:-1])
        out.append((lacks, spots))
    return short, out


def short_of(at: np.ndarray, h: np.ndarray, n: np.ndarray, hot: Bits, buckets: int, deletions: bool) -> np.ndarray:
    """Which sets have too few cold keys in a layout they take part in, for the largest partner they can meet there."""
    out = np.zeros(len(n), bool)
    for step, use, need in _layouts(n):
        key, who, segment, less = keys(at, h, n, deletions, (step,))
        cold = ~hot[_spot(*_place(key, buckets), hot.bits)]
        units = np.bincount(who[~less], cold[~less], len(n))
        if deletions:
            number = int(segment.max()) + 1 if len(segment) else 0
            rich = np.bincount(segment[less], minlength=number) > 0
            bad = np.bincount(segment, ~cold, number) > 0
            of = np.zeros(number, np.int64)
            of[segment] = who
            units += np.bincount(of[rich & ~bad], minlength=len(n))
        out |= use & (units < need)
    return out


#: The keys of a bucket (32 bits each) set by set, how many each set has, and the sets' names.
_BLOCK = "bucket int, keys binary, counts binary, fps binary"


class _Packer:
    """Gathers keys of many sets and gives packed rows for each bucket."""

    def __init__(self, buckets: int, hot: int):
        self.buckets, self.hot = buckets, hot
        self.clear()

    def clear(self) -> None:
        self.key, self.who, self.fp, self.held, self.sets = [], [], [], 0, 0

    def add(self, key: np.ndarray, who: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.key.append(key)
        self.who.append(who + self.sets)
        self.fp.append(fp)
        self.held, self.sets = self.held + len(key), self.sets + len(fp)
        if self.held >= WINDOW_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, who = np.concatenate(self.key), np.concatenate(self.who).astype(np.uint32)
            fp = np.concatenate(self.fp)
            order = np.argsort(key)
            key, who = key[order], who[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rank = np.arange(len(key)) - np.repeat(new, np.diff(new, append=len(key)))
            key, who = key[rank <= self.hot], who[rank <= self.hot]
            bucket, low = _place(key, self.buckets)
            order = np.argsort(bucket << 32 | who)
            bucket, low, who = bucket[order], low[order], who[order]
            cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                first = np.flatnonzero(np.diff(who[part], prepend=np.uint32(who[part][0] ^ 1)))
                counts = np.diff(first, append=len(who[part]))
                kind = np.uint8 if counts.max() < 1 << 8 else np.uint32
                rows.append((int(b), low[part].tobytes(), counts.astype(kind).tobytes(), fp[who[part][first]].tobytes()))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 64]], pa.int32() if k == 0 else pa.binary()) for k in range(4)], ["bucket", "keys", "counts", "fps"])
        self.clear()


def _met(blocks: list[tuple[bytes, bytes, bytes]], bucket: int, most: int, bits: int) -> pa.RecordBatch:
    """Candidate pairs of one bucket, and the places of its hot keys."""
    low, counts, fps = [], [], []
    for k, c, f in blocks:
        low.append(np.frombuffer(k, np.uint32))
        fps.append(np.frombuffer(f, np.int64))
        counts.append(np.frombuffer(c, np.uint8 if len(c) == len(fps[-1]) else np.uint32).astype(np.int64))
    fp, same = np.unique(np.concatenate(fps), return_inverse=True)
    who = np.repeat(np.arange(len(same)), np.concatenate(counts))
    size_class = fp & ((1 << CLASS_BITS) - 1)
    least, most_n = SIZES[size_class], np.append(SIZES[1:], 1 << 62)[size_class] - 1
    code = np.unique(np.concatenate(low).astype(np.uint64) << np.uint64(32) | same[who].astype(np.uint64))
    key, node = code >> np.uint64(32), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(new, append=len(key))
    hot = _spot(np.full(int((size > most).sum()), bucket), key[new[size > most]].astype(np.uint32), bits)
    ok = np.repeat((size > 1) & (size <= most), size)
    key, node = key[ok], node[ok]
    found = [np.zeros(0, np.int64)]
    for d in range(1, most):
        if d >= len(key):
            break
        i = np.flatnonzero(key[:-d] == key[d:])
        if not len(i):
            break
        a, b = node[i], node[i + d]  # a < b, as nodes are sorted under a key
        fit = 4 * np.minimum(most_n[a], most_n[b]) >= 3 * np.maximum(least[a], least[b])
        found.append(a[fit] * len(fp) + b[fit])
    pair, many = np.unique(np.concatenate(found), return_counts=True)
    a, b = pair // len(fp), pair % len(fp)
    hot = np.unique(hot)
    none = pa.nulls(len(hot), pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.chunked_array([pa.array(fp[a]), none]).combine_chunks(), pa.chunked_array([pa.array(fp[b]), none]).combine_chunks(),
        pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(hot, pa.int64())]).combine_chunks(),
        pa.chunked_array([pa.array(many, pa.int64()), none]).combine_chunks(),
    ], ["a", "b", "hot", "many"])


def _meet(blocks: DataFrame, buckets: int, most: int, bits: int) -> DataFrame:
    """a, b of candidates and how many keys they share here, or hot (a place in the bitmap of hot keys), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for bucket, *rest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and held:
                    yield _met(held, now, most, bits)
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield _met(held, now, most, bits)

    return written(blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "a long, b long, hot long, many long"))


def _bitmap(places: DataFrame, bits: int) -> Bits:
    """Of a column of places; they are packed to words of 32 bits before they come to the driver, 2**(bits - 5) at most."""
    x = places.toDF("x").distinct()
    words = x.groupBy(F.shiftright("x", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 31 as int))")).alias("v")).toArrow()
    out = Bits(bits, np.zeros(0, np.int64))
    out.data.view("<u4")[np.asarray(words.column("w"), np.int64)] = np.asarray(words.column("v"), np.int64)
    return out


def _near(rows: DataFrame) -> DataFrame:
    """The rows, broadcast to a join if they are few."""
    return F.broadcast(rows) if rows.limit(NEAR_ROWS + 1).count() <= NEAR_ROWS else rows


def _enough(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) that share as many keys as linked sets do at least.

    Sets that differ in d elements differ in d segments of a layout at most, so they share all cold keys of either but
    d, in each layout that both take part in. One key less is asked for, as two keys of a set may be one in a bucket.
    sets: fp, n, band, cold0 and cold1 (cold keys in the layout of the own band and the next; -1: takes no part).
    """
    pairs = met.filter("a is not null").groupBy("a", "b").agg(F.sum("many").alias("many"))
    names = ("n", "band", "cold0", "cold1")
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(end), *(F.col(k).alias(end + k) for k in names)), end)
    differ = "cast((an + bn) div 7 as long)"
    least = f"""case when aband = bband then greatest(0, greatest(acold0, bcold0) - {differ}) + if(acold1 >= 0 and bcold1 >= 0, greatest(0, greatest(acold1, bcold1) - {differ}), 0)
        when aband + 1 = bband then greatest(acold1, bcold0) - {differ} when bband + 1 = aband then greatest(acold0, bcold1) - {differ} end"""
    return pairs.filter(f"4 * least(an, bn) >= 3 * greatest(an, bn) and many >= {least} - 1").select("a", "b")


def _stars(profile: DataFrame, live: Bits, turn: int) -> DataFrame:
    """Pairs (a < b) of sets with the one set that is chosen under each of a few of their live hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for t in batches for part in slices(t, "spots0", 4096)):
            who, spot = _spots(b, live)
            with np.errstate(over="ignore"):
                order = np.lexsort((mix(spot.astype(np.uint64) + np.uint64(turn) * _STEP), who))
            who, spot = who[order], spot[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            rank = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
            who, spot = who[rank < STARS], spot[rank < STARS]
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(spot, pa.int64()), b.column("fp").take(at), b.column("n").take(at)], ["spot", "fp", "n"])

    rows = profile.mapInArrow(lean(run), "spot long, fp long, n long")
    centre = rows.groupBy("spot").agg(F.min_by(F.struct("fp", "n"), F.xxhash64("fp", F.lit(turn))).alias("c"), F.count("*").alias("many")).filter("many > 1")
    # a key may hold very many sets: they are dealt to parts, each of which has the one set
    centre = centre.select(F.col("spot").alias("c_spot"), F.col("c.fp").alias("c_fp"), F.col("c.n").alias("c_n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    fit = (F.col("fp") != F.col("c_fp")) & (4 * F.least("n", "c_n") >= 3 * F.greatest("n", "c_n"))
    both = rows.join(centre, (F.col("spot") == F.col("c_spot")) & (F.pmod("fp", F.lit(SALTS)) == F.col("salt")) & fit)
    return both.select(F.least("fp", "c_fp").alias("a"), F.greatest("fp", "c_fp").alias("b")).distinct()


def _spots(b: pa.RecordBatch, live: Bits | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places of the (live) hot keys of a batch of profiles."""
    got = [np.frombuffer(x.as_py(), np.int32) for k in ("spots0", "spots1") for x in b.column(k)]
    who = np.repeat(np.tile(np.arange(b.num_rows), 2), [len(x) for x in got])
    spot = np.concatenate([np.zeros(0, np.int32), *got]).astype(np.int64)
    if live is None:
        return who, spot
    use = live[spot]
    return who[use], spot[use]


def _unsettled(profile: DataFrame, roots: DataFrame, bits: int) -> tuple[DataFrame, Bits]:
    """The profiles that lack settled keys, and the map of hot keys that hold sets of several components."""
    placed = profile.join(_near(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for t in batches for part in slices(t, "spots0", 4096)):
            who, spot = _spots(b, None)
            root = np.asarray(b.column("root"), np.int64)[who]
            order = np.argsort(spot)
            spot, root = spot[order], root[order]
            new = np.flatnonzero(np.diff(spot, prepend=-1))
            if len(new):
                yield pa.RecordBatch.from_pydict({"spot": pa.array(spot[new]), "lo": pa.array(np.minimum.reduceat(root, new)), "hi": pa.array(np.maximum.reduceat(root, new))})

    by = placed.mapInArrow(lean(fold), "spot long, lo long, hi long").groupBy("spot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    live = _bitmap(by.filter("lo <> hi").select("spot"), bits)
    sent = profile.sparkSession.sparkContext.broadcast(live)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for t in batches for part in slices(t, "spots0", 4096)):
            lacks = np.zeros(b.num_rows, bool)
            for k in ("0", "1"):
                spots = [np.frombuffer(x.as_py(), np.int32) for x in b.column("spots" + k)]
                who = np.repeat(np.arange(b.num_rows), [len(x) for x in spots])
                settled = ~sent.value[np.concatenate([np.zeros(0, np.int32), *spots]).astype(np.int64)]
                lacks |= np.asarray(b.column("lacks" + k), np.int64) > np.bincount(who[settled], minlength=b.num_rows)
            yield b.filter(pa.array(lacks))

    return written(profile.mapInArrow(lean(left), profile.schema)), live


def _bitmap_of(x: np.ndarray) -> bytes:
    """One bit for each element, in a bitmap of a size that follows the band two above; folded when compared."""
    bits = 64 << max(0, int(len(x) - 1).bit_length() - 5)
    out = np.zeros(bits, bool)
    out[(mix(x) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _may_link(a: bytes, b: bytes, n: int, m: int) -> bool:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    if len(x) > size:
        x = np.bitwise_or.reduce(x.reshape(-1, size))
    if len(y) > size:
        y = np.bitwise_or.reduce(y.reshape(-1, size))
    return 7 * int(np.bitwise_count(x ^ y).sum()) <= n + m


def _pack(x: np.ndarray) -> bytes:
    """A set's elements in ELEMENT bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ELEMENT].tobytes()


def _unpack(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // ELEMENT, 8), np.uint8)
    out[:, :ELEMENT] = np.frombuffer(x, np.uint8).reshape(-1, ELEMENT)
    return out.reshape(-1).view("<u8")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 4 * both >= 3 * (len(a) + len(b) - both)


def _checked(pairs: DataFrame, sets: DataFrame, column: str, exact: bool) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link, or that are linked."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("an"), F.col(column).alias("ax"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("bn"), F.col(column).alias("bx"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "ax", "bx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = t.column("an").to_pylist(), t.column("bn").to_pylist()
            ok = []
            for x, y, i, j in zip(t.column("ax"), t.column("bx"), n, m, strict=True):
                x, y = x.as_py(), y.as_py()
                ok.append(_linked(_unpack(x), _unpack(y)) if exact else _may_link(x, y, i, j))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(_near(a), "a", "left").join(_near(b), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _each_head(heads: DataFrame, *more: str) -> DataFrame:
    """A row for each first element: x, fp, n, before (how many elements of the set come before it)."""
    return heads.select(F.posexplode("xs").alias("at", "x"), "fp", "n", "lone", *more).select("x", "fp", "n", (F.col("lone") + F.col("at")).alias("before"), *more)


def _mixed(heads: DataFrame, roots: DataFrame) -> DataFrame:
    """The first elements of sets (fp, n, lone, xs) with their root, where not all sets of one are in one component;
    written. Roots are joined to sets, before there is a row for each element."""
    placed = _each_head(heads.join(_near(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "root")
    mixed = placed.groupBy("x").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("x")
    return written(placed.join(mixed, "x", "left_semi"))


def _pairs_left(placed: DataFrame) -> float:
    """How many pairs of different components meet under the elements."""
    by = placed.groupBy("x", "root").agg(F.count("*").cast("double").alias("c")).groupBy("x").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return by.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0.0


def _meeting(left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
    """Pairs (a < b) that meet under an element and may be linked.

    Linked sets pass at the first element they share: what comes before it in either is not in the other, so they
    share at most n - before elements of each.
    """
    p, q = left.alias("p"), right.alias("q")
    most = F.least(F.col("p.n") - F.col("p.before"), F.col("q.n") - F.col("q.before"))
    on = (F.col("p.x") == F.col("q.x")) & apart & (7 * most >= 3 * (F.col("p.n") + F.col("q.n")))
    return p.join(q, on).select(F.least("p.fp", "q.fp").alias("a"), F.greatest("p.fp", "q.fp").alias("b")).distinct()


def _cell_pairs(fp: np.ndarray, n: np.ndarray, before: np.ndarray, root: np.ndarray, bits: list[bytes], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of one cell that are in different components and may be linked, by size, place and bitmap.

    Sets of one part meet each other if there is no second one, else those of the other part.
    """
    length, rest = np.array([len(x) // 8 for x in bits]), n - before
    across, found = part.min() != part.max(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size in np.unique(length):
        mine = np.flatnonzero(length == size)
        # linked sets have bitmaps of one size, or of one and its double, which is folded
        other = np.flatnonzero((length == size) | (length == 2 * size))
        table = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[j], np.uint64).reshape(-1, size)) for j in other])
        for k in mine:
            use = (root[other] != root[k]) & (7 * np.minimum(rest[other], rest[k]) >= 3 * (n[other] + n[k]))
            use &= (length[other] > size) | (other > k)  # each pair once
            if across:
                use &= part[other] != part[k]
            at = np.flatnonzero(use)
            if len(at):
                at = at[7 * np.bitwise_count(table[at] ^ np.frombuffer(bits[k], np.uint64)).sum(axis=1, dtype=np.int64) <= n[other[at]] + n[k]]
                found.append((np.minimum(fp[other[at]], fp[k]), np.maximum(fp[other[at]], fp[k])))
    return tuple(np.concatenate([x[i] for x in found]) for i in (0, 1))


def _links_of(x: list[np.ndarray], label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b: numbers of sets) that are linked and join two components; label is kept current.

    Labels are numbers below len(label). A set is held against all its partners of other components at once.
    """
    if not len(a):
        return a, b
    n = np.array([len(v) for v in x], np.int64)
    begin = np.cumsum(n) - n
    kinds, code = np.unique(np.concatenate(x), return_inverse=True)
    mark, order = np.zeros(len(kinds), bool), np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts, found = np.flatnonzero(np.diff(a, prepend=-1)), []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
        k, other = a[lo], b[lo:hi]
        other = other[label[other] != label[k]]
        if not len(other):
            continue
        mine = code[begin[k] : begin[k] + n[k]]
        mark[mine] = True
        at = np.repeat(begin[other] - (np.cumsum(n[other]) - n[other]), n[other]) + np.arange(n[other].sum())
        both = np.add.reduceat(mark[code[at]].astype(np.int64), np.cumsum(n[other]) - n[other])
        mark[mine] = False
        for c in other[4 * both >= 3 * (n[other] + n[k] - both)]:
            if label[c] != label[k]:
                label[label == label[c]] = label[k]
                found.append((k, c))
    out = np.array(found, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _cell_links(fp: np.ndarray, before: np.ndarray, root: np.ndarray, x: list[np.ndarray], part: np.ndarray, across: bool) -> pa.RecordBatch:
    """Links (a < b) of sets of the parts that join components, enough to join all that these links join.

    Parts are taken two at a time, so the pairs that are held at once don't grow with their number; with across, sets
    of one part aren't compared with each other.
    """
    n, bits = np.array([len(v) for v in x], np.int64), [_bitmap_of(v) for v in x]
    label = np.unique(root, return_inverse=True)[1]
    out = [np.zeros((2, 0), np.int64)]
    parts = np.unique(part)
    for i, p in enumerate(parts):
        for q in parts[i:]:
            if p != q or not across:
                use = np.flatnonzero((part == p) | (part == q))
                a, b = _cell_pairs(np.arange(len(use)), n[use], before[use], label[use], [bits[k] for k in use], part[use])
                a, b = _links_of(x, label, use[a], use[b])
                out.append(np.stack([fp[a], fp[b]]))
    a, b = np.concatenate(out, axis=1)
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _in_one(sets: DataFrame, roots: DataFrame, fps: np.ndarray) -> DataFrame:
    """Links between any of a few sets (fp, elements; each may come twice), found in one task; written."""
    spark = sets.sparkSession
    few = spark.createDataFrame(pa.table({"fp": pa.array(fps, pa.int64())}))
    rows = sets.select("fp", "elements").join(F.broadcast(few), "fp", "left_semi")
    rows = rows.join(_near(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "elements").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: (r, e) for t in batches for f, r, e in zip(*(t.column(k).to_pylist() for k in ("fp", "root", "elements")), strict=True)}
        if held:
            fp = np.array(sorted(held), np.int64)
            yield _cell_links(fp, np.zeros(len(fp), np.int64), np.array([held[f][0] for f in fp.tolist()], np.int64), [_unpack(held[f][1]) for f in fp.tolist()], np.arange(len(fp)) // CELL, False)

    return written(rows.mapInArrow(lean(run), "a long, b long"))


def _pairs_in_one(sets: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """Those of a few pairs that are linked, enough to join what they join, found in one task; written."""
    spark = sets.sparkSession
    few = spark.createDataFrame(pa.table({"fp": pa.array(np.unique(np.concatenate([a, b])), pa.int64())}))
    sent = spark.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: e for t in batches for f, e in zip(t.column("fp").to_pylist(), t.column("elements").to_pylist(), strict=True)}
        if held:
            fp = np.array(sorted(held), np.int64)
            p, q = _links_of([_unpack(held[f]) for f in fp.tolist()], np.arange(len(fp)), *(np.searchsorted(fp, x) for x in sent.value))
            p, q = fp[p], fp[q]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(p, q), pa.int64()), "b": pa.array(np.maximum(p, q), pa.int64())})

    return written(sets.select("fp", "elements").join(F.broadcast(few), "fp", "left_semi").repartition(1).mapInArrow(lean(run), "a long, b long"))


def _bytes_of(fps: np.ndarray) -> int:
    """Bytes that the elements of sets of these names take, at most about."""
    return int(np.append(SIZES[1:], SIZES[-1] * 2)[fps & ((1 << CLASS_BITS) - 1)].sum()) * ELEMENT


def _few_sets(rows: DataFrame) -> np.ndarray | None:
    """The names (fp) in rows, if one task may compare all of them."""
    fps = np.asarray(rows.select("fp").distinct().limit(ONE_SETS + 1).toArrow().column("fp"), np.int64)
    return fps if len(fps) <= ONE_SETS and _bytes_of(fps) <= ONE_BYTES else None


def _meeting_all(placed: DataFrame, elements: DataFrame) -> DataFrame:
    """Links between all sets under each element, enough to join what they join: pairs are verified where they meet.

    The sets under an element are dealt to parts of about CELL; a task has two parts at once.
    """
    many = placed.groupBy("x").agg(F.count("*").alias("many")).filter("many > 1")
    parts = F.ceil(F.col("many") / CELL).cast("int")
    rows = placed.join(many, "x").join(elements.select("fp", "elements"), "fp").withColumn("part", F.pmod(F.xxhash64("fp", "x"), parts).cast("int"))
    rows = rows.select("x", "fp", "before", "root", "elements", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    rows = rows.withColumn("lo", F.least("part", "with")).withColumn("hi", F.greatest("part", "with")).drop("with")
    dealt = rows.repartition(workers(placed.sparkSession), "x", "lo", "hi").sortWithinPartitions("x", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            fp, before, root, x, part = zip(*held, strict=True)
            return _cell_links(*(np.array(v, np.int64) for v in (fp, before, root)), [_unpack(v) for v in x], np.array(part), now[1] != now[2])

        now = None
        for t in batches:
            cells = zip(*(t.column(k).to_pylist() for k in ("x", "lo", "hi")), strict=True)
            for cell, row in zip(cells, zip(*(t.column(k).to_pylist() for k in ("fp", "before", "root", "elements", "part")), strict=True), strict=True):
                if cell != now and held:
                    yield done()
                    held = []
                now = cell
                held.append(row)
        if held:
            yield done()

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def set_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp (of the set) of every row of docs, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                at, h, n = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "fp": pa.array(fingerprints(at, h, n), pa.int64())})

    return written(docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, fp long"))


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """at, h, n, fp of the sets that can be linked with others and that this task hasn't had."""
    seen: set[int] = set()
    for b in batches:
        for part in slices(b):
            at, h, n = shingle_sets(part.column("text").to_pylist())
            fp = fingerprints(at, h, n)
            use = np.zeros(len(n), bool)
            for k, f in enumerate(fp.tolist()):
                if n[k] >= BANDS[0] and f not in seen:
                    seen.add(f)
                    use[k] = True
            keep = use[at]
            yield (np.cumsum(use) - 1)[at[keep]], h[keep], n[use], fp[use]


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = [_unpack(v.as_py()) for v in b.column("elements")]
    n = np.array([len(v) for v in x], np.int64)
    return np.repeat(np.arange(len(n)), n), np.concatenate([np.zeros(0, np.uint64), *x]), n, np.asarray(b.column("fp"), np.int64)


def links(docs: DataFrame, classes: DataFrame, hot: int = HOT) -> DataFrame:
    """node, root over the sets (by fp) that are linked with others."""
    texts = docs.filter("doc_id is not null and text is not null").select("text")
    spark = docs.sparkSession
    total = int(classes.agg(F.sum("n")).first()[0] or 0)
    buckets = max(workers(spark), -(-total * 7 // 10 // BUCKET_KEYS))
    bits = min(MOST_BITS, max(LEAST_BITS, total.bit_length() - 4))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, hot)
        for at, h, n, fp in _new_sets(batches):
            key, who, _, _ = keys(at, h, n, False)
            yield from packer.add(key, who, fp)
        yield from packer.flush()

    met = _meet(texts.mapInArrow(lean(index), _BLOCK), buckets, hot, bits)
    forget(spark)
    heat = spark.sparkContext.broadcast(_bitmap(met.filter("hot is not null").select("hot"), bits))

    def named(fps: DataFrame) -> Bits:
        return _bitmap(fps.select(F.shiftrightunsigned(F.xxhash64("fp"), 64 - bits)), bits)

    def within(map_of: Bits, fp: np.ndarray) -> np.ndarray:
        import xxhash

        return map_of[np.array([xxhash.xxh64_intdigest(f.tobytes(), 42) >> (64 - bits) for f in fp], np.int64)]

    wanted = spark.sparkContext.broadcast(named(met.select(F.explode(F.array("a", "b")).alias("fp")).filter("fp is not null").distinct()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, h, n, fp in _new_sets(batches):
            if not len(n):
                continue
            short, layouts = heat_of(at, h, n, heat.value, buckets)
            use = np.flatnonzero(short | within(wanted.value, fp))
            cold = [np.where(takes, need - lacks, -1) for (_, takes, need), (lacks, _) in zip(_layouts(n), layouts, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "fp": pa.array(fp[use], pa.int64()), "n": pa.array(n[use], pa.int64()), "short": pa.array(short[use], pa.bool_()),
                "band": pa.array((np.searchsorted(BANDS, n, "right") - 1)[use], pa.int32()), **{f"cold{s}": pa.array(c[use], pa.int32()) for s, c in enumerate(cold)},
                **{f"lacks{s}": pa.array(lacks[use], pa.int64()) for s, (lacks, _) in enumerate(layouts)},
                **{f"spots{s}": pa.array([spots[k].tobytes() if short[k] else None for k in use], pa.binary()) for s, (_, spots) in enumerate(layouts)},
            })

    facts = written(texts.mapInArrow(lean(gather), "fp long, n long, short boolean, band int, cold0 int, cold1 int, lacks0 long, lacks1 long, spots0 binary, spots1 binary"))
    pairs = written(_enough(met, facts.select("fp", "n", "band", "cold0", "cold1").dropDuplicates(["fp"])))
    profile = facts.filter("short").select("fp", "n", "lacks0", "lacks1", "spots0", "spots1").dropDuplicates(["fp"])
    # only now elements are kept: of sets that are compared
    needed = spark.sparkContext.broadcast(named(pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(profile.select("fp"))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, h, n, fp in _new_sets(batches):
            begin = np.cumsum(n) - n
            use = np.flatnonzero(within(needed.value, fp))
            x = [h[begin[k] : begin[k] + n[k]] for k in use]
            yield pa.RecordBatch.from_pydict({"fp": pa.array(fp[use], pa.int64()), "n": pa.array(n[use], pa.int64()), "elements": pa.array([_pack(v) for v in x], pa.binary()), "bits": pa.array([_bitmap_of(v) for v in x], pa.binary())})

    sets = written(texts.mapInArrow(lean(keep), "fp long, n long, elements binary, bits binary"))

    def of_ends(pairs: DataFrame, column: str) -> DataFrame:
        """fp, n and a column of the sets in pairs, once each; no others are moved."""
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
        few = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
        return sets.select("fp", "n", column).join(few, "fp", "left_semi").dropDuplicates(["fp"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Bitmaps first: they are small, and few pairs that they pass aren't linked."""
        pairs = written(_checked(pairs, of_ends(pairs, "bits"), "bits", False))
        return written(_checked(pairs, of_ends(pairs, "elements"), "elements", True))

    def joined(pairs: DataFrame, sure: DataFrame | None, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The links so far with those among the pairs that could decide a component, and the components.

        Each set comes with its smallest partner first, then with its largest, then what is still apart: most pairs of
        a group need no look.
        """
        if roots is not None:
            pairs = written(_apart(pairs, roots))
        few = pairs.limit(ONE_PAIRS + 1).toArrow()
        a, b = (np.asarray(few.column(k), np.int64) for k in "ab")
        if len(a) <= ONE_PAIRS and _bytes_of(np.unique(np.concatenate([a, b]))) <= ONE_BYTES:
            if not len(a) and sure is not None:
                return sure, roots
            more = _pairs_in_one(sets, a, b)
            sure = more if sure is None else sure.unionByName(more)
            return sure, components(sure)
        for key, end, pick in (("b", "a", F.min), ("a", "b", F.max)):
            first = written(pairs.groupBy(key).agg(pick(end).alias(end)).select("a", "b"))
            more = verified(first)
            sure = more if sure is None else sure.unionByName(more)
            roots = components(sure)
            pairs = written(_apart(pairs, roots).join(first, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                return sure, roots
        sure = sure.unionByName(verified(pairs))
        return sure, components(sure)

    sure, roots = joined(pairs, None, None)
    forget(spark)
    if facts.filter("short").isEmpty():
        return roots
    profile, live = _unsettled(written(profile), roots, bits)
    count = profile.count()
    for turn in range(TURNS):
        if not count:
            return roots
        sure, roots = joined(written(_stars(profile, live, turn)), sure, roots)
        profile, live = _unsettled(profile, roots, bits)
        before, count = count, profile.count()
        few = _few_sets(profile)
        if few is not None:
            return components(sure.unionByName(_in_one(sets, roots, few)))
        if 5 * count > 4 * before:
            break
    if not count:
        return roots

    short = written(sets.select("fp", "elements").join(profile.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, hot)
        for b in batches:
            for part in slices(b, "elements"):
                at, h, n, fp = _unpacked(part)
                key, who, _, _ = keys(at, h, n, True)
                yield from packer.add(key, who, fp)
        yield from packer.flush()

    met2 = _meet(short.mapInArrow(lean(again), _BLOCK), buckets, hot, bits)
    forget(spark)
    heat2 = spark.sparkContext.broadcast(_bitmap(met2.filter("hot is not null").select("hot"), bits))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "elements"):
                at, h, n, fp = _unpacked(part)
                if not len(n):
                    continue
                use = short_of(at, h, n, heat2.value, buckets, True)[at]
                yield pa.RecordBatch.from_pydict({"x": pa.array(h[use].view(np.int64), pa.int64()), "fp": pa.array(fp[at[use]], pa.int64()), "n": pa.array(n[at[use]], pa.int64())})

    every = written(short.mapInArrow(lean(firsts), "x long, fp long, n long"))
    often = every.groupBy("x").agg(F.count("*").alias("d")).filter("d > 1")
    # what no other of these sets has comes first and leads nowhere: only how many there are matters
    lone = F.col("n") - F.col("m")
    shared = every.join(often, "x").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("xs"), F.count("*").alias("m"))
    take = F.greatest(F.lit(0), F.col("n") - F.expr("(3 * n + 3) div 4") + 1 - lone).cast("int")
    heads = written(shared.select("fp", "n", lone.alias("lone"), F.slice(F.transform("xs", lambda s: s["x"]), F.lit(1), take).alias("xs")).filter(F.size("xs") > 0))
    rest = _each_head(heads)
    low = rest.groupBy("x").agg(F.min("fp").alias("a"), F.count("*").alias("many")).filter("many > 1").select("x", "a")
    star = rest.join(low, "x").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    pairs = met2.filter("a is not null").select("a", "b").unionByName(star).distinct()
    sure, roots = joined(written(pairs), sure, roots)
    # what the smallest under an element did not bring together is compared under each element that is shared
    placed = _mixed(heads, roots)
    for turn in range(CENTRE_ROUNDS):
        if _few_sets(placed) is not None:
            break
        # where components still meet in large groups, another centre brings most of them together first
        if _pairs_left(placed) <= FEW_PAIRS * placed.count():
            break
        centre = placed.groupBy("x").agg(F.min_by(F.struct("fp", "root", "n", "before"), F.xxhash64("fp", F.lit(turn))).alias("c")).select("x", "c.*")
        more = verified(written(_meeting(centre, placed, F.col("p.root") != F.col("q.root"))))
        if more.isEmpty():
            break
        sure = sure.unionByName(more)
        roots = components(sure)
        placed = _mixed(heads, roots)
    if not placed.isEmpty():
        few = _few_sets(placed)
        more = _in_one(short, roots, few) if few is not None else written(_meeting_all(placed, short))
        roots = components(sure.unionByName(more))
    return roots


def jaccard_components(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows = set_classes(docs)
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = links(docs, rows, hot)
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc")
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("many"))
    of = placed.join(least, "root").select("fp", "component_id")
    out = rows.join(of, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id stay."""
    gone = jaccard_components(docs, hot).filter("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return rest
