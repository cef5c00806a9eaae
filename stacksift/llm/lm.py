"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, and its unigram base.

Tokens are a text's words in lower case (A-Z), then one end. The base is the smoothed unigram model of all training
documents. The model is P(class | history) * P(member | class, history) * P(word | member). Both softmax factors sum
hashed feature weights over the last word, the word before it, both together (n-grams) and the last word with the
third last (a skip); the rows of the second factor are kept apart by class. The end and the words that are most
frequent in all training documents are members of their own, so features tell them apart; all other words share
HASHED members of each class by their hash, and only within those does the smoothed unigram decide. The model sums
to 1 over all words and one unseen word a shared member.

Counts cover all training documents. Words that are common in a bounded sample have their counts summed in every task
and sent as one vector, so a word that all documents share never moves row by row; all other words move once, packed
by document, meet their counts in buckets that number with the input and go back as a sum for each document. The
sample decides only which way a word's count takes, never the count or the members.

Weights start from the observed counts of (feature, class) and (feature, member) over all training documents, and
move by distributed gradient updates (`rounds`): every task sums what the weights so far expect over all its documents,
the sums are added up block by block, and each weight moves by the difference to the observed count, relative to the
expected one. The sums are of whole numbers (shares in units of 1 / ONE), so they don't depend on how documents are
dealt to tasks, or on lost ones. The feature table grows with the root of the training tokens, up to MAX_BITS, which
bounds a task's memory.

Defined cases: null and empty texts are the end alone; without training documents counts are 0 (the base then gives
log10(0.5 / 0.5) = 0 for a token) and weights are 0; a null doc_id counts as the text '' in the folds; repeated rows
get equal scores; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, mix, slices, word_hashes, workers, written

COMMON = 32_768
CLASSES = 32
MEMBERS = 32
#: The last members of each class, which words without a member of their own share.
HASHED = 4
OWN = MEMBERS - HASHED
#: Words that have a member of their own; one such place is the end's.
KNOWN = CLASSES * OWN - 1
#: Updates of the registered query: on texts left out, the likelihood gains from the first three and none after them.
ROUNDS = 3
MIN_BITS, MAX_BITS = 12, 18
#: Shares of a gradient are whole numbers of this size.
ONE = 1 << 12
#: A share plus this is rounded to a whole number, which the low bits of the sum then are; and the bits of two of these.
WHOLE, WHOLE_BITS = np.float32(1 << 23), np.full(2, 1 << 23, "<f4").view("<u8")[0]
#: Tokens whose softmax is computed at once.
CHUNK = 1 << 11
#: Tokens whose shares are summed at once; four features of each may meet in one row, where a sum has 32 bits. Most
#: slices of texts have fewer, so each adds to the tables once.
SUMMED = (1 << 18) - 1
BLOCKS = 64
WINDOW = 1_500_000
#: Characters of the documents that one task sums gradients over, about.
TASK_CHARS = 1 << 25
_SLOTS = 20
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Lookup:
    """Numbers of known hashes, -1 for others: a table of slots that no two of them share."""

    def __init__(self, hashes: np.ndarray, exact: bool):
        """With exact, a multiplier is looked for that parts all; otherwise of those that share a slot the first stays."""
        self.factor = np.uint64(1)
        if exact:
            factors = np.random.default_rng(1).integers(1, 1 << 62, 1000, np.uint64) * np.uint64(2) + np.uint64(1)
            with np.errstate(over="ignore"):
                self.factor = next(f for f in factors if len(np.unique((hashes * f) >> np.uint64(64 - _SLOTS))) == len(hashes))
        slot = self._slot(hashes)
        keep = np.sort(np.unique(slot, return_index=True)[1])
        self.hashes = hashes[keep]
        self.slots = np.zeros(1 << _SLOTS, np.int32)
        self.slots[slot[keep]] = np.arange(len(keep))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * self.factor) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = self.slots[self._slot(h)]
        return np.where(self.hashes[at] == h, at, -1)


def common_words(docs: DataFrame, sample: int = 2_000) -> Lookup:
    """Of at most about `sample` training documents with the smallest hashes; those words are counted as vectors."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    n = docs.count()
    if n > sample:
        rows = rows.filter(F.col("h") < int(-(2**63) + 2**64 * sample / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                use, c = np.unique(word_hashes(part.column("text").to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"w": pa.array(use.view(np.int64)), "c": pa.array(c, pa.int64())})

    counted = rows.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    got = counted.orderBy(F.desc("c"), "w").limit(COMMON).collect()
    return Lookup(np.array([r["w"] for r in got], np.int64).view(np.uint64), False)


def shared_leaf(h: np.ndarray) -> np.ndarray:
    """The leaf (class * MEMBERS + member) of words without one of their own."""
    x = mix(h + np.uint64(77))
    return ((x % np.uint64(CLASSES)) * np.uint64(MEMBERS) + np.uint64(OWN) + (x >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64)


class Leaves:
    """Words with leaves of their own, the most frequent first; leaf 0 is the end's."""

    def __init__(self, hashes: np.ndarray):
        self.lookup = Lookup(hashes, True)

    @staticmethod
    def of_rank(rank: np.ndarray) -> np.ndarray:
        """Ranks are dealt to the classes in turn; the end has rank 0, words follow."""
        return (rank % CLASSES) * MEMBERS + rank // CLASSES

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of words, and their numbers among those with one of their own (-1: none)."""
        number = self.lookup(h)
        return np.where(number >= 0, self.of_rank(number + 1), shared_leaf(h)), number


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of all texts, ends among them: hashes (0 for ends), whether they are ends, and counts by text."""
    h, n = word_hashes(texts)
    counts = n + 1
    end = np.zeros(len(h) + len(n), bool)
    end[np.cumsum(counts) - 1] = True
    out = np.zeros(len(end), np.uint64)
    out[~end] = h
    return out, end, counts


def features(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit features of every token's history; a token before the text is 1."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    back = []
    for k in (1, 2, 3):
        x = np.ones(len(h), np.uint64)
        x[k:] = np.where(place[k:] >= k, h[:-k], x[k:])
        back.append(x)
    a, b, c = back
    with np.errstate(over="ignore"):
        return [mix(a + _SALTS[0]), mix(b + _SALTS[1]), mix(a * _SALTS[2] + b), mix(a * _SALTS[3] + c)]


def rows_of(f: list[np.ndarray], cls: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The features' rows in the tables of classes and of members; each class has 2**bits / CLASSES rows of the second."""
    per = bits - (CLASSES - 1).bit_length()
    first = [(x >> np.uint64(64 - bits)).astype(np.int32) for x in f]
    base = (cls << per).astype(np.int32)
    return first, [base + (x >> np.uint64(64 - per)).astype(np.int32) for x in f]


def sums_of(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of the rows of weights and the bias, their exponentials, and the sums of those.

    A weight is far below 20 and there are four, so no exponential overflows.
    """
    x = weights.take(rows[0], axis=0, mode="clip")
    more = np.empty_like(x)
    for r in rows[1:]:
        x += weights.take(r, axis=0, out=more, mode="clip")
    x += bias
    e = np.exp(x, out=more)
    return x, e, np.einsum('ij->i', e)  # row by row, so a row's sum doesn't depend on its neighbours


@dataclass
class Model:
    """Weights (float32) and log biases of both factors."""

    bits: int
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    member_bias: np.ndarray

    def log_score(self, f: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(member | class) of every token."""
        cls, member, out = leaf // MEMBERS, leaf % MEMBERS, np.empty(len(leaf))
        one, two = rows_of(f, cls, self.bits)
        for k in range(0, len(leaf), CHUNK):
            s = slice(k, k + CHUNK)
            at = np.arange(len(leaf[s]))
            x, _, total = sums_of(self.first, [r[s] for r in one], self.bias)
            out[s] = x[at, cls[s]] - np.log(total)
            x, _, total = sums_of(self.second, [r[s] for r in two], self.member_bias[cls[s]])
            out[s] += x[at, member[s]] - np.log(total)
        return out

    def expect(self, f: list[np.ndarray], leaf: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Add every token's shares (in units of 1 / ONE) to its features, in tables of a row for each class or member."""
        cls = leaf // MEMBERS
        one, two = rows_of(f, cls, self.bits)
        for k in range(0, len(leaf), SUMMED):
            s = slice(k, k + SUMMED)
            for table, weights, rows, bias in ((first, self.first, one, self.bias), (second, self.second, two, self.member_bias)):
                here = [r[s].astype(np.intp) for r in rows]
                # two shares lie in one whole number of 64 bits, so one addition serves both
                parts = np.empty((len(table) // 2, len(here[0])), "<u8")
                for i in range(0, len(here[0]), CHUNK):
                    c = slice(i, i + CHUNK)
                    _, e, total = sums_of(weights, [r[c] for r in here], bias if bias.ndim == 1 else bias.take(cls[s][c], axis=0))
                    e *= (np.float32(ONE) / total)[:, None]
                    e += WHOLE
                    np.subtract(e.view("<u8").T, WHOLE_BITS, out=parts[:, c])
                pairs = np.zeros((len(parts), table.shape[1]), "<u8")
                for row, x in zip(pairs, parts, strict=True):
                    for r in here:
                        np.add.at(row, r, x)
                table[0::2] += pairs & np.uint64(0xFFFFFFFF)
                table[1::2] += pairs >> np.uint64(32)


def observe(f: list[np.ndarray], leaf: np.ndarray, bits: int, first: np.ndarray, second: np.ndarray) -> None:
    """Add one to each (class, feature's row) and (member, feature's row) of every token."""
    cls, member = leaf // MEMBERS, leaf % MEMBERS
    for table, rows, at in zip((first, second), rows_of(f, cls, bits), (cls, member), strict=True):
        for r in rows:
            table += np.bincount((at << bits) + r, minlength=table.size).reshape(table.shape)


def initial(bits: int, of_leaf: np.ndarray, first: np.ndarray, second: np.ndarray, share: float = 0.5, shrink: float = 10.0) -> Model:
    """Biases are the logs of shares; a weight is `share` of how far its observed share, shrunk to the bias's, is from it."""
    n = of_leaf.reshape(CLASSES, MEMBERS) + 0.5
    bias, member_bias = np.log(n.sum(axis=1) / n.sum()), np.log(n / n.sum(axis=1, keepdims=True))
    out = []
    for table, base in ((first, bias[None, :]), (second, np.repeat(member_bias, len(second) // CLASSES, axis=0))):
        total = table.sum(axis=1, keepdims=True)
        # rows lie together in memory: take would copy the whole table otherwise, each time
        out.append((share * (np.log((table + shrink * np.exp(base)) / (total + shrink)) - base)).astype(np.float32, order="C"))
    return Model(bits, *out, bias.astype(np.float32), member_bias.astype(np.float32))


def moved(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, rate: float = 0.2, steady: float = 2.0) -> np.ndarray:
    """weights after one update: the gradient relative to what was expected, at most 1 either way, times the rate."""
    e = expected / ONE
    return weights + (rate * np.clip((seen - e) / (e + steady), -1, 1)).astype(np.float32, order="C")


def summed(docs: DataFrame, chars: int, bits: int, leaves: Leaves, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows of docs: the observed counts of both tables, or what the model expects in units of 1 / ONE, with a
    row for each feature's row. chars: how many characters docs have, about.

    Tasks send blocks of their tables; a block is added up in one place, whose number doesn't grow with the input.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((leaves, model))
    shape = ((CLASSES, 1 << bits), (MEMBERS, 1 << bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, model = sent.value
        tables, any_rows = [np.zeros(s) for s in shape], False
        for b in batches:
            for part in slices(b):
                h, end, counts = tokens_of(part.column("text").to_pylist())
                leaf = np.where(end, 0, leaves(h)[0])
                f, any_rows = features(h, counts), True
                if model is None:
                    observe(f, leaf, bits, *tables)
                else:
                    model.expect(f, leaf, *tables)
        if any_rows:
            press = zstandard.ZstdCompressor(level=1)
            for k, table in enumerate(tables):
                for i, x in enumerate(np.split(table.astype(np.int64).ravel(), BLOCKS)):
                    kind = np.int32 if x.max(initial=0) < 1 << 31 else np.int64
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k * BLOCKS + i], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32()), "x": pa.array([press.compress(x.astype(kind).tobytes())], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor()
        for t in batches:
            for block, width, x in zip(t.column("block").to_pylist(), t.column("width").to_pylist(), t.column("x"), strict=True):
                x = np.frombuffer(open_.decompress(x.as_py()), f"<i{width}").astype(np.int64)
                sums[block] = sums[block] + x if block in sums else x
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "x": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    few = docs.select("text").coalesce(max(spark.sparkContext.defaultParallelism, chars // TASK_CHARS))
    got = few.mapInArrow(run, "block int, width int, x binary").repartition(min(2 * BLOCKS, workers(spark)), "block").mapInArrow(add, "block int, x binary")
    out = [np.zeros(s, np.int64) for s in shape]
    for r in got.collect():  # 2 ** (MAX_BITS + 9) bytes at most
        k, i = divmod(r["block"], BLOCKS)
        np.split(out[k].reshape(-1), BLOCKS)[i][:] = np.frombuffer(r["x"], np.int64)
    return out[0].T, out[1].T


def table_bits(tokens: int) -> int:
    """The feature tables' rows, as a power of two: about twice the root of the tokens."""
    return min(MAX_BITS, max(MIN_BITS, round(np.log2(max(1, tokens)) / 2) + 1))


def train(docs: DataFrame, leaves: Leaves, of_leaf: np.ndarray, rounds: int) -> Model:
    """The model after its updates over all rows of docs."""
    bits = table_bits(int(of_leaf.sum()))
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    seen = summed(docs, chars, bits, leaves, None)
    model = initial(bits, of_leaf, *seen)
    for _ in range(rounds):
        first, second = summed(docs, chars, bits, leaves, model)
        model = Model(bits, moved(model.first, seen[0], first), moved(model.second, seen[1], second), model.bias, model.member_bias)
    return model


_STATS = "bucket int, window long, a binary, b binary, c binary"


def gathered(docs: DataFrame, common: Lookup, buckets: int) -> DataFrame:
    """Written rows: bucket -1 has a task's counts of common words, -2 a window's documents, others packed words.

    docs: doc_id, text, learn. A window is a task's documents until they hold WINDOW other words.
    """
    known = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = known.value
        counts, ends, window = np.zeros(len(lookup.hashes) + 1, np.int64), 0, None
        held: list[tuple] = []
        ids, marks, learns, size = [], [], [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], ["bucket", "window", "a", "b", "c"])

        def flush() -> Iterator[pa.RecordBatch]:
            yield batch_of([(-2, window, pickle.dumps(ids), np.array(marks, np.int64).tobytes(), None)])
            h, doc, tf = (np.concatenate([x[k] for x in held]) for k in range(3))
            learn = np.array(learns, bool)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for at in np.flatnonzero(np.diff(cuts)):
                use = order[cuts[at] : cuts[at + 1]]
                # documents that teach have the low bit
                yield batch_of([(int(at), window, h[use].tobytes(), (doc[use] << 1 | learn[doc[use]]).astype(np.uint32).tobytes(), tf[use].astype(np.uint32).tobytes())])

        for b in batches:
            for part in slices(b):
                if window is None:
                    window = part.column("row")[0].as_py()
                h, n = word_hashes(part.column("text").to_pylist())
                number, text = lookup(h), np.repeat(np.arange(len(n)), n)
                learn = np.array(part.column("learn").to_pylist(), bool)
                counts += np.bincount(number[learn[text] & (number >= 0)], minlength=len(counts))
                ends += int(learn.sum())
                rare = np.flatnonzero(number == -1)
                order = rare[np.lexsort((h[rare], text[rare]))]
                h, doc = h[order], text[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                held.append((h[new], doc[new] + len(ids), np.diff(new, append=len(h))))
                ids += part.column("doc_id").to_pylist()
                marks += part.column("mark").to_pylist()
                learns += learn.tolist()
                size += len(new)
                if size >= WINDOW:
                    yield from flush()
                    held, ids, marks, learns, size, window = [], [], [], [], 0, None
        if ids:
            yield from flush()
        yield batch_of([(-1, 0, counts[:-1].tobytes(), np.array([ends], np.int64).tobytes(), None)])

    rows = docs.select("doc_id", "text", "learn", F.xxhash64("text", F.length("text")).alias("mark"), F.monotonically_increasing_id().alias("row"))
    return written(rows.mapInArrow(run, _STATS))


def _leaf_sums(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and kinds of words in the leaves that they share."""
    leaf = shared_leaf(h)
    return np.bincount(leaf, c, CLASSES * MEMBERS).astype(np.int64), np.bincount(leaf[c > 0], minlength=CLASSES * MEMBERS).astype(np.int64)


def most_frequent(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places of the KNOWN largest counts above 0, ties to the smaller hash."""
    order = np.lexsort((h, -c))[:KNOWN]
    return order[c[order] > 0]


def _bucket_sums(blocks: list[tuple], out: list[tuple]) -> None:
    """Counts of one bucket's words, in sums for each window's documents; and what its words add to the leaves."""
    h = np.concatenate([np.frombuffer(x[1], np.uint64) for x in blocks])
    doc = [np.frombuffer(x[2], np.uint32) for x in blocks]
    tf = [np.frombuffer(x[3], np.uint32) for x in blocks]
    kinds, same = np.unique(h, return_inverse=True)
    learn = (np.concatenate(doc) & 1).astype(bool)
    c = np.bincount(same[learn], np.concatenate(tf)[learn], len(kinds)).astype(np.int64)
    of_leaf, of_kinds = _leaf_sums(kinds, c)
    top = most_frequent(kinds, c)
    out.append((-1, of_leaf.tobytes(), of_kinds.tobytes(), b""))
    out.append((-2, kinds[top].tobytes(), c[top].tobytes(), b""))
    logs, at = np.log10(c + 0.5), 0
    for x, d, n in zip(blocks, doc, tf, strict=True):
        use, index = np.unique(d >> 1, return_inverse=True)
        mine = same[at : at + len(d)]
        at += len(d)
        out.append((x[0], use.tobytes(), np.bincount(index, n * logs[mine], len(use)).tobytes(), np.bincount(index, n * (c[mine] > 0), len(use)).astype(np.int64).tobytes()))


def rare_sums(stats: DataFrame, buckets: int) -> DataFrame:
    """window, docs, sums of log10(count + 0.5), known tokens; windows -1 and -2 hold leaves and frequent words; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        def done() -> pa.RecordBatch:
            out: list[tuple] = []
            _bucket_sums(held, out)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.binary()) for k in range(4)], ["window", "docs", "sums", "known"])

        for b in batches:
            for bucket, *rest in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if bucket != now and held:
                    yield done()
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield done()

    rows = stats.filter("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket", "window")
    return written(rows.mapInArrow(run, "window long, docs binary, sums binary, known binary"))


def by_document(stats: DataFrame, sums: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), rare_sum, rare_known: every window's parts are added up as they come."""
    parts = sums.filter("window >= 0").select("window", F.lit(1).alias("kind"), F.col("docs").alias("a"), F.col("sums").alias("b"), F.col("known").alias("c"))
    heads = stats.filter("bucket = -2").select("window", F.lit(0).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = marks = total = known = None
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int64()), "rare_sum": pa.array(total), "rare_known": pa.array(known, pa.int64())})

        for t in batches:
            for _, kind, a, b, c in zip(*(t.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    if ids is not None:
                        yield done()
                    ids, marks = pickle.loads(a), np.frombuffer(b, np.int64)
                    total, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                else:
                    at = np.frombuffer(a, np.uint32)
                    total[at] += np.frombuffer(b)
                    known[at] += np.frombuffer(c, np.int64)
        if ids is not None:
            yield done()

    rows = heads.unionByName(parts).repartition(workers(stats.sparkSession), "window").sortWithinPartitions("window", "kind", F.xxhash64("a", "b"))
    out = rows.mapInArrow(run, "doc_id long, mark long, rare_sum double, rare_known long")
    return out.groupBy("doc_id", "mark").agg(F.max("rare_sum").alias("rare_sum"), F.max("rare_known").alias("rare_known"))


def _sum_vectors(df: DataFrame, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Element-wise sums of two columns of packed whole numbers; folded in each partition before they are sent."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for t in batches:
            for row in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                x = [np.frombuffer(v, np.int64) for v in row]
                sums = x if sums is None else [p + q for p, q in zip(sums, x, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"a": pa.array([sums[0].tobytes()], pa.binary()), "b": pa.array([sums[1].tobytes()], pa.binary())})

    few = df.select(a, b).mapInArrow(fold, "a binary, b binary").repartition(8).mapInArrow(fold, "a binary, b binary")
    got = [[np.frombuffer(r[k], np.int64) for k in "ab"] for r in few.collect()]
    return (sum(x[0] for x in got), sum(x[1] for x in got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _frequent(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the KNOWN most frequent words of all buckets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for h, c in zip(t.column(0), t.column(1), strict=True):
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.frombuffer(h.as_py(), np.int64)), "c": pa.array(np.frombuffer(c.as_py(), np.int64))})

    order = [F.desc("c"), F.col("h") < 0, F.col("h")]  # unsigned order
    got = sums.filter("window = -2").select("docs", "sums").mapInArrow(rows, "h long, c long").orderBy(*order).limit(KNOWN).collect()
    return np.array([r["h"] for r in got], np.int64).view(np.uint64), np.array([r["c"] for r in got], np.int64)


def score(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", (fold_of("doc_id", 5) == 1).alias("held_out"))
    learn = base.filter(~F.col("held_out"))
    common = common_words(learn)
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(workers(spark), int(chars) // 16_000_000)
    stats = gathered(base.withColumn("learn", ~F.col("held_out")), common, buckets)
    counts, ends = _sum_vectors(stats.filter("bucket = -1"), "a", "b")
    counts, ends = counts if len(counts) else np.zeros(len(common.hashes), np.int64), int(ends[0]) if len(ends) else 0
    sums = rare_sums(stats, buckets)
    of_leaf, kinds = (x if len(x) else np.zeros(CLASSES * MEMBERS, np.int64) for x in _sum_vectors(sums.filter("window = -1"), "docs", "sums"))
    more, more_kinds = _leaf_sums(common.hashes, counts)
    of_leaf, kinds = of_leaf + more, kinds + more_kinds
    total, distinct = int(of_leaf.sum()) + ends, int(kinds.sum()) + (ends > 0)
    # words with leaves of their own leave those that they would share
    h, c = (np.concatenate(x) for x in zip((common.hashes, counts), _frequent(sums), strict=True))
    top = most_frequent(h, c)
    h, c = h[top], c[top]
    less, less_kinds = _leaf_sums(h, c)
    of_leaf, kinds = of_leaf - less, kinds - less_kinds
    of_leaf[Leaves.of_rank(np.arange(1, len(h) + 1))] = c
    of_leaf[0] = ends
    leaves = Leaves(h)
    model = train(learn, leaves, of_leaf, rounds)
    shared = np.arange(CLASSES * MEMBERS) % MEMBERS >= OWN
    below = np.where(shared, np.log10(of_leaf + 0.5 * (kinds + 1)), 0.0)
    sent = spark.sparkContext.broadcast((common, counts, ends, leaves, np.concatenate([np.log10(c + 0.5), [0.0]]), below, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, ends, leaves, own, below, model = sent.value
        value, known = np.concatenate([np.log10(counts + 0.5), [0.0]]), np.concatenate([counts > 0, [False]])
        for t in batches:
            for part in slices(t):
                h, end, n = tokens_of(part.column("text").to_pylist())
                leaf, number = leaves(h)
                leaf, number = np.where(end, 0, leaf), np.where(end, -1, number)
                at = np.where(end, -1, common(h))
                lp = model.log_score(features(h, n), leaf) / np.log(10) - below[leaf] - own[number]
                start = np.cumsum(n) - n
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "mark": part.column("mark"), "held_out": part.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
                    "n_known": pa.array(np.add.reduceat(known[at].astype(np.int64), start) + (ends > 0), pa.int64()),
                    "sum": pa.array(np.add.reduceat(value[at], start)), "model": pa.array(np.add.reduceat(lp, start)),
                })

    scored = base.withColumn("mark", F.xxhash64("text", F.length("text"))).mapInArrow(run, "doc_id long, mark long, held_out boolean, n_tokens long, n_known long, sum double, model double")
    rare = by_document(stats, sums)
    both = scored.join(rare, scored["doc_id"].eqNullSafe(rare["doc_id"]) & scored["mark"].eqNullSafe(rare["mark"]), "left")
    words = F.col("sum") + F.coalesce("rare_sum", F.lit(0.0))
    return both.select(
        scored["doc_id"], "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (words + float(np.log10(ends + 0.5)) - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"), (words + F.col("model")).alias("score"),
    )
