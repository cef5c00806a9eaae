"""Token ids in a binary file format with a shared zstandard dictionary.

A file (`Block`) holds the documents of one slice of the corpus in ascending doc_id order:

    magic "TOKB" | version u16 | id width u16 | documents u32 | dictionary's sha256 | index bytes u32 | index | frames

The index is a zstandard frame over, for each document, its frame's length u32 and its number of ids u32; sums of
the lengths give the offsets, so one document is read by decoding its own frame. A frame holds the ids as little-
endian unsigned integers of 2 bytes (4, if the vocabulary needs them), compressed with the dictionary that was
trained on serialised id arrays. Readers refuse a dictionary with another hash.

Blocks are written by Spark's own writer as binary values, one row each, so any store that Spark writes to will
do and a lost executor's block is written again. The dictionary lies beside them with its hash, so a folder is all that
a later session needs.

Defined cases: a null text is an empty one (its ids are the end id alone); strings of special tokens in a text are
ordinary text, unless `special_as_text` is False; rows that repeat a doc_id are ordered by a hash of their text; null
doc_ids come first; an empty table gives no blocks; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, workers, written

MAGIC = b"TOKB"
HEAD = struct.Struct("<4sHHI32sI")
#: A run of Latin letters that no other letter follows is a unit of its own; else all up to the next white space.
UNIT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\W\d_])| ?\S++|\s")
LETTERS = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Line ends that the pre-tokenizer takes together.
LINES = re.compile(r"\n\n(?:\s|\Z)")
#: Units of letters that the library is given as one text.
JOINED = 4_000


class Encoder:
    """Whole texts to ids with a byte-level BPE file of the tokenizers library.

    The pre-tokenizer always cuts before a single space, around single line ends and after a run of letters, so
    the ids of a text are those of its units in turn. A unit is given to the library once and kept in a table of about
    `keep` entries; units of a space and letters are given as one text, whose tokens' lengths tell them apart. Texts with
    other white space, or more of it in a run, or with special tokens that count as such, go to the library whole.
    """

    def __init__(self, path: str, keep: int = 1_000_000, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        # a character of a byte-level token is a byte
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(k) for k in vocabulary]
        self.keep, self.known = keep, {}

    def __call__(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        if len(self.known) > self.keep:
            self.known = {}
        units = [UNIT.findall(t) if t else [] for t in texts]
        new = set().union(*units).difference(self.known)
        letters = [u for u in new if LETTERS.fullmatch(u)]
        self.known.update(zip(letters, self._of_letters(letters), strict=True))
        others = list(new.difference(letters))
        self.known.update(zip(others, self._library(others), strict=True))
        # a unit of white space, but for a line end, means a run of it
        self.known.update((u, None) for u in others if u.isspace() and u != "\n")
        out, whole, get = [], [], self.known.__getitem__
        for i, (t, u) in enumerate(zip(texts, units, strict=True)):
            try:
                out.append(b"".join(map(get, u)))
            except TypeError:  # one of them is None
                out.append(b"")
                whole.append(i)
                continue
            if t and ("\n\n" in t and LINES.search(t) or any(x in t for x in self.special)):
                whole.append(i)
        for i, x in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = x
        return [x + tail for x in out]

    def _of_letters(self, units: list[str]) -> list[bytes]:
        parts = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        out: list[bytes] = []
        for part, raw in zip(parts, self._library(["".join(p) for p in parts]), strict=True):
            ends = np.cumsum(self.size[np.frombuffer(raw, self.kind)])
            wanted = np.cumsum([len(u.encode()) for u in part])
            at = np.searchsorted(ends, wanted)
            if at[-1] + 1 != len(ends) or (ends[at] != wanted).any():
                raise ValueError("the pre-tokenizer doesn't cut before a space")
            cuts = ((at + 1) * int(self.kind[2:])).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pack(documents: list[bytes], width: int, dictionary: bytes, level: int = 3) -> bytes:
    """A block of the given serialised id arrays."""
    d = _codec(dictionary)
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
    frames = [c.compress(x) for x in documents]
    index = np.array([(len(f), len(x) // width) for f, x in zip(frames, documents, strict=True)], "<u4").tobytes()
    index = zstandard.ZstdCompressor(level=3).compress(index)
    return HEAD.pack(MAGIC, 1, width, len(documents), dictionary_hash(dictionary), len(index)) + index + b"".join(frames)


class Block:
    """Reads a block; `block[i]` decodes the i-th document alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, width, self.n, digest, size = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of this format")
        if digest != dictionary_hash(dictionary):
            raise ValueError("the block was written with another dictionary")
        self.data, self.kind = data, f"<u{width}"
        index = zstandard.ZstdDecompressor().decompress(data[HEAD.size : HEAD.size + size])
        index = np.frombuffer(index, "<u4").reshape(-1, 2).astype(np.int64)
        self.counts, self.ends = index[:, 1], HEAD.size + size + np.cumsum(index[:, 0])
        self.starts = self.ends - index[:, 0]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        ids = np.frombuffer(self.decompressor.decompress(self.data[self.starts[i] : self.ends[i]], max_output_size=max(1, int(self.counts[i]) * int(self.kind[2:]))), self.kind)
        if len(ids) != self.counts[i]:
            raise ValueError("the index and the frame differ")
        return ids


def train_dictionary(docs: DataFrame, path: str, end: int = 0, windows: int = 2_000, window: int = 1_024, size: int = 65_536) -> bytes:
    """A dictionary of at most `size` bytes, trained on `windows` windows of ids.

    The sample is bounded: documents below a hash threshold are encoded whole and cut into windows, and the windows
    with the smallest hashes are taken. Empty if there is too little to train on.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    n = docs.count()
    if n > windows:
        rows = rows.filter(F.col("h") < int(-(2**63) + 2**64 * windows / n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for t in batches for part in slices(t)):
            ids, hashes = encoder(path)(b.column("text").to_pylist(), end), b.column("h").to_pylist()
            out = [(zlib.crc32(f"{h}:{i}".encode()), x[i : i + 2 * window]) for h, x in zip(hashes, ids, strict=True) for i in range(0, len(x), 2 * window)]
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in out], pa.int64()), "x": pa.array([x for _, x in out], pa.binary())})

    got = rows.mapInArrow(cut, "k long, x binary").orderBy("k", "x").limit(windows).collect()
    samples = [bytes(r["x"]) for r in got]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on
        return b""


def write_blocks(docs: DataFrame, path: str, dictionary: bytes, end: int = 0, block_bytes: int = 1 << 20, folder: str | None = None) -> DataFrame:
    """Encode every row and write blocks in ascending doc_id order, with the dictionary if a folder is named.

    Returns what was written, read again: shard (of the range of ids), block (in the shard), doc_ids, inside (ids of the
    shard's blocks before), n_tokens (of the block), data. A third range key spreads rows that repeat a document, so no
    id fills a task.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = keyed.repartitionByRange(workers(docs.sparkSession), "doc_id", "h", "salt").sortWithinPartitions("doc_id", "h", "salt")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        width = int(run.kind[2:])
        ids: list[int | None] = []
        held: list[bytes] = []
        size, block, shard, inside = 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "inside": pa.array([inside], pa.int64()),
                "n_tokens": pa.array([size // width], pa.int64()), "data": pa.array([pack(held, width, dictionary)], pa.binary()),
            })

        for b in batches:
            for part in slices(b):
                shard = part.column("shard")[0].as_py()
                for key, x in zip(part.column("doc_id").to_pylist(), run(part.column("text").to_pylist(), end), strict=True):
                    ids.append(key)
                    held.append(x)
                    size += len(x)
                    if size >= block_bytes:
                        yield flush()
                        ids, held, size, block, inside = [], [], 0, block + 1, inside + size // width
        if ids:
            yield flush()

    blocks = ranged.mapInArrow(write, "shard int, block int, doc_ids array<long>, inside long, n_tokens long, data binary")
    if not folder:
        return written(blocks)
    spark = docs.sparkSession
    spark.createDataFrame([(dictionary_hash(dictionary), dictionary)], "sha256 binary, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    blocks.write.parquet(f"{folder}/blocks")
    return open_blocks(spark, folder)[0]


def open_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    """The blocks and the dictionary of a folder that write_blocks filled."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if dictionary_hash(dictionary) != bytes(row["sha256"]):
        raise ValueError("the dictionary isn't the one that was written")
    return spark.read.schema("shard int, block int, doc_ids array<long>, inside long, n_tokens long, data binary").parquet(f"{folder}/blocks"), dictionary


def with_starts(blocks: DataFrame) -> DataFrame:
    """blocks with `start`: the ids of all blocks before. Only shards are summed, of which there are as many as shuffle
    partitions; data stays where it is."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(shards), F.col("shard") == F.col("of")).withColumn("start", F.col("base") + F.col("inside")).drop("of", "base")


def read_blocks(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks' bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data, start in zip(b.column("doc_ids"), b.column("data"), b.column("start"), strict=True):
                block = Block(data.as_py(), dictionary)
                n = block.counts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.values, "start": pa.array(start.as_py() + np.cumsum(n) - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(block[i].astype("<u4").tobytes()) for i in range(len(block))], pa.int64()),
                })

    return with_starts(blocks).select("doc_ids", "data", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(blocks: DataFrame, dictionary: bytes, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents, decoding only their frames."""
    wanted = set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data in zip(b.column("doc_ids"), b.column("data"), strict=True):
                at = [i for i, k in enumerate(ids.as_py()) if k in wanted]
                block = Block(data.as_py(), dictionary)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i].as_py() for i in at], pa.int64()), "ids": pa.array([block[i].astype(np.int32) for i in at], pa.list_(pa.int32()))})

    held = F.exists("doc_ids", lambda x: x.isin(*doc_ids)) if doc_ids else F.lit(False)
    return blocks.filter(held).select("doc_ids", "data").mapInArrow(read, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Write all rows of docs as blocks with one dictionary, read them back from their folder and digest them."""
    folder = shared_dir(docs.sparkSession)
    write_blocks(docs, path, train_dictionary(docs, path, end), end, folder=folder)
    return read_blocks(*open_blocks(docs.sparkSession, folder))
