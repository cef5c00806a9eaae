"""What the operators of this subpackage share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(f"[^{SPACE}]+")


#: Bytes of an Arrow batch that goes to a Python worker; a batch is held several times over on either side.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, as texts may be long; a smaller bound stays."""
    now = spark.conf.get(BATCH_KEY, None)
    if now is None or not now.rstrip("bB").isdecimal() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stacksift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; else they stay until its driver
    happens to collect its garbage."""
    for _ in range(2):  # Python's side lets go in a thread of its own
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 256, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and characters (bytes of a binary column) but for one longer value."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values) if pa.types.is_binary(values.type) else pc.utf8_length(values), 0).to_pylist()
    at = 0
    while at < batch.num_rows:
        n, total = 1, sizes[at]
        while n < rows and at + n < batch.num_rows and total + sizes[at + n] <= chars:
            total += sizes[at + n]
            n += 1
        yield batch.slice(at, n)
        at += n


_Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return free memory of this process to the system, which its allocators would keep for later."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: _Run) -> _Run:
    """run, after which its worker gives back what it doesn't need: workers wait for later tasks beside the JVM."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def workers(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[0] = (out[0], out[1])
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


#: Bytes hashed at once, so that the arrays stay in the processor's cache; one longer text makes one longer slice.
SLICE = 1 << 19


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in turn, and the number of words of each text.

    Null texts have no words; with lower, A-Z count as a-z.
    """
    return word_codes(texts, lower)[:2]


def word_codes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and the last two bytes of every word as one number."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, counts, tails, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], 0
    while at < len(raw):
        size, to = len(raw[at]), at + 1
        while to < len(raw) and size + len(raw[to]) <= SLICE:
            size, to = size + len(raw[to]), to + 1
        for out, x in zip((hashes, counts, tails), _hash_slice(raw[at:to], lower), strict=True):
            out.append(x)
        at = to
    return np.concatenate(hashes), np.concatenate(counts), np.concatenate(tails)


def _hash_slice(raw: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass of numpy over the bytes: a prefix sum of bytes times falling powers gives every word's polynomial."""
    buf = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    edge = np.diff(_IS_SPACE[buf].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64), np.zeros(0, np.uint16)
    if lower:
        buf = buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * down, out=total[1:])
        hashes = mix((total[end] - total[start]) * up[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([1] + [len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(start, begins)), buf[end - 1].astype(np.uint16) << np.uint16(8) | buf[end - 2]
