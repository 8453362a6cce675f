"""Shared plumbing: reading tables, materialising in the cluster's shared folder, vectorised word scanning.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. The scanners work on the raw UTF-8 buffer of an Arrow string column, so
a batch is split and hashed with a handful of numpy passes and no Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are scanned at once; a longer document is scanned alone.
BLOCK_BYTES = 1 << 20
#: Bytes from which a span is hashed alone.
LONG_SPAN = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------------------------- shared folder


_roots: list[str] = []


def clean(spark: SparkSession) -> None:
    """Remove all scratch tables of this process; results that were not written elsewhere are gone then."""
    while _roots:
        remove(spark, _roots.pop())


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one once nothing reads it any more, ``clean`` all.

    Results are lazy and read these tables, so they stay until the caller, who knows when a result is written, cleans up.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lorebase/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        _roots.append(self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            remove(self.spark, df._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --------------------------------------------------------------------------------------------- workers


#: Texts that travel to a worker at once.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session send whole texts in batches that a worker, and the executor's buffers beside its heap, hold easily.

    Spark's default of 10,000 rows is made for narrow rows; a smaller setting of the session stays.
    """
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on from stage to stage beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shrink(spark: SparkSession) -> None:
    """Let executors return the heap that earlier work has left empty: it counts beside the workers' memory, and only a full collection gives it back."""
    if not spark.sparkContext.master.startswith("local["):
        n = 2 * spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def frugal(run: Callable) -> Callable:
    """A function over batches that gives its memory back at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


# --------------------------------------------------------------------------------------------- columns


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written in decimal, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


#: A key that stands in more than one of so many rows is hot.
HOT = 1000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], total: int, spread: list[str]) -> DataFrame:
    """``rows`` with the values of ``table`` (one row per key) joined to the left, without a hot key in a shuffle.

    Keys are longs and never null in ``table``. Its column ``n`` counts each key's rows, ``total`` all of them: fewer than
    HOT keys have more than one of HOT rows, and those are broadcast. Rows of theirs take part in the other join under
    a key made of ``spread``, which deals them evenly, and a mark that keeps them from matching there.
    """
    cols = rows.columns
    hot = table.where(F.col("n") * HOT > total).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values])
    cold = table.where(F.col("n") * HOT <= total).select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[F.col(v).alias(f"_tv_{v}") for v in values], F.lit(True).alias("_t_cold"))
    one = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_h_{k}") for k in keys], "left")
    known = F.col(f"_h_{keys[0]}").isNotNull()
    one = one.withColumns({f"_c_{k}": F.when(known, F.xxhash64(*spread)).otherwise(F.col(k)) for k in keys} | {"_cold": ~known})
    both = one.join(cold, [*(F.col(f"_c_{k}") == F.col(f"_t_{k}") for k in keys), F.col("_cold") == F.col("_t_cold")], "left")
    return both.select(*cols, *[F.coalesce(f"_hv_{v}", f"_tv_{v}").alias(v) for v in values])


# --------------------------------------------------------------------------------------------- text scanning

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """b**0 .. b**(n-1) modulo 2**64 for the base (``up``) or its inverse (``down``)."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _B if which == "up" else _B_INV, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK_BYTES:
            _powers[which] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if n else raw[:0], offsets - (offsets[0] if n else 0)


def blocks(buf: np.ndarray, off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into blocks of about ``size`` bytes: (first row, end row, bytes, offsets from the block's start)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row the index of its first word (one entry more)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every span from one prefix sum of a polynomial over the block; equal bytes hash alike anywhere.

    A polynomial modulo 2**64 has known collisions of periodic strings from about 1,000 bytes on, so spans of
    ``LONG_SPAN`` bytes or more are hashed one by one.
    """
    data = (_LOWER[buf] if lower else buf).astype(np.uint64)
    data += np.uint64(1)
    data *= _power("up", len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(data, out=total[1:])
    h = total[ends] - total[starts]
    h *= _power("down", len(data) + 1)[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mix64(h)
    for k in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        part = buf[starts[k] : ends[k]]
        h[k] = xxhash.xxh3_64_intdigest((_LOWER[part] if lower else part).tobytes())
    return h


_SHINGLE = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of a block its sorted distinct 5-word shingle hashes; short texts give one hash, empty ones none."""
    starts, ends, ptr = spans(buf, off)
    w = span_hashes(buf, starts, ends, lower=True)
    if len(w) >= 5:
        sh = w[:-4] * _SHINGLE[0]
        for k in range(1, 5):
            sh ^= sh >> np.uint64(29)
            sh += w[k : len(w) - 4 + k] * _SHINGLE[k]
        mix64(sh)
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= 5:
            yield np.unique(sh[a : b - 4])
        elif b > a:
            h = np.array([b - a], np.uint64) * np.uint64(0xA24BAED4963EE407)
            for k in range(a, b):
                h = mix64(h * _SHINGLE[0] + w[k])
            yield h
        else:
            yield np.empty(0, np.uint64)
