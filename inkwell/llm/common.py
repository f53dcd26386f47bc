"""Shared pieces: shared-folder writes, Arrow text buffers, vectorised word and shingle hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.storage import fresh_path, shared_dir, stored

__all__ = ["fresh_path", "shared_dir", "stored"]  # used by the operators as from here

# White space that ends a word (the class is [^\x20\x09-\x0D]+).
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_MIX = mix64(_LOWER.astype(np.uint64) + _U(1000))
_BYTE_MIX[~_IS_WORD] = 0
_POS_MIX = mix64(np.arange(4096, dtype=np.uint64)) | _U(1)


#: Narrow rows that one file of a table in between holds, at least.
FILE_ROWS = 50_000


def few(spark: SparkSession, rows: int) -> int:
    """Files for a table of at most so many narrow rows: as many as there are partitions, once each has FILE_ROWS."""
    return max(1, min(partitions(spark), -(-rows // FILE_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text, null as 0, inside the JVM."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0))), F.lit(0)).cast("long")


def bounded_batches(df: DataFrame) -> None:
    """Have texts reach Python in small Arrow batches, so that a worker holds few of them at a time.

    Spark reads these settings when the lazy result runs, so they stay set in the session; smaller values are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


_allocator: dict = {}


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if not _allocator:
        try:
            _allocator["trim"] = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):  # another C library: its allocator decides
            _allocator["trim"] = lambda _: 0
    _allocator["trim"](0)


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (first is 0) of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    _, offs, data = array.buffers()
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    if offs is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 256_000):
    """Cut a batch so that no piece but a single long row holds more than `most` bytes of the column."""
    k = batch.schema.get_field_index(column)
    if batch.num_rows == 0:
        return
    _, offs = buffers(batch.column(k))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word's number of each row (one more at the end)."""
    is_word = _IS_WORD[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = is_word
    before[offsets] = False  # a word never crosses rows
    start = np.flatnonzero(is_word & ~before[:-1])
    after = np.empty(len(raw) + 1, bool)
    after[:-1] = is_word
    after[-1] = False
    after[offsets] = False
    end = np.flatnonzero(is_word & ~after[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.repeat(start, np.diff(np.append(start, len(raw))))
    at = np.arange(start[0], len(raw)) - first
    longest = int((end - start).max())
    weights = _POS_MIX if longest <= len(_POS_MIX) else mix64(np.arange(longest, dtype=np.uint64)) | _U(1)
    with np.errstate(over="ignore"):
        val = _BYTE_MIX[raw[start[0] :]] * weights[np.minimum(at, longest - 1)]
        total = np.add.reduceat(val, start - start[0])
        return mix64(total + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each word, and whether the n words lie in one row. first: as from word_spans."""
    count = len(words)
    grams = np.zeros(count, np.uint64)
    ok = np.zeros(count, bool)
    if count >= n:
        m = count - n + 1
        with np.errstate(over="ignore"):
            for j in range(n):
                grams[:m] += words[j : j + m] * _POS_MIX[j + 7]
        row_end = np.repeat(first[1:], np.diff(first))
        ok = np.arange(count) + n <= row_end
        grams = mix64(grams)
    return grams, ok


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; a row of fewer words has its whole sequence as one, one without words none."""
    start, end, first = word_spans(raw, offsets)
    words = word_hashes(raw, start, end)
    grams, _ = gram_hashes(words, first, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix64(np.array([(words[a:b] * _POS_MIX[7 : 7 + b - a]).sum() + _U(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (df should be stored: it is counted), else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of edges between values of any ordered type: node, root (the least node reachable), by alternating stars.

    Each round hangs every neighbour of a node on the node's least neighbour, first the larger ones,
    then the smaller ones; the rounds grow with the logarithm of the longest path. Minima are merged
    before the shuffle, and hot nodes meet only joins that Spark can split. Each round is written to
    the shared folder, so an executor that goes takes nothing with it.
    """
    spark = edges.sparkSession
    rows = edges.count()  # edges that stand for the same components never become more
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", few(spark, rows))
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star", few(spark, rows))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "small-star", few(spark, rows))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
