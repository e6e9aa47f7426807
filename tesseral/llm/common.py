"""Shared helpers: tables in the cluster's shared folder, Arrow access, token hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tesseral-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written under the shared folder, to cut lineage and to survive lost executors.

    `drop` deletes a table as soon as nothing reads it any more; the rest goes
    when the driver ends, as a lazy result may still read it, or at the end of
    a `released` block.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch._open.append(self)
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone when the driver ends
            pass


@contextmanager
def released() -> Iterator[None]:
    """Deletes at its end what was written by operators called inside; their results must have been written or collected by then."""
    before = len(Scratch._open)
    try:
        yield
    finally:
        for scratch in Scratch._open[before:]:
            atexit.unregister(scratch.close)
            scratch.close()
        del Scratch._open[before:]


#: Rows of a few numbers that a join may send to all tasks.
SMALL_ROWS = 250_000


def small(df: DataFrame, most: int = 0) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (SMALL_ROWS unless told), which is counted; else it is left to a shuffle."""
    most = most or SMALL_ROWS
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_key(text: Column) -> Column:
    """Beside its id, what tells a row from another of the same id: a hash of its text."""
    return F.xxhash64(text)


def fill(column: pa.Array) -> pa.Array:
    """A string column with null as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows, from 0."""
    column = fill(column)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes, one row at least."""
    _, offsets = raw_bytes(batch.column(text))
    start = 0
    while start < len(batch):
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(batch))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Bytes that are hashed at a time; the working arrays are some fifty times as large.
HASHED_AT_ONCE = 1 << 20


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end); ranges ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    until = np.cumsum(lengths)
    table = stream64(256, seed)
    first = 0
    while first < len(starts):
        done = until[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(until, done + HASHED_AT_ONCE, side="right")))
        out[first:last] = _sums(data, starts[first:last], lengths[first:last], table)
        first = last
    return mix64(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of each range's bytes, by a table, times powers of their places."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inner = np.arange(total) - np.repeat(first, lengths)
    power = np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    terms = table[data[np.repeat(starts, lengths) + inner]] * power[inner]
    full = lengths > 0
    out = np.zeros(len(starts), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(terms, first[full])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space) and, for each row, the first word's index."""
    breaks = np.zeros(256, bool)
    breaks[list(WORD_BREAKS)] = True
    inside = ~breaks[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles, A-Z lower-cased.

    A text of fewer than k words has its whole sequence as one; one without words has none.
    """
    data, offsets = raw_bytes(texts)
    data = lower_table()[data]
    starts, ends, at = words_of(data, offsets)
    words = segment_hashes(data, starts, ends)
    weights = stream64(k, 99) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n] * weights[j]
    grams = mix64(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            part = words[a:b] * weights[: b - a]
            yield mix64(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield grams[:0]
