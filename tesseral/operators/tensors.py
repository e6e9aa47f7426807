"""Tensors as rows: words, planes, residuals, and the codec over whole tables.

A tensor's chunk is one row with its little-endian bytes; exact work never
leaves those bytes, as a float column may lose NaN payloads on its way. Windows
are over one chunk, so a tensor of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec, fnv, lossy

WORD = 1 << 32


def float_words(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys and `word`: the 32 bits of a value rounded to f32, as a number from 0; a null value has no word."""
    kinds = [df.schema[k] for k in keys]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            bits = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint32).astype(np.int64)
            mask = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(bits, mask=mask)], names=[*keys, "word"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", word long"
    return df.select(*keys, F.col(value).cast("double").alias("_v")).mapInArrow(words, schema)


def _before(stride: int, chunk: str, pos: str) -> Column:
    return F.lag("word", stride, 0).over(Window.partitionBy(chunk).orderBy(pos))


def xor_residuals(words: DataFrame, chunk: str, pos: str, stride: int = 1) -> DataFrame:
    """words with `residual`: the XOR with the word `stride` places before; the first ones are as they are."""
    return words.withColumn("residual", F.col("word").bitwiseXOR(_before(stride, chunk, pos)))


def chain_residuals(words: DataFrame, chunk: str, pos: str) -> DataFrame:
    """words with `residual`: the difference to the word before, modulo 2 to the power of 32."""
    return words.withColumn("residual", F.pmod(F.col("word") - _before(1, chunk, pos), F.lit(WORD)))


def xor_restored(residuals: DataFrame, chunk: str, pos: str, stride: int = 1) -> DataFrame:
    """residuals with `restored`: a running XOR along each of `stride` interleaved sequences."""
    place = F.row_number().over(Window.partitionBy(chunk).orderBy(pos)) - 1
    lane = Window.partitionBy(chunk, "_lane").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    laned = residuals.withColumn("_lane", place % stride)
    return laned.withColumn("restored", F.bit_xor("residual").over(lane)).drop("_lane")


def chain_restored(residuals: DataFrame, chunk: str, pos: str) -> DataFrame:
    """residuals with `restored`: a running sum modulo 2 to the power of 32."""
    run = Window.partitionBy(chunk).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return residuals.withColumn("restored", F.pmod(F.sum("residual").over(run), F.lit(WORD)))


def lifted_values(keys: DataFrame, values: DataFrame, on: list[str], how: str = "xor") -> DataFrame:
    """on, word, lifted: key words beside value words less them, position by position; how is xor or sub."""
    both = keys.select(*on, "word").join(values.select(*on, F.col("word").alias("_v")), on)
    lifted = F.col("_v").bitwiseXOR(F.col("word")) if how == "xor" else F.pmod(F.col("_v") - F.col("word"), F.lit(WORD))
    return both.select(*on, "word", lifted.alias("lifted"))


def restored_values(lifted: DataFrame, on: list[str], how: str = "xor") -> DataFrame:
    """on, word: the value words of lifted_values."""
    value = F.col("lifted").bitwiseXOR(F.col("word")) if how == "xor" else F.pmod(F.col("lifted") + F.col("word"), F.lit(WORD))
    return lifted.select(*on, value.alias("word"))


def concatenated(chunks: DataFrame) -> DataFrame:
    """(tensor_id, dtype, payload): decoded chunks put together in their order. A tensor is gathered in one task, so it must fit there."""
    parts = chunks.groupBy("tensor_id", "dtype").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "payload"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(x["payload"] for x in parts.as_py()) for parts in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["tensor_id", "dtype", "payload"])

    return parts.mapInArrow(join, "tensor_id string, dtype string, payload binary")


def byte_planes(words: DataFrame, column: str = "word") -> DataFrame:
    """A row (plane, byte) for each of the four bytes of a word, the highest first."""
    planes = F.array(*[F.struct(F.lit(k).alias("plane"), F.shiftright(column, 24 - 8 * k).bitwiseAND(F.lit(255)).alias("byte")) for k in range(4)])
    return words.withColumn("_p", F.explode(planes)).select("*", "_p.plane", "_p.byte").drop("_p")


def run_islands(planes: DataFrame, chunk: str, pos: str) -> DataFrame:
    """(chunk, plane, byte, length): the runs of equal bytes in each plane of each chunk, one row each."""
    order = Window.partitionBy(chunk, "plane").orderBy(pos)
    starts = planes.withColumn("_new", (F.lag("byte", 1, -1).over(order) != F.col("byte")).cast("int"))
    islands = starts.withColumn("_run", F.sum("_new").over(order))
    return islands.groupBy(chunk, "plane", "_run", "byte").agg(F.count("*").alias("length")).drop("_run")


def quantize_i4(values: DataFrame, chunk: str, value: str = "value") -> DataFrame:
    """values with `scale`, `level` and `decoded`: four-bit levels by the chunk's largest magnitude; halves away from zero.

    Single precision throughout; what isn't finite is level 0.
    """
    x = F.col(value).cast("float")
    real = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    most = F.max(F.abs(real)).over(Window.partitionBy(chunk))
    scale = F.when(most > 0, (most / F.lit(7.0)).cast("float")).otherwise(F.lit(1.0).cast("float"))
    out = values.withColumn("scale", scale)
    level = F.coalesce(F.round((real / F.col("scale")).cast("float").cast("double")), F.lit(0.0))
    out = out.withColumn("level", F.least(F.greatest(level, F.lit(-7.0)), F.lit(7.0)).cast("int"))
    return out.withColumn("decoded", (F.col("level").cast("float") * F.col("scale")).cast("float"))


# The codec over tables of chunks (tensor_id, chunk_id, dtype, payload).

ENCODED = "tensor_id string, chunk_id long, dtype string, n long, raw_bytes long, strategy string, storage string, encoded binary"


def encode_chunks(chunks: DataFrame, stride: int | None = None) -> DataFrame:
    """Each chunk's exact payload, with its strategy; storage tells chunks that are better kept raw."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dtype, raw = batch.column(2).to_pylist(), [x or b"" for x in batch.column(3).to_pylist()]
            known = fnv.fnv1a64_many([codec.big_endian(r, t).tobytes() if t == "f32" else r for r, t in zip(raw, dtype, strict=True)])
            out = [codec.encode_exact(r, t, stride if t != "f32" else None, c) for r, t, c in zip(raw, dtype, known, strict=True)]
            names = [codec.STRATEGIES[p[codec.HEADER + 4]] for p in out]
            storage = ["raw-f32le-pass-through" if s == "raw-bits" else "compressed" for s in names]
            columns = [pa.array([len(r) // codec.WIDTHS[t] for r, t in zip(raw, dtype, strict=True)], pa.int64()), pa.array([len(r) for r in raw], pa.int64())]
            columns += [pa.array(names), pa.array(storage), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["tensor_id", "chunk_id", "dtype", "n", "raw_bytes", "strategy", "storage", "encoded"])

    return chunks.select(F.col("tensor_id").cast("string"), F.col("chunk_id").cast("long"), "dtype", "payload").mapInArrow(encode, ENCODED)


def decode_chunks(encoded: DataFrame) -> DataFrame:
    """(tensor_id, chunk_id, dtype, payload) of exact payloads; raises on any that isn't valid."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec.decode_exact(p, check=False) for p in batch.column(2).to_pylist()]
            marks = fnv.fnv1a64_many([codec.big_endian(d, t).tobytes() if t == "f32" else d for d, t in found])
            for p, mark in zip(batch.column(2).to_pylist(), marks, strict=True):
                if codec.read_header(p).checksum != mark:
                    raise codec.CodecError("the checksum differs")
            columns = [pa.array([t for _, t in found], pa.string()), pa.array([d for d, _ in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["tensor_id", "chunk_id", "dtype", "payload"])

    return encoded.select("tensor_id", "chunk_id", "encoded").mapInArrow(decode, "tensor_id string, chunk_id long, dtype string, payload binary")


def strategy_of(encoded: Column) -> Column:
    """A payload's strategy, read from its prefix without decoding."""
    names = F.array(*map(F.lit, codec.STRATEGIES))
    number = F.conv(F.hex(F.substring(encoded, codec.HEADER + 5, 1)), 16, 10).cast("int")
    return F.get(names, number)


def codec_errors(tensors: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """(tensor_id, codec, n, encoded_bytes, exact, max_abs, rmse): each f32 tensor through each codec."""
    modes = modes or [*codec.MODES, "fp8-e4m3"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw or b"", "<f4")
                for mode in modes:
                    size = len(x) if mode == "fp8-e4m3" else 0
                    if mode == "fp8-e4m3":
                        y = lossy.eight_bit(x)
                    else:
                        payload = codec.encode(x, mode)
                        size, y = len(payload), codec.decode(payload)
                    with np.errstate(invalid="ignore"):
                        error = (x - y).astype(np.float32)
                    seen = np.abs(error[~np.isnan(error)])
                    rmse = float(np.sqrt(np.mean(error.astype(np.float64) ** 2))) if len(x) else 0.0
                    out.append((name, mode, len(x), size, x.tobytes() == np.asarray(y, "<f4").tobytes(), float(seen.max(initial=0)), rmse))
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["tensor_id", "codec", "n", "encoded_bytes", "exact", "max_abs", "rmse"])

    schema = "tensor_id string, codec string, n long, encoded_bytes long, exact boolean, max_abs double, rmse double"
    return tensors.select(F.col("tensor_id").cast("string"), "payload").mapInArrow(measure, schema)


#: Chunks that a task turns into Python objects together.
CHUNKS_AT_ONCE = 32


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, CHUNKS_AT_ONCE to a batch, so what is made of them doesn't grow with a task's share."""
    for batch in batches:
        for start in range(0, len(batch), CHUNKS_AT_ONCE):
            yield batch.slice(start, CHUNKS_AT_ONCE)


def float_chunks(df: DataFrame, chunk: str, pos: str, value: str) -> DataFrame:
    """(tensor_id, chunk_id, dtype, payload): the values of each chunk in the order of pos as f32 bytes.

    A chunk is gathered in one task, so its size must be bounded.
    """
    rows = df.select(F.col(chunk).alias("chunk_id"), F.struct(pos, F.col(value).cast("float").alias("v")).alias("x"))
    gathered = rows.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("values"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            raw = [v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() for v in batch.column(1)]
            n = len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(["t"] * n), batch.column(0).cast(pa.int64()), pa.array(["f32"] * n), pa.array(raw, pa.binary())], names=["tensor_id", "chunk_id", "dtype", "payload"])

    return gathered.mapInArrow(pack, "tensor_id string, chunk_id long, dtype string, payload binary")
