"""Deterministic tensors: the public fixtures and the synthetic controls, by their formulas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

F32 = np.float32
#: Words of the stress fixture (fixed values): signed zeros, infinities, two NaN payloads, ones.
SPECIAL = (0x00000000, 0x80000000, 0x7F800000, 0xFF800000, 0x7FC00001, 0x7FA12345, 0x3F800000, 0xBF800000)


def _congruential(n: int, state: int, stirred: bool) -> np.ndarray:
    """Steps of a linear congruential generator of 32 bits, optionally stirred with the position."""
    out = np.empty(n, np.uint32)
    for i in range(n):
        state = ((state ^ i if stirred else state) * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = state
    return out


def _upper_half(values: np.ndarray) -> np.ndarray:
    return (values.astype(F32).view(np.uint32) & np.uint32(0xFFFF0000)).view(F32)


# The numbers in the generators below are fixed values: the published sizes and checksums depend on them.


def ramp(n: int = 8192) -> np.ndarray:
    state = _congruential(n, 0x51415451, False)
    base = (state >> 16).astype(F32) / F32(65535) * F32(2) - F32(1)
    trend = ((np.arange(n) % 257).astype(F32) - F32(128)) / F32(512)
    return _upper_half(base * F32(0.75) + trend)


def wave(n: int = 16384) -> np.ndarray:
    x = np.arange(n).astype(F32)
    return _upper_half(np.sin(x / F32(37)) * F32(0.5) + np.cos(x / F32(211)) * F32(0.125))


def noisy(n: int = 12288) -> np.ndarray:
    s = _congruential(n, 0x9E3779B9, True)
    return ((s >> 31 << 31) | ((124 + s % 6) << 23) | (s & 0x7FFFFF)).astype(np.uint32).view(F32)


def special(n: int = 4096) -> np.ndarray:
    i = np.arange(n, dtype=np.uint32)
    return (np.array(SPECIAL, np.uint32)[i % len(SPECIAL)] ^ (i & 255)).view(F32)


def smooth_sine(n: int = 16384) -> np.ndarray:
    x = np.arange(n).astype(F32)
    return (np.sin(x * F32(0.03125)) * F32(2.5) + np.cos(x * F32(0.0078125)) * F32(0.75)).astype(F32)


def kv_like(n: int = 16384) -> np.ndarray:
    row, col = (np.arange(n) // 128).astype(F32), (np.arange(n) % 128).astype(F32)
    envelope = F32(1) / (F32(1) + row * F32(0.0009))
    local = np.sin(col * F32(0.113)) * F32(0.9) + np.cos(col * F32(0.017) + row * F32(0.003)) * F32(0.4)
    return ((local + np.sin(row * F32(0.071)) * F32(0.2)) * envelope).astype(F32)


def spiky(n: int = 16384) -> np.ndarray:
    i = np.arange(n)
    spike = np.where(i % 251 == 0, F32(7), np.where(i % 113 == 0, F32(-5.5), F32(0)))
    return (np.sin(i.astype(F32) * F32(0.041)) * F32(0.8) + spike).astype(F32)


def bit_delta(n: int = 16384) -> np.ndarray:
    odd = (np.arange(n, dtype=np.uint32) + 1) % 2 * np.uint32(0x01020304)
    return (np.uint32(0x3F000001) ^ odd).astype(np.uint32).view(F32)


#: name: (group, shape, generator)
TENSORS: dict[str, tuple[str, str, Callable[[], np.ndarray]]] = {
    "bf16-kv-ramp-64x8x16": ("public", "[tokens=64, heads=8, dim=16]", ramp),
    "bf16-kv-wave-128x8x16": ("public", "[tokens=128, heads=8, dim=16]", wave),
    "f32-noisy-pass-through-64x12x16": ("public", "[tokens=64, heads=12, dim=16]", noisy),
    "stress-signed-zero-nan-inf": ("public", "[values=4096]", special),
    "smooth-sine": ("synthetic", "[16384]", smooth_sine),
    "kv-like": ("synthetic", "[128, 128]", kv_like),
    "spiky": ("synthetic", "[16384]", spiky),
    "bit-delta": ("synthetic", "[16384]", bit_delta),
}

SCHEMA = "tensor_id string, grp string, shape string, dtype string, n long, payload binary"


def fixtures(spark: SparkSession) -> DataFrame:
    """One row for each tensor, with its little-endian bytes; each is made in a task of its own."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = [TENSORS[k] for k in names]
            values = [g().astype("<f4") for _, _, g in rows]
            columns = [names, [r[0] for r in rows], [r[1] for r in rows], ["f32"] * len(rows), [len(v) for v in values], [v.tobytes() for v in values]]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tensor_id", "grp", "shape", "dtype", "n", "payload"])

    names = spark.createDataFrame([(k,) for k in TENSORS], "tensor_id string").repartition(len(TENSORS))
    return names.mapInArrow(make, SCHEMA)


#: Elements of a 16-bit fixture, and of its rows (fixed values).
TYPED_N, ROW_WIDTH = 65_536, 128


def typed_words(spark: SparkSession) -> DataFrame:
    """(fixture, pos, word): the 16-bit fixtures of whole numbers, for the gates of neighbours and of strides, as expressions over a range."""
    pos = F.col("pos")
    channel = (pos % ROW_WIDTH) * 101

    def wrapped(x: Column) -> Column:
        return x.bitwiseAND(F.lit(0xFFFF))

    formulas = {
        "repeated-rows": wrapped(F.lit(0x3D00) + channel),
        "drifting-rows": wrapped(F.lit(0x3D00) + channel + F.floor(pos / (ROW_WIDTH * 32))),
        "adjacent-smooth": wrapped(F.lit(0x3D00) + F.floor(pos / 4)),
        "twice-each": wrapped(pos),
    }
    made = F.array(*[F.struct(F.lit(k).alias("fixture"), v.cast("long").alias("word")) for k, v in formulas.items()])
    return spark.range(TYPED_N).withColumnRenamed("id", "pos").select("pos", F.explode(made).alias("x")).select("x.fixture", "pos", "x.word")


def rounded_bf16(values: np.ndarray) -> np.ndarray:
    """The 16-bit words of values, rounded to nearest, ties to even."""
    bits = values.astype(F32).view(np.uint32).astype(np.uint64)
    return ((bits + 0x7FFF + (bits >> np.uint64(16) & np.uint64(1))) >> np.uint64(16)).astype(np.uint16)


def smooth_wave_bf16(n: int = TYPED_N) -> np.ndarray:
    x = np.arange(n).astype(F32)
    return rounded_bf16(np.sin(x / F32(97)) * F32(0.5) + np.cos(x / F32(997)) * F32(0.125))


def slow_ramp_bf16(n: int = TYPED_N) -> np.ndarray:
    return rounded_bf16(F32(-1) + F32(2) * np.arange(n).astype(F32) / F32(n))


def piecewise_kv_bf16(n: int = TYPED_N) -> np.ndarray:
    token, channel = (np.arange(n) // ROW_WIDTH).astype(F32), (np.arange(n) % ROW_WIDTH).astype(F32)
    return rounded_bf16(np.sin(channel / F32(19)) * F32(0.375) + np.cos(token / F32(113)) * F32(0.0625))


def random_words(n: int = TYPED_N, state: int = 0x51415451C0DEF00D) -> np.ndarray:
    """The low halves of a xorshift generator's states."""
    out = np.empty(n, np.uint16)
    for i in range(n):
        state ^= state << 13 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 7
        state ^= state << 17 & 0xFFFFFFFFFFFFFFFF
        out[i] = state & 0xFFFF
    return out
