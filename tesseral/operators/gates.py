"""Threshold gates over tables of codec results."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, research
from .tensors import few


def baselines(tensors: DataFrame) -> DataFrame:
    """(tensor_id, n, raw_bytes, exact_bytes, container_bytes, zstd_bytes, lz4_bytes, strategy, exact_bits).

    zstd is a stream of level 3 without the content's size, lz4 this machine's raw
    block format behind a 4-byte length, which need not be as long as another library's.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = codec.encode_exact(raw)
                stream = zstandard.ZstdCompressor(level=3, write_content_size=False).compressobj()
                plain = len(stream.compress(raw)) + len(stream.flush())
                lz4 = len(pa.Codec("lz4_raw").compress(raw, asbytes=True)) + 4
                same = codec.decode_exact(payload)[0] == raw
                rows.append((name, len(raw) // 4, len(raw), len(payload), len(codec.container([payload])), plain, lz4, codec.describe(payload)[1], same))
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.bool_()]
            names = ["tensor_id", "n", "raw_bytes", "exact_bytes", "container_bytes", "zstd_bytes", "lz4_bytes", "strategy", "exact_bits"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "tensor_id string, n long, raw_bytes long, exact_bytes long, container_bytes long, zstd_bytes long, lz4_bytes long, strategy string, exact_bits boolean"
    return tensors.select("tensor_id", "payload").mapInArrow(measure, schema)


def predictor_sizes(tensors: DataFrame, *, stride: int) -> DataFrame:
    """(tensor_id, chunk_id, candidate, bytes, selected): f32 chunks as f16 words through each measured predictor; selected is the smallest."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, chunk, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with np.errstate(over="ignore"):
                    words = np.frombuffer(raw, "<f4").astype(np.float16).view(np.uint16)
                found = research.sizes(words, "f16", max(1, len(words)), stride)
                best = min(found, key=found.get)
                rows += [(name, chunk, k, n, k == best) for k, n in found.items()]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["tensor_id", "chunk_id", "candidate", "bytes", "selected"])

    return tensors.select("tensor_id", "chunk_id", "payload").mapInArrow(measure, "tensor_id string, chunk_id long, candidate string, bytes long, selected boolean")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 1 for nothing."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def competitive(tensors: DataFrame) -> DataFrame:
    """The baselines with `passed`: exact, and no longer than the best general compressor unless the tensor is kept raw."""
    found = baselines(tensors)
    fits = (F.col("strategy") == "raw-bits") | (F.col("exact_bytes") <= F.least("zstd_bytes", "lz4_bytes"))
    return found.withColumn("ratio", F.round(ratio("exact_bytes", "raw_bytes"), 6)).withColumn("passed", F.col("exact_bits") & fits)


def limited(results: DataFrame, *, max_ratio: float | None = None, max_encode_us: float | None = None, max_decode_us: float | None = None, max_ns_per_value: float | None = None, policy: str = "custom") -> DataFrame:
    """results (exact_bits, strategy, ratio, encode_us, decode_us, n) with `passed` under limits; exactness is always required.

    The policy production-kv needs the limit for each value and no limit in
    microseconds; latency-budget needs one of the latter. Where any row is
    external, only those are judged; tensors kept raw pass every limit.
    """
    timed = max_encode_us is not None or max_decode_us is not None
    if policy == "production-kv" and (max_ns_per_value is None or timed):
        raise ValueError("production-kv takes a limit in ns for each value, and none in us")
    if policy == "latency-budget" and not timed:
        raise ValueError("latency-budget takes a limit in us")
    fits = F.lit(True)
    for name, most in (("ratio", max_ratio), ("encode_us", max_encode_us), ("decode_us", max_decode_us)):
        if most is not None:
            fits = fits & (F.col(name) <= most)
    if max_ns_per_value is not None:
        fits = fits & (F.col("decode_us") * 1000 / F.greatest("n", F.lit(1)) <= max_ns_per_value)
    if "external" in results.columns and not results.where("external").isEmpty():
        results = results.where("external")
    return results.withColumn("passed", F.col("exact_bits") & ((F.col("strategy") == "raw-bits") | fits))


def coverage(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(wanted, found, missing, extra, equal): two tables as sets of keys; nulls are a key like any."""
    left = wanted.select(*keys).distinct().withColumn("_w", F.lit(1))
    right = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*keys).agg(F.max("_w").alias("w"), F.max("_f").alias("f"))
    here, there = F.col("w").isNotNull(), F.col("f").isNotNull()
    counted = both.agg(F.count_if(here).alias("wanted"), F.count_if(there).alias("found"), F.count_if(here & ~there).alias("missing"), F.count_if(there & ~here).alias("extra"))
    return counted.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def payload_sizes(tensors: DataFrame, modes: list[str]) -> DataFrame:
    """(dataset, codec, bytes) of each f32 chunk (dataset, payload) through each mode."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, m, len(codec.encode(np.frombuffer(raw, "<f4"), m))) for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in modes]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], names=["dataset", "codec", "bytes"])

    return tensors.select("dataset", "payload").mapInArrow(measure, "dataset string, codec string, bytes long")


def size_pivot(sizes: DataFrame, modes: list[str]) -> DataFrame:
    """One row for each dataset, with the bytes of each codec in a column of its name."""
    return sizes.groupBy("dataset").pivot("codec", modes).agg(F.sum("bytes"))


def timed(tensors: DataFrame, runs: int = 5) -> DataFrame:
    """(tensor_id, n, strategy, ratio, exact_bits, encode_us, decode_us, decode_ns_per_value): the best of several runs, on one core."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, encode = best(lambda raw=raw: codec.encode_exact(raw))
                (back, _), decode = best(lambda payload=payload: codec.decode_exact(payload))
                n = len(raw) // 4
                rows.append((name, n, codec.describe(payload)[1], len(payload) / len(raw) if raw else 1.0, back == raw, encode, decode, decode * 1000 / max(1, n)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), *[pa.float64()] * 3]
            names = ["tensor_id", "n", "strategy", "ratio", "exact_bits", "encode_us", "decode_us", "decode_ns_per_value"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def best(work):
        least = float("inf")
        for _ in range(max(1, runs)):
            start = time.perf_counter()
            out = work()
            least = min(least, (time.perf_counter() - start) * 1e6)
        return out, least

    schema = "tensor_id string, n long, strategy string, ratio double, exact_bits boolean, encode_us double, decode_us double, decode_ns_per_value double"
    return tensors.select("tensor_id", "payload").mapInArrow(measure, schema)


def rolled_up(sizes: DataFrame) -> DataFrame:
    """(candidate, chunks, bytes, selected, best_bytes): each candidate of predictor_sizes, how often it is the smallest and what that gives."""
    by = sizes.groupBy("candidate")
    return by.agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.count_if("selected").alias("selected"), F.sum(F.when(F.col("selected"), F.col("bytes")).otherwise(0)).alias("best_bytes"))
