"""Retrieval and inner products on vectors as they are and through lossy codecs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from . import geometry


def packed_signs(vec: Column) -> Column:
    """The sign bits of a vector, 32 to a number."""
    words = F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / 32).cast("int"))
    bit = lambda x: ((x < 0) | F.startswith(x.cast("string"), F.lit("-"))).cast("long")

    def word(w: Column) -> Column:
        part = F.slice(vec, w * 32 + 1, F.lit(32))
        return F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda s, x: s * 2 + bit(x))

    return F.transform(words, word)


def hamming_blocks(unit: DataFrame) -> DataFrame:
    """(group_id, pairs, least, most, total) of the sign bits in which pairs of vectors differ, a row for each pair of blocks of a group."""
    coded = unit.select("group_id", "pos", packed_signs(F.col("vec")).alias("vec"))
    kind = unit.schema["group_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (lp, lv), (rp, rv) = geometry._matrix(batch.column(1), i), geometry._matrix(batch.column(2), i)
                apart = sum(np.bitwise_count(lv[:, None, k] ^ rv[None, :, k]).astype(np.int64) for k in range(lv.shape[1]))
                found = apart[lp[:, None] < rp[None, :]] if batch.column(3)[i].as_py() else apart.reshape(-1)
                if len(found):
                    numbers = [pa.array([int(x)], pa.int64()) for x in (len(found), found.min(), found.max(), found.sum())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *numbers], names=["group_id", "pairs", "least", "most", "total"])

    return geometry.block_pairs(coded).mapInArrow(compare, f"group_id {kind}, pairs long, least long, most long, total long")


def hamming_summary(unit: DataFrame) -> DataFrame:
    """(group_id, pairs, least, most, mean) of the Hamming distances of sign bits between all pairs of a group; no pair is a row."""
    found = hamming_blocks(unit).groupBy("group_id")
    return found.agg(F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most"), (F.sum("total") / F.sum("pairs")).alias("mean"))


def cosine(x: Column, y: Column) -> Column:
    """In double precision; 0 where either is zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = dot(x, x) * dot(y, y)
    return F.when(size == 0, 0.0).otherwise(dot(x, y) / F.sqrt(size))


#: Queries that are searched for together; each lot reads the records once. Queries and records of one product of a task.
QUERIES_AT_ONCE, QUERY_TILE, RECORD_TILE = 10_000, 256, 1_024


def top1(queries: DataFrame, records: DataFrame, skip_same: bool = False) -> DataFrame:
    """(query_id, vec_id, score): for each query (query_id, q) the record (vec_id, vec) of the largest cosine, the first of equals.

    The queries are a stated set and are compared with every record, QUERIES_AT_ONCE
    at a time: a lot's vectors go to every task, which multiplies them with its
    records and keeps its best one for each query. Cosines count as equal to 12 places.
    """
    many = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    out = None
    for lot in range(many):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == lot).select("query_id", "q").collect()  # QUERIES_AT_ONCE of them, about
        found = records.select("vec_id", "vec").mapInArrow(_best_of(rows, skip_same), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    best = F.max(F.struct(F.round("score", 12).alias("score"), (-F.col("vec_id")).alias("less"))).alias("b")
    return out.groupBy("query_id").agg(best).select("query_id", (-F.col("b.less")).alias("vec_id"), F.col("b.score").alias("score"))


def _best_of(rows: list, skip_same: bool):
    ids = np.array([r.query_id for r in rows], np.int64)
    q = np.array([r.q for r in rows], np.float64).reshape(len(rows), -1)
    own = np.sqrt((q * q).sum(axis=1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full(len(ids), -2.0), np.zeros(len(ids), np.int64)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            for start in range(0, len(batch), RECORD_TILE):
                some = batch.slice(start, RECORD_TILE)
                at, part = some.column(0).to_numpy(), some.column(1).flatten().to_numpy().astype(np.float64).reshape(len(some), -1)
                sizes = np.sqrt((part * part).sum(axis=1))
                for first in range(0, len(ids), QUERY_TILE):
                    _improve(best, where, ids, q, own, slice(first, first + QUERY_TILE), at, part, sizes, skip_same)
        seen = best > -2
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(where[seen]), pa.array(best[seen])], names=["query_id", "vec_id", "score"])

    return search


def _improve(best: np.ndarray, where: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, some: slice, at: np.ndarray, part: np.ndarray, sizes: np.ndarray, skip_same: bool) -> None:
    """Puts into best and where, of some queries, the records that are better than what is there."""
    size = own[some, None] * sizes[None, :]
    score = np.round(np.divide(q[some] @ part.T, size, out=np.zeros(size.shape), where=size > 0), 12)
    if skip_same:
        score[ids[some, None] == at[None, :]] = -2.0
    top = score.max(axis=1)
    first = np.where(score == top[:, None], at[None, :], np.iinfo(np.int64).max).min(axis=1)
    wins = (top > best[some]) | ((top == best[some]) & (first < where[some]))
    best[some], where[some] = np.where(wins, top, best[some]), np.where(wins, first, where[some])


def through(records: DataFrame, mode: str) -> DataFrame:
    """records (vec_id, vec) with each vector encoded and decoded, RECORD_TILE at a time."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), RECORD_TILE):
                batch = whole.slice(start, RECORD_TILE)
                found = [codec.decode(codec.encode(v.values.to_numpy(zero_copy_only=False).astype(np.float32), mode)) for v in batch.column(1)]
                vectors = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.array(np.concatenate(found), pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["vec_id", "vec"])

    return records.select("vec_id", "vec").mapInArrow(change, "vec_id long, vec array<float>")


# Fixed values below: the places of the queries, and the numbers in the probes.


def query_places(n: int) -> list[int]:
    """Seven fixed places of n, without repetition."""
    return list(dict.fromkeys([0, min(1, n - 1), n // 4, n // 2, 3 * n // 4, max(0, n - 2), n - 1])) if n else []


def _at_places(records: DataFrame, places: list[int]) -> list[int]:
    """The ids at some places of the order of ids: one range sort, whose partitions are numbered on."""
    wanted = set(places)
    ordered = records.select("vec_id").orderBy("vec_id").rdd.zipWithIndex()
    return sorted(r.vec_id for r, i in ordered.filter(lambda x: x[1] in wanted).collect())


def record_slices(vectors: DataFrame, dimension: int = 16) -> DataFrame:
    """(vec_id, slice, vec): each vector cut into records of `dimension` elements; what is left over at the end is no record."""
    starts = F.sequence(F.lit(0), F.floor(F.size("vec") / dimension).cast("int") - 1)
    cut = F.transform(starts, lambda i: F.slice("vec", i * dimension + 1, F.lit(dimension)))
    return vectors.where(F.size("vec") >= dimension).select("vec_id", F.posexplode(cut).alias("slice", "vec"))


def agreement(records: DataFrame, modes: list[str]) -> DataFrame:
    """(codec, queries, top1_matches, mean_score_delta, max_score_delta) of seven records as queries, against decoded records."""
    n = records.count()
    at = _at_places(records, query_places(n))
    queries = records.where(F.col("vec_id").isin(at)).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    exact = top1(queries, records).select("query_id", F.col("vec_id").alias("best"), F.col("score").alias("exact"))
    out = None
    for mode in modes:
        found = top1(queries, through(records, mode)).join(exact, "query_id")
        delta = F.abs(F.col("score") - F.col("exact"))
        row = found.agg(F.count("*").alias("queries"), F.count_if(F.col("vec_id") == F.col("best")).alias("top1_matches"), F.round(F.avg(delta), 6).alias("mean_score_delta"), F.round(F.max(delta), 6).alias("max_score_delta"))
        row = row.select(F.lit(mode).alias("codec"), "*")
        out = row if out is None else out.union(row)
    return out


def probes(x: np.ndarray) -> list[np.ndarray]:
    """Four queries of a tensor's length, at unit length: itself, alternating signs, two waves, sixteen spikes."""
    n = len(x)
    i = np.arange(n)
    spikes = np.zeros(n, np.float32)
    step = max(1, n // 16)
    spikes[::step] = np.where(np.arange(len(spikes[::step])) % 2 == 0, 1, -1)
    f = i.astype(np.float32)
    waves = np.sin(f * np.float32(0.071)) + np.cos(f * np.float32(0.017)) * np.float32(0.5)
    out = []
    for q in (x, np.where(i % 2 == 0, 1, -1), waves, spikes):
        size = np.sqrt((q.astype(np.float64) ** 2).sum())
        out.append(q.astype(np.float32) if size == 0 else (q.astype(np.float64) / size).astype(np.float32))
    return out


def probe_errors(tensors: DataFrame) -> DataFrame:
    """(tensor_id, estimator, mae, rmse, max_abs): inner products with the probes, estimated from four-bit payloads."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f4")
                x = np.where(np.isfinite(x), x, 0).astype(np.float32)
                rotated, phase1 = codec.encode(x, "turboquant-q4"), codec.decode(codec.encode(x, "phase1-q4"))
                for kind in ("turboquant-q4", "phase1-q4"):
                    got = [float(codec.inner_product(rotated, q) if kind == "turboquant-q4" else np.cumsum(q * phase1, dtype=np.float32)[-1]) for q in probes(x)]
                    want = [float(np.cumsum(q * x, dtype=np.float32)[-1]) for q in probes(x)]
                    e = np.abs(np.array(got) - np.array(want))
                    rows.append((name, kind, float(e.mean()), float(np.sqrt((e * e).mean())), float(e.max())))
            columns = [pa.array([r[k] for r in rows], pa.string() if k < 2 else pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["tensor_id", "estimator", "mae", "rmse", "max_abs"])

    return tensors.select("tensor_id", "payload").mapInArrow(measure, "tensor_id string, estimator string, mae double, rmse double, max_abs double")
