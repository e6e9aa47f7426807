"""Substring deduplication: content-defined chunks by a gear rolling hash, equal chunks found by digest.

A gear hash (Xia et al. 2014) moves on by one shift and one addition for each
byte, so a cut depends on the last WINDOW bytes only: after an insertion the
cuts fall where they fell before. Passages are runs of repeated chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, raw_bytes, row_key, segment_hashes, slices, stream64

#: Bytes that a cut depends on; a power of 2.
WINDOW = 16
#: A cut is where so many bits of the hash are 0: every 32 bytes on average.
MASK_BITS = 5
LEAST, MOST = 16, 256
#: A run of repeated chunks is a passage from so many bytes.
PASSAGE = 128


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Whether a chunk may end after each byte, by the hash alone."""
    h = (stream64(256, 1234) >> np.uint64(32)).astype(np.uint32)[data]
    width = 1
    while width < WINDOW:  # the hash of 2 * width bytes from two of width bytes
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    # the upper bits hold the sum of all WINDOW bytes
    return (h >> np.uint32(WINDOW - 1)) & np.uint32((1 << MASK_BITS) - 1) == 0


def chunk_bounds(data: np.ndarray) -> list[int]:
    """The ends of a text's chunks in bytes of UTF-8; none cuts a character."""
    n = len(data)
    if n == 0:
        return []
    whole = np.ones(n, bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    may = np.flatnonzero(gear_cuts(data) & whole) + 1
    ends, start = [], 0
    for cut in may.tolist():
        while cut - start > MOST:
            start = _forced(whole, start)
            ends.append(start)
        if cut - start >= LEAST:
            ends.append(cut)
            start = cut
    while n - start > MOST:
        start = _forced(whole, start)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _forced(whole: np.ndarray, start: int) -> int:
    end = start + MOST
    while not whole[end - 1]:
        end -= 1
    return end


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            data, offsets = raw_bytes(part.column(1))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            starts, ends, doc, number = [], [], [], []
            for i in range(len(part)):
                own = chunk_bounds(data[offsets[i] : offsets[i + 1]])
                cut = np.array(own, np.int64) + offsets[i]
                starts.append(np.concatenate([offsets[i : i + 1], cut[:-1]])[: len(cut)])
                ends.append(cut)
                doc.append(np.full(len(cut), ids[i]))
                number.append(np.arange(len(cut)))
            starts, ends = np.concatenate(starts), np.concatenate(ends)
            check = (segment_hashes(data, starts, ends, seed=43) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_digests(data, starts, ends)), pa.array(check), pa.array(np.concatenate(doc)), pa.array(np.concatenate(number).astype(np.int32))],
                names=["digest", "check", "doc_id", "chunk"],
            )


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return segment_hashes(data, starts, ends, seed=41).view(np.int64)


def _spans(text: pa.Array, marked: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, bool]]]]:
    """For each text its number of chunks and its passages (start, end, chunks, goes) in bytes.

    marked: (digest, nth) of the id's repeated chunks, nth the chunk that stays
    if it is this id's; a passage is a run of repeated chunks that all go or all stay.
    """
    data, offsets = raw_bytes(text)
    for i, own in enumerate(marked.to_pylist()):
        ends = chunk_bounds(data[offsets[i] : offsets[i + 1]])
        found: list[list] = []
        if own:
            stays = {x["digest"]: x["nth"] for x in own}
            cut = np.array([0, *ends], np.int64) + offsets[i]
            digests = _digests(data, cut[:-1], cut[1:])
            again = np.isin(digests, np.fromiter(stays, np.int64, len(stays)))
            for k in np.flatnonzero(again).tolist():
                start, goes = ends[k - 1] if k else 0, stays[int(digests[k])] != k
                if found and found[-1][1] == start and found[-1][3] == goes:
                    found[-1][1], found[-1][2] = ends[k], found[-1][2] + 1
                else:
                    found.append([start, ends[k], 1, goes])
        yield len(ends), [tuple(x) for x in found if x[1] - x[0] >= PASSAGE]


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (doc_id, text) with the digests of the repeated chunks of each id, and which of them stay where."""
    scratch = Scratch(docs.sparkSession, "chunks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = scratch.write(rows.where("doc_id is not null").mapInArrow(_chunks, "digest long, check int, doc_id long, chunk int"), "chunks")
    groups = chunks.groupBy("digest", "check").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "chunk")).alias("first"))
    groups = groups.where("many > 1").select("digest", "check", F.col("first.doc_id").alias("at"), F.col("first.chunk").alias("nth"))
    groups = scratch.write(groups, "groups")
    nth = F.when(F.col("doc_id") == F.col("at"), F.col("nth")).otherwise(-1)
    repeated = chunks.join(groups, ["digest", "check"]).select("doc_id", "digest", nth.alias("nth"))
    repeated = repeated.groupBy("doc_id").agg(F.collect_set(F.struct("digest", "nth")).alias("marked"))
    return rows.join(repeated, "doc_id", "left")


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chunks, n_bytes, n_repeated, n_removed, removed_bytes, spans) for each row of docs.

    A chunk is repeated when another of the same digest (96 bits) occurs
    anywhere in docs; the first, by doc_id, then place, stays and the others go.
    A passage is a run of repeated chunks, all going or all staying, of at least
    PASSAGE bytes; shorter runs are common words and stay. n_repeated counts the
    chunks of passages, n_removed those that go; spans lists start:end of what
    goes, in bytes of UTF-8, comma-joined. Null and empty texts have no chunk.
    Rows without an id share nothing with any. Rows of one id are met each by its
    own text; where several of them hold the first place of a chunk, it stays in each.
    Other columns are ignored.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = list(_spans(part.column(1), part.column(2)))
                size = np.diff(raw_bytes(part.column(1))[1])
                gone = [[x for x in spans if x[3]] for _, spans in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([sum(x[2] for x in spans) for _, spans in found], pa.int64()),
                        pa.array([sum(x[2] for x in g) for g in gone], pa.int64()),
                        pa.array([sum(x[1] - x[0] for x in g) for g in gone], pa.int64()),
                        pa.array([",".join(f"{a}:{b}" for a, b, _, _ in g) for g in gone], pa.string()),
                    ],
                    names=["doc_id", "n_chunks", "n_bytes", "n_repeated", "n_removed", "removed_bytes", "spans"],
                )

    marked = _marked(docs, id_col, text_col).select("doc_id", "text", "marked")
    return marked.mapInArrow(
        summarise, "doc_id long, n_chunks long, n_bytes long, n_repeated long, n_removed long, removed_bytes long, spans string"
    )


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every passage left at its first occurrence only; null texts stay null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                texts = []
                for text, (_, spans) in zip(part.column(1).to_pylist(), _spans(part.column(1), part.column(2)), strict=True):
                    raw, parts, end = (text or "").encode(), [], 0
                    for a, b, _, goes in spans:
                        if goes:
                            parts.append(raw[end:a])
                            end = b
                    texts.append(None if text is None else b"".join([*parts, raw[end:]]).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(texts, pa.string())], names=["_cut_id", "_cut_row", "_cut_text"])

    marked = _marked(docs, id_col, text_col).select("doc_id", "text", "marked")
    new = marked.where("marked is not null").withColumn("row", row_key(F.col("text"))).select("doc_id", "text", "marked", "row")
    new = new.dropDuplicates(["doc_id", "row"]).mapInArrow(cut, "_cut_id long, _cut_row long, _cut_text string")
    same = (docs[id_col].cast("long") == new["_cut_id"]) & (row_key(docs[text_col].cast("string")) == new["_cut_row"])
    joined = docs.join(new, same, "left")
    text = F.coalesce(new["_cut_text"], docs[text_col])
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
