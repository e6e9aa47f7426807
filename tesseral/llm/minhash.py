"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash (Ertl 2017) gives each element one random permutation of the
signature's places, shared over all of them: the element's j-th try lands on
the j-th place of its permutation with a value in [j, j + 1). An element stops
early once j is above the largest value that its document still holds. Places
of one signature are therefore negatively correlated, and an estimate from them
has less variance than MinHash's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, shingle_sets, slices, stream64
from .graph import compared_blocks, grouped_by_buckets

#: Two sets of Jaccard similarity 0.8 share no band of 32 with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS


def _tries(elements: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The j-th random fraction and the j-th random place in [j, PLACES) of each element."""
    r = mix64(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    fraction = (r >> np.uint64(32)).astype(np.float64) / 2**32
    place = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - j) >> np.uint64(32)).astype(np.int64)
    return fraction, place


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A signature of PLACES doubles for each set of 64-bit hashes; an empty set holds infinities.

    All documents take their j-th step together; a document leaves as soon as
    all of its values are below the next j, which is the early stop.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), PLACES), np.inf)
    doc = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.zeros((0, PLACES), np.uint8)
    for j in range(PLACES):
        if len(elements) == 0:
            break
        fraction, place = _tries(elements, j)
        row = np.arange(len(elements))
        landed = place
        if j:
            landed = order[row, place].astype(np.int64)
            order[row, place] = order[row, j]
        np.minimum.at(out.reshape(-1), doc * PLACES + landed, fraction + j)
        stay = (out.max(axis=1) >= j + 1)[doc]
        if not stay.all():
            doc, elements, place, order = doc[stay], elements[stay], place[stay], order[stay[: len(order)]]
        if j == 0:
            row = np.arange(len(elements))
            order = np.broadcast_to(np.arange(PLACES, dtype=np.uint8), (len(elements), PLACES)).copy()
            order[row, 0], order[row, place] = place, 0
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS places."""
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys ^ bits[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(keys ^ stream64(BANDS, 5)[None, :])


def _signer(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            for part in slices(batch, 1, 512 << 10):
                sets = list(shingle_sets(part.column(1), shingle))
                keys = band_keys(super_minhash(sets)).tobytes()
                width = BANDS * 8
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([keys[i * width : i * width + width] if len(s) else None for i, s in enumerate(sets)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return sign


def _setter(shingle: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 512 << 10):
                sets = [s.tobytes() for s in shingle_sets(part.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "members"])

    return gather


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            one, last = None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if last is None or len(last) != len(y) or not np.array_equal(last, y):
                    last, one = y, set(y.tolist())
                small = sum(map(one.__contains__, x.tolist()))
                linked.append(100 * small >= percent * (len(x) + len(y) - small))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keep], names=["a", "b", "linked"])

    return verify


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [x.as_py() for x in batch.column(1)]
        keys = np.frombuffer(b"".join(packed), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys),
                pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
            ],
            names=["key", "rep"],
        )


#: Bytes of sets that are compared with as many others at a time.
BLOCK_BYTES = 192 << 10


def _compared(percent: int):
    """Links between two blocks of sets: for each left set and root of right sets one, if there is any."""

    def block(items: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x["members"], np.uint64) for x in items]
        return sets, np.array([x["rep"] for x in items]), np.array([x["root"] for x in items])

    def incidence(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(common)), np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(common, s)
            at[at == len(common)] = 0
            out[i, at[common[at] == s]] = 1
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                left, left_rep, left_root = block(one.as_py())
                right, right_rep, right_root = block(two.as_py())
                common = np.intersect1d(np.concatenate(left), np.concatenate(right))
                if not len(common):
                    continue
                both = np.rint(incidence(left, common) @ incidence(right, common).T).astype(np.int64)
                sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
                linked = (100 * both >= percent * (sizes - both)) & (left_root[:, None] != right_root[None, :])
                i, j = np.nonzero(linked)
                if len(i):
                    _, first = np.unique(np.stack([i, right_root[j]]), axis=1, return_index=True)
                    a.append(left_rep[i[first]])
                    b.append(right_rep[j[first]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked when 100 * |intersection| >= percent * |union| of their
    shingle sets, and grouped by reachability; the smallest id of a group stays.
    Equal sets collapse to one representative before anything is compared. Each
    bucket of a band is compared with pivots; what is still in different groups
    after that is compared block by block, many sets at a time, so no link is
    lost that a band has found and no pair of documents is a row.

    Null and empty texts have no shingles and are linked with nothing; nor are
    rows without an id, whose component is null and which are kept. Rows of equal
    id count as one document. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = scratch.write(
        rows.mapInArrow(_signer(shingle), "doc_id long, n_shingles long, digest binary, bands binary"), "signed"
    )
    classes = scratch.write(
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = classes.select("rep", "bands").mapInArrow(_exploded, "key long, rep long")
    sets: list[DataFrame] = []

    def prepare(members: DataFrame) -> None:
        wanted = members.select(F.col("rep").alias("doc_id")).distinct()
        texts = rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
        sets.append(scratch.write(texts.mapInArrow(_setter(shingle), "rep long, members binary"), "sets"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets[0].select(F.col("rep").alias("a"), F.col("members").alias("x")), "a")
        full = left.join(sets[0].select(F.col("rep").alias("b"), F.col("members").alias("y")), "b")
        checked = full.select("a", "b", "x", "y").mapInArrow(_verifier(percent), "a long, b long, linked boolean")
        return checked.where("linked").select("a", "b")

    def across(members: DataFrame) -> DataFrame:
        return compared_blocks(members, sets[0], "members", BLOCK_BYTES, _compared(percent), scratch)

    def fits(p: Column, q: Column) -> Column:
        return 100 * F.least(p, q) >= percent * F.greatest(p, q)

    roots = grouped_by_buckets(keys, lambda: classes.select("rep", "n"), prepare, verified, across, fits, scratch)
    whole = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("digest", F.coalesce("root", "rep").alias("component_id"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    spread = F.coalesce(known, F.encode(F.col("doc_id").cast("string"), "utf-8"))  # rows without a set don't meet in one task
    out = signed.select("doc_id", "n_shingles", spread.alias("digest")).join(whole, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, one for each group, with their own columns; rows without an id stay."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("not kept")
    return docs.join(gone.select(F.col("doc_id").alias(id_col)), id_col, "left_anti")


#: For shingles of two words: all pairs that share any, without signatures.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM texts
), shingles AS (
  SELECT doc_id, unnest(s) AS s FROM sets
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT m.a, m.b FROM met m JOIN sets x ON x.doc_id = m.a JOIN sets y ON y.doc_id = m.b WHERE 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM sets LEFT JOIN roots ON a = doc_id
"""
