"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "utf-8"), 256))


class DigestIndex:
    """A table (digest, keep_id) in buckets of digests, each sorted, that lives beyond the session.

    `path` names its folder; opening the same folder again goes on with what is
    in it, and must use the same number of buckets. A bucketed scan gives the
    join its partitioning and needs no shuffle of the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"tesseral_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest the index lacks: a sort-merge anti-join on the buckets."""
        return groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds (digest, keep_id) rows, one sorted file for each bucket."""
        dealt = groups.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs; new digests go into the index.

    Texts are equal when identical after lower-casing A-Z. Of equal new texts the
    row with the largest id stays, unless the index already holds the text: then
    its keep_id is the earlier document's and none of the new rows is kept.
    group_size counts the rows of docs. Null texts count as empty. A row
    without an id only stays, with a null keep_id, where no row of its group has
    one. Ids must be unique; other columns are ignored. An empty table adds nothing.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    digests = scratch.write(rows, "digests")
    groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.write(groups, "groups")
    new = scratch.write(index.unseen(groups), "new")
    index.append(new)
    old = groups.join(new.select("digest"), "digest", "left_anti").select("digest", "group_size")
    known = old.join(index.table(), "digest").select("digest", "keep_id", "group_size")
    named = scratch.write(new.select("digest", "keep_id", "group_size").union(known), "named")
    # both sides are plain scans, so a group that holds a large part of the rows can be split
    out = digests.join(named, "digest")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
