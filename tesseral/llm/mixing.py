"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, served again
from the front when it ends. A copy's virtual finish time is the number of its
source's words up to its end divided by the source's target; copies are served
by finish time until the budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: The weights that sources get in their order, repeating.
WEIGHTS = (1, 2, 3)
#: No source gives more than this many times its own words.
REPEATS = 3
#: Documents to a chunk of a source's order, about; a chunk is summed before a source is.
CHUNK = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """A fixed pseudo-random number of 60 bits for a document."""
    text = F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, rank, source_size, target): one row for each source of (source, size) rows.

    All sizes together are shared by weight; a target stops at REPEATS times its
    source's size, and the excess goes to the others by weight until none is
    above. That ends with min(REPEATS * size, level * weight) for one level, which a
    pass over the sources by size to weight finds.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("rank", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    totals = totals.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * REPEATS)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        totals.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.sum("most").over(filling) - F.col("most"))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(filling) + F.col("weight"))
        .withColumn("full", F.col("most") * F.col("open") <= (F.col("total") - F.col("below")) * F.col("weight"))
        .withColumn("taken", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything))
        .withColumn("shares", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(everything))
    )
    level = (F.col("total") - F.col("taken")) * F.col("weight") / F.col("shares")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level)
    return totals.select("source", "rank", "source_size", target.cast("double").alias("target"))


def schedule(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, finish) for each row of docs.

    size counts the words; taken is the number of the document's words that the
    mix takes, repeats counted; finish is the virtual finish time of its first
    copy. The budget is the words of all documents, which is also the sum of the
    targets, so service ends at virtual time 1; the copy in service then is cut
    there, so that each source gives its target to the word. A null source is a
    source of its own and comes last; null and empty texts have size 0 and give
    nothing. Rows of equal id, or without one, are taken one after the other. An empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    sized = scratch.write(rows, "sized")
    sources = scratch.write(source_targets(sized), "sources")
    chunks = max(1, sized.count() // CHUNK)
    bits = min(40, (chunks - 1).bit_length())
    known = sources.withColumn("known", F.col("source"))
    named = sized.join(known.drop("source"), sized["source"].eqNullSafe(known["known"])).drop("known")
    named = named.withColumn("key", shuffle_key(F.col("doc_id")))
    named = named.withColumn("chunk", F.shiftright("key", 60 - bits)).drop("source")
    before = named.groupBy("rank", "chunk").agg(F.sum("size").alias("part"))
    running = Window.partitionBy("rank").orderBy("chunk")
    before = before.select("rank", "chunk", (F.sum("part").over(running) - F.col("part")).alias("before"))
    before = scratch.write(before, "chunks")
    within = Window.partitionBy("rank", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("end", F.sum("size").over(within)).join(before, ["rank", "chunk"])
    end, size, whole = F.col("end") + F.col("before"), F.col("size"), F.col("source_size")
    quota = F.round("target").cast("long")
    taken = sum(
        (F.greatest(F.lit(0), F.least(size, quota - (whole * e + end - size))) for e in range(REPEATS)), F.lit(0).cast("long")
    )
    finish = F.when(F.col("target") > 0, end / F.col("target"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), finish.alias("finish"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The copies that the mix serves, with the columns of docs, in order of virtual finish time.

    A document is served whole, as often as its taken words are nearest to. Rows
    without an id are served once, after all others. Ids must be unique.
    """
    plan = schedule(docs, id_col=id_col, **options).where("size > 0")
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    turn = F.col("source_size") / F.col("target")
    plan = plan.select(F.col("doc_id").alias("_mix_id"), copies.alias("_mix_n"), "finish", turn.alias("_mix_turn")).where("_mix_n > 0")
    epochs = F.sequence(F.lit(0), F.col("_mix_n") - 1)
    served = plan.select("_mix_id", F.explode(F.transform(epochs, lambda e: F.col("finish") + e * F.col("_mix_turn"))).alias("_mix_finish"))
    joined = docs.join(served, docs[id_col] == served["_mix_id"]).select(*[docs[n] for n in docs.columns], "_mix_finish", "_mix_id")
    rest = docs.where(docs[id_col].isNull()).select("*", F.lit(float("inf")).alias("_mix_finish"), F.lit(None).cast("long").alias("_mix_id"))
    return joined.union(rest).orderBy("_mix_finish", "_mix_id").drop("_mix_finish", "_mix_id")


ORACLE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), turns(turn, source, source_size, weight, target) AS (
  SELECT 0, source, source_size, weight, (sum(source_size) OVER ())::DOUBLE * weight / sum(weight) OVER () FROM sources
  UNION ALL
  SELECT turn + 1, source, source_size, weight,
         CASE WHEN target >= 3 * source_size THEN 3 * source_size
              ELSE (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE target >= 3 * source_size) OVER (), 0))::DOUBLE
                   * weight / sum(weight) FILTER (WHERE target < 3 * source_size) OVER () END
  FROM turns WHERE turn < 100
), targets AS (
  SELECT source, source_size, target::DOUBLE AS target FROM turns WHERE turn = 100
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS quota,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start))
        + greatest(0, least(size, quota - 2 * source_size - start)))::BIGINT AS taken,
       CASE WHEN target > 0 THEN (start + size) / target END AS finish
FROM placed
"""
