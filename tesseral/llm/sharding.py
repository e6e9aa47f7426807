"""Sharding by a k-d tree: nodes are split at weighted medians of their widest metadata dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small

#: Bins into which a pass cuts the ranges that still hold the nodes' medians, all together, and those of a node at least.
BINS, NODE_BINS = 1 << 16, 1024
#: A cut may miss its share by this part of the node's bytes; below it, only where one document is larger.
TOLERANCE = 1e-4
#: A group of equal texts is cut only where it holds more than this part of a shard's bytes.
GROUP_SLACK = 0.01
#: Rows of a shard that are numbered together, about.
CHUNK = 8192
#: Bits of the hash of a text, which orders groups that are equal in a dimension, and of that of an id, which orders a group.
TIE_BITS = 48


def _dimensions(text: Column, lang: Column, source: Column) -> dict[str, Column]:
    def digest(name: Column) -> Column:
        return F.coalesce(F.crc32(F.encode(name.cast("string"), "utf-8")), F.lit(-1)).cast("long")

    return {"size": F.octet_length(text) + F.lit(1), "text_crc32": F.crc32(F.encode(text, "utf-8")), "lang": digest(lang), "source": digest(source)}


NODE = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("pinned", T.LongType()),
        T.StructField("held", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("width", T.LongType()),
        T.StructField("want", T.DoubleType()),
    ]
)


class _Cut:
    """The search for one node's cut: documents below (value, group, tie) go left.

    The value is searched first, then the group within one value, then, where
    that group is too large to go to one side, the tie within it.
    """

    def __init__(self, node: int, leaves: int, dim: int, lo: int, hi: int, total: int):
        self.node, self.leaves, self.dim, self.total = node, leaves, dim, total
        self.want = total * (leaves // 2) / leaves
        self.found: list[int] = []  # the value, and the group, that hold the cut
        self.lo, self.hi, self.bins = lo, hi, 1
        self.done: tuple[int, int, int] | None = None

    @property
    def width(self) -> int:
        return max(1, math.ceil((self.hi - self.lo + 1) / self.bins))

    def row(self) -> tuple:
        return (self.node, self.dim, *[*self.found, None, None][:2], self.lo, self.width, self.want)

    def step(self, bin_: int, before: int, inside: int) -> None:
        """Goes into the bin that holds the share: `before` bytes lie below it, `inside` in it."""
        start = self.lo + bin_ * self.width
        end = start + self.width
        slack = GROUP_SLACK * self.total / self.leaves if len(self.found) == 1 and self.width == 1 else TOLERANCE * self.total
        if inside <= slack or (len(self.found) == 2 and self.width == 1):
            edge = start if self.want - before < before + inside - self.want else end
            self.done = (*self.found, edge, 0, 0)[:3]
        elif self.width == 1:
            self.found.append(start)
            self.lo, self.hi = 0, 2**TIE_BITS - 1
        else:
            self.lo, self.hi = start, end - 1


def _split_level(rows: DataFrame, dims: list[str], leaves: dict[int, int], spans: list[int]) -> list[_Cut]:
    """The cuts of all nodes of one level that have more than one leaf to make."""
    stats = [F.sum("size").alias("total")] + [f(d).alias(f"{n}_{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    cuts = []
    for r in rows.groupBy("node").agg(*stats).collect():  # one row for each node, at most one for each shard
        if leaves[r.node] < 2:
            continue
        widths = [(r[f"hi_{i}"] - r[f"lo_{i}"]) / spans[i] for i in range(len(dims))]
        dim = widths.index(max(widths))
        cuts.append(_Cut(r.node, leaves[r.node], dim, r[f"lo_{dim}"], r[f"hi_{dim}"], r.total))
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    while open_ := [c for c in cuts if c.done is None]:
        bins = max(min(BINS, NODE_BINS), BINS // len(open_))
        for c in open_:
            c.bins = bins
        # one row for each open node: no more than there are shards
        state = F.broadcast(rows.sparkSession.createDataFrame([c.row() for c in open_], NODE).withColumnRenamed("node", "n"))
        held = rows.join(state, rows["node"] == state["n"]).withColumn("value", value)
        pinned, own = F.col("pinned"), F.col("held")
        below = (F.col("value") < pinned) | ((F.col("value") == pinned) & (F.col("group") < own))
        at = F.when(pinned.isNull(), F.col("value")).when(F.coalesce(below, F.col("value") < pinned), F.lit(-1))
        at = at.when((F.col("value") == pinned) & own.isNull(), F.col("group")).when((F.col("value") == pinned) & (F.col("group") == own), F.col("tie"))
        bin_ = F.when(at < F.col("lo"), F.lit(-1)).otherwise(F.least(F.floor((at - F.col("lo")) / F.col("width")), F.lit(bins)))
        sums = held.withColumn("bin", bin_).where("bin is not null").groupBy("node", "bin", "want").agg(F.sum("size").alias("inside"))
        running = Window.partitionBy("node").orderBy("bin")
        sums = sums.withColumn("until", F.sum("inside").over(running))
        first = sums.where("bin >= 0 and until >= want").groupBy("node").agg(F.min(F.struct("bin", "inside", "until")).alias("x"))
        found = {r.node: r.x for r in first.collect()}  # one row for each open node
        for c in open_:
            c.step(found[c.node].bin, found[c.node].until - found[c.node].inside, found[c.node].inside)
    return cuts


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs.

    Give the number of shards, or the bytes that a shard shall hold. size is the
    text's bytes in UTF-8 plus 1. Each node is split along the dimension (size,
    text_crc32, lang, source) that is widest against the whole table's, at the
    weighted median: bytes below and above it are as the shards that each side
    is to make. Equal texts are a group, with the smallest lang and source of
    its rows; cuts go between groups, so a group stays in one shard, unless it
    holds more than GROUP_SLACK of a shard's bytes: then sizes come first, and
    the group is cut by a hash of the id where a cut meets it. slot numbers a
    shard's rows from 0 without gaps.

    Null texts have size 1; a null language or source is a value of its own, and
    rows without an id are equal in the order of ids; repeated rows count each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = _dimensions(text, F.col(lang_col), F.col(source_col))
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(17)), 64 - TIE_BITS)
    group = F.shiftrightunsigned(F.xxhash64(text, F.lit(19)), 64 - TIE_BITS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.cast("long").alias(n) for n, c in dims.items()), group.alias("group"), tie.alias("tie"))
    names = list(dims)
    rows = scratch.write(rows, "rows")
    # copies under several languages or sources have those of the smallest
    mixed = rows.groupBy("size", "text_crc32", "group").agg(*(f(c).alias(f"{n}_{c}") for c in ("lang", "source") for n, f in (("lo", F.min), ("hi", F.max))))
    mixed = scratch.write(mixed.where("lo_lang < hi_lang or lo_source < hi_source").drop("hi_lang", "hi_source"), "mixed")
    rows = rows.join(small(mixed), ["size", "text_crc32", "group"], "left")
    rows = rows.withColumns({"lang": F.coalesce("lo_lang", "lang"), "source": F.coalesce("lo_source", "source")})
    rows = scratch.write(rows.select("doc_id", *names, "group", "tie", F.lit(0).cast("long").alias("node")), "level-0")
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *(x for i, d in enumerate(names) for x in (F.min(d).alias(f"lo_{i}"), F.max(d).alias(f"hi_{i}")))).first()
    empty = spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long")
    if not whole.n:
        return empty
    if shards is None:
        shards = max(1, round(whole.bytes / target_bytes))
    spans = [max(1, whole[f"hi_{i}"] - whole[f"lo_{i}"]) for i in range(len(names))]
    leaves, offset = {0: shards}, {0: 0}
    level = 0
    while any(n > 1 for n in leaves.values()):
        cuts = {c.node: c for c in _split_level(rows, names, leaves, spans)}
        plan, grown, placed = [], {}, {}
        for node, n in leaves.items():
            left = n // 2
            cut = cuts.get(node)
            for side, many, first in ((2 * node + 1, left, offset[node]), (2 * node + 2, n - left, offset[node] + left)):
                if many:
                    grown[side], placed[side] = many, first
            plan.append((node, cut.dim if cut else 0, *(cut.done if cut else (-(2**63), 0, 0))))
        state = F.broadcast(spark.createDataFrame(plan, "n long, dim int, value long, group_cut long, tie_cut long"))
        value = F.element_at(F.array(*names), F.col("dim") + 1)
        in_group = (F.col("group") < F.col("group_cut")) | ((F.col("group") == F.col("group_cut")) & (F.col("tie") < F.col("tie_cut")))
        left = (value < F.col("value")) | ((value == F.col("value")) & in_group)
        joined = rows.join(state, rows["node"] == state["n"])
        rows = joined.withColumn("node", 2 * F.col("node") + F.when(left, 1).otherwise(2)).select("doc_id", *names, "group", "tie", "node")
        level += 1
        rows = scratch.write(rows, f"level-{level}")
        scratch.drop("rows" if level == 1 else f"level-{level - 1}")
        leaves, offset = grown, placed
    chosen = F.broadcast(spark.createDataFrame([(k, v) for k, v in offset.items()], "n long, shard int"))
    out = rows.join(chosen, rows["node"] == chosen["n"]).select("doc_id", "size", "text_crc32", "shard", "tie")
    return numbered(out, whole.n).drop("tie")


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """rows with a slot: gapless from 0 in each shard, in the order of tie.

    A shard is numbered in chunks of its order by tie, so that no task holds a whole one.
    """
    bits = min(TIE_BITS, max(0, total // CHUNK).bit_length())
    rows = rows.withColumn("chunk", F.shiftright("tie", TIE_BITS - bits))
    sums = rows.groupBy("shard", "chunk").agg(F.count("*").alias("many"))
    running = Window.partitionBy("shard").orderBy("chunk")
    sums = sums.select("shard", "chunk", (F.sum("many").over(running) - F.col("many")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("tie", "doc_id")) - 1
    out = rows.withColumn("place", place).join(sums, ["shard", "chunk"])
    return out.withColumn("slot", F.col("before") + F.col("place")).drop("chunk", "place", "before")
