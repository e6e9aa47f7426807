"""Connected components of a large link table: union-find per partition, then star contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small


def union_find(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that the links touch, with the smallest node it reaches."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


#: Links that one union-find holds at a time; beyond it, what is known so far goes out as stars.
HELD_LINKS = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def stars() -> pa.RecordBatch:
        found = [(x, root) for x, root in union_find(iter(held)).items() if x != root]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())],
            names=["a", "b"],
        )

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= HELD_LINKS:
            yield stars()
    if held:
        yield stars()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of links (a, b), roots excepted; root is the smallest node reachable.

    Each round takes the smallest neighbour of every node and hands it to the
    larger neighbours, then to the smaller ones, until nothing changes. A hub's
    rows are joined with its single minimum, so a skewed hub can be split.
    An empty link table gives an empty result; links of a node to itself are ignored.
    """
    flat = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    stars = flat.where("a <> b").mapInArrow(_contract, "a long, b long")
    stars = scratch.write(stars, f"{name}-0")
    before = None
    turn = 0
    while True:
        turn += 1
        # large star: every neighbour above a node gets the smallest of the node's neighbourhood
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every neighbour below a node, and the node, get the smallest of them
        low = large.distinct().groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        stars = scratch.write(small, f"{name}-{turn}")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        if turn > 1:
            scratch.drop(f"{name}-{turn - 1}")
        before = now
    return stars.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def grouped_by_buckets(
    keys: DataFrame,
    sizes: Callable[[], DataFrame],
    prepare: Callable[[DataFrame], None],
    verified: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame], DataFrame],
    fits: Callable[[Column, Column], Column],
    scratch: Scratch,
) -> DataFrame:
    """(node, root) of the groups among items that share buckets; items linked with nothing are left out.

    keys holds (key, rep), a bucket and an item in it, and is read twice; sizes
    gives (rep, n), an item's size, once `prepare` was called, which is told
    which items have any company, as `rep`. Candidates are items of one bucket
    whose sizes fit; `verified` gives those of pairs (a, b) that are links.

    Every member of a bucket is compared with the bucket's pivot, the member
    that collides most often. Buckets whose members are then still in different
    groups are open; `across` gets their members as (pivot, rep, root, outside),
    distinct, where outside tells members that aren't in the pivot's group, and
    gives all links (a, b) from members outside to members of another root, or
    at least one for each such pair of a member and a root. So no link between
    candidates is lost.
    """
    shared = keys.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    buckets = scratch.write(keys.join(shared, "key"), "buckets")
    centre = buckets.groupBy("rep").agg(F.sum("cnt").alias("centre"))
    prepare(buckets)
    buckets = scratch.write(buckets.drop("cnt").join(centre, "rep").join(sizes(), "rep"), "members")
    scratch.drop("buckets")

    def pivots_of(pool: DataFrame) -> DataFrame:
        best = F.max(F.struct("centre", (-F.col("rep")).alias("less"), "n", "root")).alias("p")
        found = pool.groupBy("key").agg(best)
        return found.select("key", (-F.col("p.less")).alias("b"), F.col("p.n").alias("m"), F.col("p.root").alias("pr"))

    first = pivots_of(buckets.withColumn("root", F.col("rep")))
    pairs = buckets.join(first, "key").where((F.col("rep") != F.col("b")) & fits(F.col("n"), F.col("m")))
    links = scratch.write(verified(pairs.select(F.col("rep").alias("a"), "b").distinct()), "links")
    roots = scratch.write(components(links, scratch, "stars"), "roots")
    named = buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    labelled = scratch.write(named.join(split.select("key"), "key", "left_semi"), "labelled")
    pivots = scratch.write(pivots_of(labelled), "pivots")
    members = labelled.join(pivots, "key").select(F.col("b").alias("pivot"), "rep", "root", (F.col("root") != F.col("pr")).alias("outside"))
    rest = scratch.write(across(scratch.write(members.distinct(), "open")), "links-rest")
    if rest.isEmpty():
        return roots
    return scratch.write(components(links.union(rest), scratch, "stars-rest"), "roots-rest")


def member_blocks(items: DataFrame, table: DataFrame, payload: str, name: str, most: int, scratch: Scratch) -> DataFrame:
    """(pivot, part, parts, name): the members (pivot, rep, root) with their payload from table (rep, payload), in blocks of about `most` bytes."""
    sizes = items.join(table.select("rep", F.octet_length(payload).alias("bytes")), "rep")
    sizes = sizes.groupBy("pivot").agg((F.floor(F.sum("bytes") / most) + 1).cast("int").alias("parts"))
    sizes = scratch.write(sizes, f"{name}-sizes")
    dealt = items.join(small(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    block = F.collect_list(F.struct("rep", "root", payload)).alias(name)
    return dealt.join(table.select("rep", payload), "rep").groupBy("pivot", "part", "parts").agg(block)


def compared_blocks(members: DataFrame, table: DataFrame, payload: str, most: int, compare: Callable, scratch: Scratch) -> DataFrame:
    """Links (a, b) that `compare`, a mapInArrow function, finds in blocks of members outside and of all members of a pivot.

    Each pair of blocks is a key of its own, so a pivot of many members is spread over tasks.
    """
    left = scratch.write(member_blocks(members.where("outside"), table, payload, "lefts", most, scratch), "lefts")
    right = scratch.write(member_blocks(members, table, payload, "rights", most, scratch), "rights")

    def parts(blocks: DataFrame, name: str) -> DataFrame:
        return small(blocks.select("pivot", F.col("parts").alias(name)).distinct())

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    one = left.join(parts(right, "others"), "pivot").select("pivot", F.col("part").alias("l"), every("others").alias("r"), "lefts")
    two = right.join(parts(left, "others"), "pivot").select("pivot", every("others").alias("l"), F.col("part").alias("r"), "rights")
    return one.join(two, ["pivot", "l", "r"]).select("lefts", "rights").mapInArrow(compare, "a long, b long")
