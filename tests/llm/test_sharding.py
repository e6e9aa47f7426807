import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesseral.llm import sharding


def corpus():
    rows = [(i, f"text {i} " * (i % 37), "en" if i % 3 else None, f"s{i % 5}") for i in range(900)]
    rows += [(5000 + i, "copy", "de", "s0") for i in range(700)]
    rows += [(9000, None, None, None), (9001, "", "fr", ""), (9002, "é" * 40_000, "fr", "s1")]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sizes_are_near_equal(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "CHUNK", 64)
    monkeypatch.setattr(sharding, "BINS", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("node", F.lit("clash")).withColumn("size", F.lit(-5)).withColumn("tie", F.lit(1))
    got = sharding.kd_shards(docs, shards=shards).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    held, slots = Counter(), {}
    for r in got:
        held[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(held) == list(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= 2 * (max(map(len, text.values())) + 1)


def test_a_large_group_of_copies_is_cut(spark):
    rows = [(i, "the same text", "en", "s") for i in range(600)] + [(1000 + i, f"other text {i}", "de", "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    held = [r.b for r in sharding.kd_shards(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(held) - min(held) <= 4 * 15


def test_target_bytes_and_reruns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").where("doc_id <> 9002")
    one = sharding.kd_shards(docs, target_bytes=20_000)
    two = sharding.kd_shards(docs.repartition(7), target_bytes=20_000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    sizes = [r.b for r in one.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert 0.9 * 20_000 < min(sizes) and max(sizes) < 1.1 * 20_000


def test_repeated_rows_and_empty_table(spark):
    same = spark.createDataFrame([(1, "a", "en", "s")] * 50, "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(same, shards=4).collect()
    assert len(got) == 50
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert sharding.kd_shards(empty, shards=4).collect() == []


def test_equal_texts_stay_together(spark):
    """Copies under any language and source share a shard where they hold less than the slack; larger groups are cut."""
    rows = [(i, f"text {i % 1500} " * (1 + i % 1500 % 23), ("en", "de", None)[i % 3], f"s{i % 7}") for i in range(4000)]
    rows += [(9000 + i, "a large group", "en", f"s{i % 4}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    text = {i: t for i, t, *_ in rows}
    shards, held = {}, Counter()
    for r in sharding.kd_shards(docs, shards=8).collect():
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
        held[r.shard] += r.size
    split = [t for t, s in shards.items() if len(s) > 1]
    assert split == ["a large group"]
    assert max(held.values()) - min(held.values()) <= 0.05 * sum(held.values()) / 8
