import hashlib
import string

import pytest
from pyspark.sql import functions as F

from tesseral.llm import exact

ROWS = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 100_000), (9, "X" * 100_000), (10, "same"), (11, "İ"), (12, "i̇")]


def normal(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")


@pytest.fixture
def index(spark, tmp_path):
    return exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)


def test_matches_brute_force(spark, index):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("keep_id", F.lit(0))
    got = {r.doc_id: r for r in exact.deduplicate(docs, index).collect()}
    groups = {}
    for i, t in ROWS:
        groups.setdefault(normal(t), []).append(i)
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        own = groups[normal(t)]
        want = (max(own), len(own), i == max(own), hashlib.sha256(normal(t).encode()).hexdigest())
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want


def test_later_batches_meet_the_index(spark, index, tmp_path):
    first = spark.createDataFrame(ROWS, "doc_id long, text string")
    exact.deduplicate(first, index).collect()
    size = index.table().count()
    again = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)  # as another session opens it
    later = spark.createDataFrame([(20, "SAME"), (21, "new"), (22, "NEW")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.deduplicate(later, again).collect()}
    assert got == {20: (10, 1, False), 21: (22, 2, False), 22: (22, 2, True)}
    assert again.table().count() == size + 1


def test_the_index_is_not_shuffled(spark, index):
    groups = spark.createDataFrame([(b"a" * 32, 1)], "digest binary, keep_id long")
    index.append(groups)
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_empty_table(spark, index):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.deduplicate(docs, index).collect() == [] and index.table().count() == 0
