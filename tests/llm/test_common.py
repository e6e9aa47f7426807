import os

import pytest

from tesseral.llm.common import Scratch, released, small


def test_released_tables_go_and_others_stay(spark):
    rows = spark.range(10)
    outer = Scratch(spark, "outer")
    kept = outer.write(rows, "a")
    with pytest.raises(ValueError), released():
        inner = Scratch(spark, "inner")
        assert inner.write(rows, "b").count() == 10
        raise ValueError
    assert kept.count() == 10 and not os.path.exists(inner.root)
    outer.close()


def test_only_small_tables_are_broadcast(spark):
    rows = spark.range(10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    other = spark.range(5).withColumnRenamed("id", "k")
    hinted = other.join(small(rows, 10), other["k"] == rows["id"])
    assert "strategy=broadcast" in plan(hinted)
    left = other.join(small(rows, 9), other["k"] == rows["id"])
    assert "strategy=broadcast" not in plan(left)
