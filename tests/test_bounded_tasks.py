"""What a task holds doesn't grow with its share of the input or with the number of queries."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tesseral.operators import retrieval, tensors
from tesseral.plans import queries


def test_a_search_holds_a_tile_of_scores_and_finds_the_first_of_the_best():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2_500, 4))
    x[2_000:] = x[:500]
    rows = [SimpleNamespace(query_id=i, q=v) for i, v in enumerate(x)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "vec"])
    search = retrieval._best_of(rows, True)
    tracemalloc.start()
    found = list(search(iter([batch])))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    v = x / np.sqrt((x * x).sum(axis=1))[:, None]
    score = np.round(v @ v.T, 12)
    np.fill_diagonal(score, -2)
    assert found.column(1).to_pylist() == score.argmax(axis=1).tolist() and len(found) == 2_500


def test_chunks_are_taken_few_at_a_time(spark, monkeypatch, tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(range(100))], names=["x"])
    parts = list(tensors.few(iter([batch, batch.slice(0, 0)])))
    assert max(map(len, parts)) <= tensors.CHUNKS_AT_ONCE and sum((p.column(0).to_pylist() for p in parts), []) == list(range(100))


def test_the_gate_keeps_every_chunk_of_more_than_one_lot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "CHUNK", 16)
    rows = spark.range(16 * 70).selectExpr("id AS event_id", "cast(id % 7 AS double) AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = queries.competitive_gate(spark, str(tmp_path)).where("tensor_id like 'events-%'").collect()
    assert {r.tensor_id for r in got} == {f"events-{i}" for i in range(70)} and len(got) == 70
    assert all(r.exact_bits and r.raw_bytes == 64 for r in got)
