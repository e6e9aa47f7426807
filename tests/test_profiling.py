import json

import numpy as np
import pytest

from tesseral.operators import profiling
from tesseral.plans import reports
from tesseral.sources import files


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    folder = tmp_path_factory.mktemp("capture")
    rng = np.random.default_rng(2)
    values = rng.normal(size=(40, 2, 8)).astype("<f2")
    tensor = {"id": "l0.k", "offset_bytes": 0, "byte_length": values.nbytes, "layer": 0, "kind": "key", "rope_stage": "post_rope", "token_start": 0, "token_count": 40, "heads": 2, "dimension": 8, "layout": "token_head_dimension"}
    meta = {"schema_version": 1, "capture_id": "c", "model": "m", "model_family": "f", "runtime": "r", "runtime_version": "1", "prompt_class": "p", "prompt_sha256": "0" * 64, "context_length": 4, "dtype": "f16", "tensors": [tensor]}
    (folder / "c.kv").write_bytes(values.tobytes())
    (folder / "c.json").write_text(json.dumps(meta))
    return str(folder / "c.kv"), str(folder / "c.json"), values.astype(np.float64)


def test_profiles_by_partition(spark, capture):
    kv, meta, values = capture
    heads = profiling.profile_capture(spark, kv, meta).orderBy("group_id").collect()
    assert [r.group_id for r in heads] == ["l0.k:head:0", "l0.k:head:1"]
    for h, r in enumerate(heads):
        v = values[:, h] / np.linalg.norm(values[:, h], axis=1, keepdims=True)
        cosine = (v @ v.T)[np.triu_indices(40, 1)]
        cov = np.cov(v.T, bias=True)
        assert r.evaluated_pairs == 780 and r.mean_cosine == pytest.approx(cosine.mean()) and r.max_cosine == pytest.approx(cosine.max())
        assert r.trace == pytest.approx(np.trace(cov)) and r.participation == pytest.approx(np.trace(cov) ** 2 / (cov**2).sum())
        near = v @ v.T - 2 * np.eye(40)
        assert r.mean_nearest_cosine == pytest.approx(near.max(axis=1).mean())
    whole = profiling.profile_capture(spark, kv, meta, profiling.Policy(partition="layer-token")).collect()
    assert [(r.group_id, r.vector_count) for r in whole] == [("l0.k:all-heads", 40)]
    parts = profiling.aggregate(profiling.profile_capture(spark, kv, meta, profiling.Policy(partition="layer-head-chunk", chunk_tokens=16))).first()
    assert (parts.status, parts.group_count, parts.vector_count, parts.approximate_groups) == ("APPROXIMATE", 6, 80, 6)


def test_samples_and_refusals(spark, capture):
    kv, meta, _ = capture
    some = profiling.profile_capture(spark, kv, meta, profiling.Policy(max_pairs=100, max_spectral_dimension=1)).collect()
    assert {r.evaluated_pairs for r in some} == {100}
    for limit in ({"max_dimension": 4}, {"max_capture_bytes": 10}, {"max_scalar_values": 10}, {"max_vectors": 10}):
        report = profiling.profile_capture(spark, kv, meta, profiling.Policy(**limit))
        assert [(r.status, r.capture_id) for r in report.collect()] == [("REFUSED", "c")]
        assert profiling.aggregate(report).first().status == "REFUSED"


@pytest.mark.parametrize("bad", [{"max_pairs": 0}, {"max_pairs": 10**9}, {"near_duplicate_cosine": 2.0}, {"thresholds": (float("nan"),)}, {"thresholds": (0.0,) * 33}, {"partition": "other"}, {"chunk_tokens": 0}])
def test_policies(bad):
    with pytest.raises(ValueError):
        profiling.Policy(**bad)


def test_the_bundle_of_a_profile(spark, capture, tmp_path):
    kv, meta, _ = capture
    report = profiling.profile_capture(spark, kv, meta)
    parts = reports.profile_files(report, json.loads(open(meta).read()), profiling.Policy())
    files.write_bundle(tmp_path / "b", parts)
    assert files.verify_bundle(tmp_path / "b") == [] and set(parts) == {"capture-manifest.json", "geometry.json", "summary.md", "sampling-plan.json", "metrics.json"}
    assert [g["group_id"] for g in json.loads(parts["geometry.json"])] == ["l0.k:head:0", "l0.k:head:1"]
    assert json.loads(parts["metrics.json"])["group_count"] == 2


def test_status_of_groups_that_are_sampled_for_their_pairs(spark, capture):
    kv, meta, _ = capture
    some = profiling.profile_capture(spark, kv, meta, profiling.Policy(max_pairs=100, max_spectral_dimension=1)).collect()
    assert {r.status for r in some} == {"DETERMINISTIC_SAMPLE"}
