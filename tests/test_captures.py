import json
import random

import numpy as np
import pytest

from tesseral.functions import codec, fnv
from tesseral.operators import profiling, tensors
from tesseral.plans import reports
from tesseral.sources import captures, files, fixtures


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    """Two layers of keys and values as an export writes them, the values of one layer transposed."""
    folder, rng, listed = tmp_path_factory.mktemp("export"), np.random.default_rng(3), []
    for layer in range(2):
        for kind in "kv":
            values = rng.normal(size=(12, 16)).astype("<f2")
            turned = kind == "v" and layer == 1
            name = f"cache_{kind}_l{layer}"
            (folder / f"{name}.f16le").write_bytes((values.T if turned else values).tobytes())
            listed.append({"name": name, "file": f"{name}.f16le", "kind": kind, "dtype": "f16le", "embedding": 16, "active_cells": 12, "transposed": turned, "values": values})
    clean = [{k: v for k, v in x.items() if k != "values"} for x in listed]
    (folder / "manifest.json").write_text(json.dumps({"format": captures.EXPORT_FORMAT, "tensors": clean}))
    return folder, listed


IDENTITY = {"capture_id": "c", "model": "m", "model_family": "f", "runtime": "r", "runtime_version": "1", "prompt_class": "p"}


def test_conversion_and_profiles_of_a_corpus(spark, export, tmp_path):
    folder, listed = export
    meta = captures.convert(folder, tmp_path / "out", heads=2, prompt=b"say", identity=IDENTITY)
    assert files.verify_bundle(tmp_path / "out") == [] and meta["context_length"] == 12
    kv, described = str(tmp_path / "out/capture.kv"), str(tmp_path / "out/capture.json")
    got = {(r.tensor_id, r.token): r.vec for r in files.read_capture(spark, kv, described).collect()}
    for x in listed:
        assert all(got[x["name"], t] == x["values"][t].astype(float).tolist() for t in range(12))
    digests = files.capture_digests(spark, kv, described).first()
    provenance = json.loads((tmp_path / "out/provenance.json").read_text())
    assert digests.capture_sha256 == provenance["capture_sha256"] and digests.metadata_sha256 == provenance["metadata_sha256"]
    with pytest.raises(FileExistsError):
        captures.convert(folder, tmp_path / "out", heads=2, prompt=b"say", identity=IDENTITY)
    with pytest.raises(ValueError):
        captures.convert(folder, tmp_path / "other", heads=3, prompt=b"", identity=IDENTITY)
    report = profiling.profile_corpus(spark, {"a": (kv, described)}, ("layer-token", "layer-head-token"))
    assert report.groupBy("partition").count().count() == 2
    covered = profiling.corpus_coverage(spark, report, ["a"], ("layer-token", "layer-head-token")).first()
    assert covered.equal and not profiling.corpus_coverage(spark, report, ["a", "b"]).first().equal


def test_bundles_of_files(spark, export, tmp_path):
    folder, listed = export
    rows = [(x["name"], x["kind"], (folder / x["file"]).read_bytes()) for x in listed]
    random.Random(1).shuffle(rows)
    sizes = captures.write_bundles(spark.createDataFrame(rows, "name string, kind string, content binary"), tmp_path, "f16le")
    for bundle, kinds in (("keys", "k"), ("values", "v"), ("all", "kv")):
        want = b"".join(c for _, k, c in sorted(rows) if k in kinds)
        assert (tmp_path / f"cache_{bundle}_packed.f16le").read_bytes() == want and sizes[bundle] == len(want)
    assert captures.sweep(spark, model=["a", "b"], dtype=["f16", "bf16", "f32"]).count() == 6


def test_specs():
    assert files.parse_named_input("a:b:c") == ("a", "b:c") and files.parse_mode(" QATQ-I4") == "lossy-i4" and files.parse_mode("qatq-exact") == "exact"
    assert files.parse_seed("0xFF") == 255 and files.parse_seed("18446744073709551615") == (1 << 64) - 1
    for bad in ("", "0x", "-1", "18446744073709551616", "1.5"):
        with pytest.raises(ValueError):
            files.parse_seed(bad)
    for bad in ("", "exact", "none"):
        with pytest.raises(ValueError):
            files.parse_mode(bad)


def test_commands_that_are_always_refused(tmp_path, capsys):
    request = tmp_path / "r.json"
    model = {"kind": "binary", "dimension": 8, "required_states": "200", "separation": {"minimum_hamming_distance": 3}}
    request.write_text(json.dumps({"schema_version": 1, "request_id": "x", "representation": model, "bounds": {"engines": ["finite-binary-hamming"]}}))
    assert reports.main(["bound", str(request)]) == 0 and json.loads(capsys.readouterr().out)["upper_bound"] == "28"
    assert reports.main(["construct", str(request)]) == reports.main(["derive-kv", str(request)]) == 3


def test_checksums_of_any_length():
    rng = random.Random(5)
    for n in (0, 1, 47, 48, 63, 64, 65, 1000, fnv.BLOCK - 1, fnv.BLOCK, fnv.BLOCK + 1, 3 * fnv.BLOCK):
        data, state = rng.randbytes(n), rng.getrandbits(64)
        want = state
        for b in data:
            want = (want ^ b) * fnv.PRIME & fnv.MASK
        assert fnv.fnv1a64(data, state) == want


def test_every_form_restores_and_the_selector_takes_the_smallest():
    for name in ("bf16-kv-wave-128x8x16", "stress-signed-zero-nan-inf"):
        raw = fixtures.TENSORS[name][2]()[:3000].astype("<f4").tobytes()
        each = codec.encode_each(raw)
        assert len(each) == 9 and all(codec.decode_exact(p)[0] == raw for p in each)
        assert codec.encode_exhaustive(raw) == codec.encode_exact(raw) and len(codec.encode_exact(raw)) == min(map(len, each))
    for words in (fixtures.smooth_wave_bf16(), fixtures.slow_ramp_bf16(), fixtures.piecewise_kv_bf16(), fixtures.random_words()):
        raw = words.astype("<u2").tobytes()
        for stride in (None, 128):
            assert codec.decode_exact(codec.encode_exact(raw, "bf16", stride)) == (raw, "bf16")
    assert codec.describe(codec.encode_exact(fixtures.slow_ramp_bf16().astype("<u2").tobytes(), "bf16"))[1] == "adjacent-xor-byte-plane-zstd"


def test_chunks_put_together(spark):
    raw = fixtures.wave(5000).astype("<f4").tobytes()
    rows = [("t", i, "f32", p) for i, p in enumerate(codec.chunks(raw, "f32", 700))]
    random.Random(2).shuffle(rows)
    chunks = spark.createDataFrame(rows, "tensor_id string, chunk_id long, dtype string, payload binary")
    assert bytes(tensors.concatenated(tensors.decode_chunks(tensors.encode_chunks(chunks))).first().payload) == raw
