import json

import numpy as np
import pytest

from tesseral.functions import codec, registered
from tesseral.operators import geometry, tensors
from tesseral.sources import files, fixtures
from tesseral.streaming.encode import encode_stream


def test_tensor_files(spark, tmp_path):
    for name, n in (("a.f32le", 40), ("b.f16le", 6), ("c.bf16le", 6), ("bad.f32le", 7), ("other.txt", 8)):
        (tmp_path / name).write_bytes(bytes(range(n)))
    got = {r.path.rsplit("/", 1)[1]: (r.dtype, r.n, r.valid) for r in files.tensor_files(spark, str(tmp_path)).collect()}
    assert got == {"a.f32le": ("f32", 10, True), "b.f16le": ("f16", 3, True), "c.bf16le": ("bf16", 3, True), "bad.f32le": ("f32", 1, False)}
    chunks = files.read_tensors(spark, str(tmp_path / "a.f32le"), chunk_values=4).collect()
    assert b"".join(r.payload for r in sorted(chunks, key=lambda r: r.chunk_id)) == bytes(range(40)) and len(chunks) == 3
    with pytest.raises(Exception, match="whole number"):
        files.read_tensors(spark, str(tmp_path / "bad.f32le")).collect()
    assert files.parse_input("x:f16:/a:b") == ("x", "f16", "/a:b")
    with pytest.raises(ValueError):
        files.parse_input("x:f64:/a")


def test_manifests(spark, tmp_path):
    (tmp_path / "one.f32le").write_bytes(b"\0" * 8)
    text = '# all\n[fixture]\nname = "one"\npath = "one.f32le"\n\n[fixture]\ngroup="g"\nname = "two"\npath = "/abs/two"\nnotes = "n"\n'
    (tmp_path / "m.manifest").write_text(text)
    rows = files.read_manifest(spark, str(tmp_path / "m.manifest"))
    assert [tuple(r) for r in rows.collect()] == [("fixture", "one", f"{tmp_path}/one.f32le", None, None), ("g", "two", "/abs/two", None, "n")]
    assert [(r.name, r.n) for r in files.audit_fixtures(spark, rows.where("name = 'one'")).collect()] == [("one", 2)]
    for bad in ('name = "x"', "[fixture]\nname = \"x\"", "[fixture]\nsize = \"1\"", "[fixture]\nname = \"x\"\nname = \"y\"\npath=\"p\""):
        with pytest.raises(ValueError):
            files.parse_manifest(bad)


def test_container_files(spark, tmp_path):
    raw = fixtures.wave(5000).tobytes()
    parts = codec.chunks(raw, "f32", 1500)
    rows = spark.createDataFrame([("t", i, "f32", bytearray(p)) for i, p in enumerate(parts)], "tensor_id string, chunk_id long, dtype string, payload binary")
    encoded = tensors.encode_chunks(rows)
    files.write_container(encoded, tmp_path / "x.box")
    assert (tmp_path / "x.box").read_bytes() == codec.container([codec.encode_exact(p) for p in parts])
    back = tensors.decode_chunks(files.read_containers(spark, str(tmp_path / "x.box"))).orderBy("chunk_id").collect()
    assert b"".join(r.payload for r in back) == raw
    with pytest.raises(codec.CodecError):
        files.write_container(encoded.limit(0), tmp_path / "x.box")
    assert len(list(tmp_path.iterdir())) == 1


def test_bundles(tmp_path):
    files.write_bundle(tmp_path / "b", {"a.json": b"{}", "b.txt": b"x"})
    assert files.verify_bundle(tmp_path / "b") == []
    with pytest.raises(FileExistsError):
        files.write_bundle(tmp_path / "b", {})
    (tmp_path / "b" / "b.txt").write_bytes(b"y")
    assert files.verify_bundle(tmp_path / "b") == ["b.txt: differs"]
    listed = json.loads((tmp_path / "b" / "manifest.json").read_text())
    listed["files"][0]["path"] = "../a.json"
    (tmp_path / "b" / "manifest.json").write_text(json.dumps(listed))
    assert files.verify_bundle(tmp_path / "b")[0].startswith("../a.json")
    files.write_atomic(tmp_path / "f", [b"1", b"2"])
    assert (tmp_path / "f").read_bytes() == b"12"


def test_captures(spark, tmp_path):
    vectors = np.array([[1, 0], [0, 1], [-1, 0], [1, 0]], "<f4")
    tensor = {"id": "l0", "offset_bytes": 0, "byte_length": 32, "layer": 0, "kind": "key", "rope_stage": "unknown", "token_start": 0, "token_count": 4, "heads": 1, "dimension": 2, "layout": "token_head_dimension"}
    meta = {"schema_version": 1, "capture_id": "c", "model": "m", "model_family": "f", "runtime": "r", "runtime_version": "1", "prompt_class": "p", "prompt_sha256": "0" * 64, "context_length": 4, "dtype": "f32", "tensors": [tensor]}
    (tmp_path / "c.kv").write_bytes(vectors.tobytes())
    (tmp_path / "c.json").write_text(json.dumps(meta))
    rows = files.read_capture(spark, str(tmp_path / "c.kv"), str(tmp_path / "c.json"))
    report = geometry.profile(geometry.partitioned(rows, "layer-head-token")).collect()
    assert len(report) == 1
    r = report[0]
    assert (r.vector_count, r.exact_duplicate_vectors, r.evaluated_pairs, r.max_cosine, r.status) == (4, 2, 6, 1.0, "APPROXIMATE")
    for change in ({"schema_version": 2}, {"tensors": [tensor, tensor]}, {"prompt_sha256": "x"}, {"tensors": [tensor | {"byte_length": 16}]}, {"tensors": [tensor | {"offset_bytes": 4}]}):
        with pytest.raises(ValueError):
            files.check_capture(meta | change, 32)


def test_sampled_pairs(spark):
    order = [(i, j) for i in range(9) for j in range(i + 1, 9)]
    assert [geometry.pair_at(9, k) for k in range(len(order))] == order
    got = geometry.sample_pairs(200, 50, 42)
    assert len(set(got)) == 50 and got == geometry.sample_pairs(200, 50, 42) and all(i < j < 200 for i, j in got)
    rng = np.random.default_rng(1)
    rows = [(g, i, rng.normal(size=4).tolist()) for g in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "group_id string, pos long, vec array<double>")
    unit = geometry.normalized(df)
    full = {(r.group_id, r.l, r.r): r.cosine for r in geometry.all_pairs(unit, 16).collect()}
    some = geometry.sampled_pairs(unit, 100).collect()
    assert len(full) == 2 * 60 * 59 // 2 and len(some) == 200
    assert all(abs(full[r.group_id, r.l, r.r] - r.cosine) < 1e-12 for r in some)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", i, "f32", bytearray(fixtures.ramp(100).tobytes())) for i in range(5)], "tensor_id string, chunk_id long, dtype string, payload binary")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    encode_stream(stream, str(tmp_path / "out"), str(tmp_path / "log"), available_now=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5 and {bytes(r.payload) for r in tensors.decode_chunks(out).collect()} == {fixtures.ramp(100).tobytes()}


def test_sql_functions(spark):
    registered.register(spark)
    spark.createDataFrame([(bytearray(fixtures.ramp(64).tobytes()), [1.0, -7.0, 0.5])], "p binary, v array<float>").createOrReplaceTempView("t")
    r = spark.sql("SELECT tensor_decode(tensor_encode(p, 'f32')) = p AS same, tensor_strategy(tensor_encode(p, 'f32')) AS s, tensor_inspect(tensor_encode(p, 'f32')).n AS n, i4_quantize(v) AS q, fnv1a64(p) AS f, hamming_bound(8, 3) AS h, check_certificate('x') AS c FROM t").first()
    assert r.same and r.s in codec.STRATEGIES and r.n == 64 and r.q == [1, -7, 1] and r.h == "28" and r.c == "INVALID"
    box = codec.container([codec.encode_exact(b"\0" * 8)] * 3)
    spark.createDataFrame([(bytearray(box),)], "b binary").createOrReplaceTempView("boxes")
    assert spark.sql("SELECT c.* FROM boxes, LATERAL container_chunks(b) c").count() == 3
