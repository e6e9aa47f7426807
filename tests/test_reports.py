import json

import pytest

from tesseral.operators import gates
from tesseral.plans.reports import main, markdown
from tesseral.sources import fixtures
from test_capacity import EXAMPLE


def test_files_on_the_command_line(tmp_path, capsys):
    raw = fixtures.wave(1000).tobytes()
    a, b, c = tmp_path / "a.f32le", tmp_path / "b.box", tmp_path / "c.f32le"
    a.write_bytes(raw)
    assert main(["encode", str(a), str(b), "--chunk-values", "300"]) == 0
    assert main(["decode", str(b), str(c)]) == 0 and c.read_bytes() == raw
    assert main(["inspect", str(b)]) == 0 and len(capsys.readouterr().out.splitlines()) == 4
    b.write_bytes(b.read_bytes()[:-1])
    assert main(["decode", str(b), str(c)]) == 5 and c.read_bytes() == raw
    a.write_bytes(b"abc")
    assert main(["encode", str(a), str(b)]) == 5
    assert main(["encode", str(tmp_path / "none"), str(b)]) == 5


def test_capacity_on_the_command_line(tmp_path, capsys):
    request, bundle = tmp_path / "r.json", tmp_path / "bundle"
    request.write_text(json.dumps(EXAMPLE))
    assert main(["evaluate", str(request), "--bundle", str(bundle)]) == 1
    assert {p.name for p in bundle.iterdir()} == {"manifest.json", "request.normalized.json", "outcome.json", "certificate.json", "report.md", "metrics.json"}
    assert main(["verify", str(bundle)]) == 0 and main(["check", str(bundle / "certificate.json")]) == 0
    assert main(["evaluate", str(request), "--bundle", str(bundle)]) == 5
    (bundle / "certificate.json").write_text("{}")
    assert main(["verify", str(bundle)]) == 1 and main(["check", str(bundle / "certificate.json")]) == 4
    request.write_text("{}")
    assert main(["evaluate", str(request)]) == 3


def test_markdown(spark):
    df = spark.createDataFrame([("b", None, 1.5), ("a", 2, 0.25)], "name string, n int, x double")
    assert markdown(df, "T") == "# T\n\n| name | n | x |\n| --- | --- | --- |\n| a | 2 | 0.250000 |\n| b |  | 1.500000 |\n"


def test_gates(spark):
    df = spark.createDataFrame([("a", True, "byte-rle", 0.5, 10.0, 4.0, 100), ("b", True, "raw-bits", 1.0, 99.0, 99.0, 1), ("c", False, "byte-rle", 0.1, 1.0, 1.0, 100)], "tensor_id string, exact_bits boolean, strategy string, ratio double, encode_us double, decode_us double, n long")
    passed = lambda **k: {r.tensor_id for r in gates.limited(df, **k).where("passed").collect()}
    assert passed() == {"a", "b"} and passed(max_ratio=0.4) == {"b"} and passed(max_ns_per_value=50.0, policy="production-kv") == {"a", "b"}
    assert passed(max_decode_us=3.0, policy="latency-budget") == {"b"}
    for bad in ({"policy": "production-kv"}, {"policy": "production-kv", "max_ns_per_value": 5.0, "max_encode_us": 1.0}, {"policy": "latency-budget"}):
        with pytest.raises(ValueError):
            gates.limited(df, **bad)
    found = {r.tensor_id: r for r in gates.competitive(fixtures.fixtures(spark)).collect()}
    assert found["bf16-kv-ramp-64x8x16"].zstd_bytes == 15285 and found["bf16-kv-wave-128x8x16"].zstd_bytes == 19003
    assert found["f32-noisy-pass-through-64x12x16"].zstd_bytes == 44539 and all(r.exact_bits for r in found.values())


def test_timings_and_the_policies_over_them(spark):
    found = gates.timed(fixtures.fixtures(spark).where("grp = 'public'"), runs=2)
    rows = found.collect()
    assert len(rows) == 4 and all(r.exact_bits and r.encode_us > 0 and r.decode_ns_per_value > 0 for r in rows)
    slow = gates.limited(found, max_ns_per_value=1e9, policy="production-kv").collect()
    assert all(r.passed for r in slow) and not any(r.passed for r in gates.limited(found, max_decode_us=1e-9).collect() if r.strategy != "raw-bits")
