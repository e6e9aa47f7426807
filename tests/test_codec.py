import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseral.functions import codec, fnv, lossy, runs
from tesseral.sources import fixtures

F32 = np.float32
#: name: (FNV-1a of the file, strategy, payload's bytes)
PUBLIC = {
    "bf16-kv-ramp-64x8x16": ("6f42ae7c6e314989", "byte-plane-zstd", 12509),
    "bf16-kv-wave-128x8x16": ("260cf16d8eb205f1", "quaternion-chain-zstd", 7554),
    "f32-noisy-pass-through-64x12x16": ("216f15e2b9eb431e", "byte-plane-zstd", 32108),
    "stress-signed-zero-nan-inf": ("8788d5a828e81325", "quaternion-chain-zstd", 199),
}
CONTROLS = {"smooth-sine": ("quaternion-chain-zstd", 33454), "kv-like": ("quaternion-chain-zstd", 41511), "spiky": ("quaternion-chain-zstd", 35683), "bit-delta": ("delta-xor-byte-plane-rle", 60)}
#: name: {mode: (bytes, root mean square error)}
ERRORS = {
    "bf16-kv-ramp-64x8x16": {"lossy-i4": (4124, 0.041249), "turboquant-q4": (4176, 0.071218), "phase1-q4": (5168, 0.029562)},
    "bf16-kv-wave-128x8x16": {"lossy-i4": (8220, 0.025540), "turboquant-q4": (8272, 0.065829), "phase1-q4": (10288, 0.022336)},
    "f32-noisy-pass-through-64x12x16": {"lossy-i4": (6172, 0.331989), "turboquant-q4": (8272, 0.445868), "phase1-q4": (7728, 0.220032)},
    "smooth-sine": {"lossy-i4": (8220, 0.126263), "turboquant-q4": (8272, 0.315560), "phase1-q4": (10288, 0.114028)},
}
EIGHT = {"bf16-kv-ramp-64x8x16": 0.012594, "bf16-kv-wave-128x8x16": 0.010679, "f32-noisy-pass-through-64x12x16": 0.078174, "spiky": 0.020000}


def values(name):
    return fixtures.TENSORS[name][2]()


def rmse(a, b):
    return float(np.sqrt(np.mean((a.astype(F32) - b.astype(F32)).astype(np.float64) ** 2)))


@pytest.mark.parametrize("name", PUBLIC)
def test_public_fixtures(name):
    data = values(name).tobytes()
    mark, strategy, size = PUBLIC[name]
    assert f"{fnv.fnv1a64(data):016x}" == mark
    payload = codec.encode_exact(data)
    assert (codec.describe(payload)[1], len(payload)) == (strategy, size)
    assert codec.decode_exact(payload) == (data, "f32")
    assert len(codec.container([payload])) == size + 36


@pytest.mark.parametrize("name", CONTROLS)
def test_controls(name):
    payload = codec.encode_exact(values(name).tobytes())
    strategy, size = CONTROLS[name]
    assert codec.describe(payload)[1] == strategy
    assert abs(len(payload) - size) <= 0.002 * size  # sines differ in the last place between libraries
    assert codec.decode_exact(payload)[0] == values(name).tobytes()


@pytest.mark.parametrize(("name", "mode"), [(n, m) for n in ERRORS for m in ERRORS[n]])
def test_lossy_errors(name, mode):
    size, error = ERRORS[name][mode]
    payload = codec.encode(values(name), mode)
    assert len(payload) == size
    assert rmse(values(name), codec.decode(payload)) == pytest.approx(error, abs=2e-6)


@pytest.mark.parametrize("name", list(EIGHT)[:3])
def test_eight_bit_errors(name):
    assert rmse(values(name), lossy.eight_bit(values(name))) == pytest.approx(EIGHT[name], abs=2e-6)


def test_inner_products():
    x = values("bf16-kv-ramp-64x8x16")
    payload = codec.encode(x, "turboquant-q4")
    query = (x / np.sqrt((x.astype(np.float64) ** 2).sum())).astype(F32)
    assert abs(float(codec.inner_product(payload, query)) - float(query.astype(np.float64) @ x)) < 0.5
    with pytest.raises(codec.CodecError):
        codec.inner_product(payload, query[:-1])


def plain_reference(data, least, longest):
    """Tokens by going through the bytes one at a time."""
    out, i = [], 0

    def run(k):
        n = 1
        while k + n < len(data) and data[k + n] == data[k]:
            n += 1
        return n

    while i < len(data):
        if data[i] == 0:
            n = min(run(i), longest)
            out.append((0, i, n))
        elif run(i) >= least:
            n = min(run(i), longest)
            out.append((2, i, n))
        else:
            n = 1
            while i + n < len(data) and n < longest and data[i + n] != 0 and run(i + n) < least:
                n += 1
            out.append((1, i, n))
        i += n
    return out


@given(st.lists(st.tuples(st.sampled_from([0, 0, 1, 7, 255]), st.integers(1, 9)), max_size=40), st.booleans())
@settings(max_examples=400, deadline=None)
def test_runs(spec, packed):
    data = b"".join(bytes([b]) * (n * (20 if n == 9 else 1)) for b, n in spec)
    least, longest = (runs.PACKED_REPEAT, runs.PACKED_LONGEST) if packed else (runs.PLAIN_REPEAT, runs.PLAIN_LONGEST)
    want = b"".join(
        (bytes([k << 6 | (n - 1)]) if packed else struct.pack(">BH", k, n)) + (data[i : i + n] if k == 1 else data[i : i + 1] if k == 2 else b"")
        for k, i, n in plain_reference(data, least, longest)
    )
    array = np.frombuffer(data, np.uint8)
    encode = runs.encode_packed if packed else runs.encode_plain
    assert encode(array, len(want)) == want
    assert not want or encode(array, len(want) - 1) is None
    assert runs.decode(want, len(data), packed).tobytes() == data


def test_long_runs():
    for data in (b"\0" * 200_000, b"\7" * 65_537, b"\7" * (65_535 * 2 + 3) + b"\0", b"ab" * 40_000, b"\7" * 131_070):
        array = np.frombuffer(data, np.uint8)
        body = runs.encode_plain(array, 10**9)
        tokens = plain = runs.decode(body, len(data))
        assert plain.tobytes() == data and len(tokens) == len(data)


@given(st.binary(max_size=600), st.sampled_from(["f32", "f16", "bf16"]), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_round_trips(data, dtype, sparse):
    width = codec.WIDTHS[dtype]
    data = bytes(b if i % 4 >= sparse else 0 for i, b in enumerate(data))[: len(data) // width * width]
    stride = 5 if dtype != "f32" else None
    for strategy, body in codec.candidates(data, dtype, stride):
        scale = codec._predicted(codec.words(codec.big_endian(data, dtype), 4))[0] if strategy == 0 else 1.0
        head = codec.write_header("exact", len(data) // width, scale, codec.checksum(data, dtype))
        payload = head + codec.EXACT_MAGIC + bytes([strategy]) + codec.PREFIXES[dtype] + body
        assert codec.decode_exact(payload) == (data, dtype)
    payload = codec.encode_exact(data, dtype, stride)
    assert codec.decode_exact(payload) == (data, dtype) and len(payload) <= 36 + len(data)


def test_predicted_form_restores_special_values():
    for name in fixtures.TENSORS:
        x = np.ascontiguousarray(values(name)).view(np.uint32)[:1000]
        scale, body = codec._predicted(x)
        header = codec.Header(4, len(x), scale, 0)
        assert np.array_equal(codec._restored(header, body), x)


def test_typed_forms():
    bits = lambda x: ((x.view(np.uint32) + 0x7FFF + (x.view(np.uint32) >> 16 & 1)) >> 16).astype("<u2")
    line = bits(np.linspace(-1, 1, 4096).astype(F32))
    assert codec.describe(codec.encode_exact(line.tobytes(), "bf16"))[1] == "adjacent-xor-byte-plane-zstd"
    every = np.tile(np.arange(65536, dtype="<u2"), 2).tobytes()
    for dtype in ("f16", "bf16"):
        assert codec.decode_exact(codec.encode_exact(every, dtype)) == (every, dtype)
    token, channel = np.divmod(np.arange(65536), 128)
    rows = (0x3E00 + channel * 101 + token // 32).astype("<u2").tobytes()
    assert codec.describe(codec.encode_exact(rows, "f16"))[1] == "byte-plane-zstd"
    hinted = codec.encode_exact(rows, "f16", stride=128)
    assert codec.describe(hinted)[1] == "strided-xor-byte-plane-zstd" and codec.decode_exact(hinted) == (rows, "f16")
    with pytest.raises(codec.CodecError):
        codec.decode(hinted)


def test_what_is_not_valid_is_refused():
    data = values("smooth-sine")[:300].tobytes()
    payload = codec.encode_exact(data)
    for i in range(0, len(payload), 3):
        broken = bytearray(payload)
        broken[i] ^= 0x41
        try:
            assert codec.decode_exact(bytes(broken))[0] == data
        except codec.CodecError:
            pass
    for cut in (0, 10, 30, 36, len(payload) - 1):
        with pytest.raises(codec.CodecError):
            codec.decode_exact(payload[:cut])
    box = codec.container([payload, payload])
    assert codec.payloads(box) == [payload, payload]
    for broken in (box[:-1], box + b"x", box[:40] + b"y" + box[41:], box[:24] + b"12345678" + box[32:], b"none" + box[4:]):
        with pytest.raises(codec.CodecError):
            codec.payloads(broken)
    with pytest.raises(codec.CodecError):
        codec.encode_exact(b"abc")
    with pytest.raises(codec.CodecError):
        codec.payloads(box, most_chunks=1)


def test_empty_tensors():
    for mode in codec.MODES:
        assert len(codec.decode(codec.encode(np.zeros(0, F32), mode))) == 0
    assert codec.chunks(b"", "f32", 4) == [b""] and len(codec.chunks(b"1234" * 9, "f32", 4)) == 3


def test_many_hashes():
    rng = np.random.default_rng(1)
    rows = [rng.bytes(int(n)) for n in rng.integers(0, 200, 60)]
    assert fnv.fnv1a64_many(rows) == [fnv.fnv1a64(r) for r in rows]
    assert fnv.fnv1a64_many([]) == []
