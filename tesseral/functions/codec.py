"""The tensor codec: exact payloads by the smallest of several reversible forms, and four-bit payloads.

A payload is a 28-byte header and a body; an exact body begins with a prefix
that names its form. Decoding checks everything before it returns values.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import zstandard

from . import lossy, runs
from .fnv import OFFSET, fnv1a64

#: Fixed values of the wire format.
PAYLOAD_MAGIC, PAYLOAD_VERSION = b"QATQ", 1
CONTAINER_MAGIC, CONTAINER_VERSION = b"QATC", 2
EXACT_MAGIC, PHASE1_MAGIC, ROTATED_MAGIC = b"QEX1", b"P1Q4", b"TQ4R"
MODES = {"lossy-i4": 1, "lossless-f32": 2, "phase1-q4": 3, "exact": 4, "turboquant-q4": 5}
STRATEGIES = (
    "predictor-xor",
    "raw-bits",
    "byte-rle",
    "byte-plane-rle",
    "delta-xor-byte-plane-rle",
    "byte-plane-blocks",
    "byte-plane-packed-rle",
    "byte-plane-zstd",
    "quaternion-chain-zstd",
    "adjacent-xor-byte-plane-zstd",
    "strided-xor-byte-plane-zstd",
)
WIDTHS = {"f32": 4, "f16": 2, "bf16": 2}
PREFIXES = {"f32": b"\0\0\0", "f16": b"\1\2\0", "bf16": b"\2\2\0"}
TYPED = frozenset((1, 2, 3, 6, 7, 9, 10))
HEADER, PREFIX = 28, 8
MOST_VALUES = 1 << 26
#: How much of a 16-bit tensor the gates of its XOR forms look at.
ADJACENT_SAMPLE, STRIDED_SAMPLE, SAMPLE_BLOCKS, WIN_PERCENT = 4096, 1024, 64, 90


class CodecError(ValueError):
    """A payload or container that isn't valid, or a request that can't be met."""


@dataclass(frozen=True)
class Header:
    mode: int
    count: int
    scale: float
    checksum: int


def write_header(mode: str, count: int, scale: float, checksum: int) -> bytes:
    if count > MOST_VALUES:
        raise CodecError("too many values for one payload: use chunks")
    return PAYLOAD_MAGIC + bytes((PAYLOAD_VERSION, MODES[mode], 0, 0)) + struct.pack(">QfQ", count, scale, checksum)


def read_header(payload: bytes, mode: str | None = None) -> Header:
    if len(payload) < HEADER or payload[:4] != PAYLOAD_MAGIC or payload[4] != PAYLOAD_VERSION:
        raise CodecError("not a payload of this version")
    if payload[5] not in MODES.values() or payload[6:8] != b"\0\0":
        raise CodecError("unknown mode or reserved bytes set")
    count, scale, checksum = struct.unpack_from(">QfQ", payload, 8)
    if count > MOST_VALUES or not np.isfinite(scale) or scale <= 0:
        raise CodecError("value count or scale out of range")
    if mode and payload[5] != MODES[mode]:
        raise CodecError(f"the payload is not {mode}")
    return Header(payload[5], count, scale, checksum)


def zstd(data: bytes, most: int) -> bytes | None:
    packed = zstandard.ZstdCompressor(level=3).compress(data)
    return packed if len(packed) <= most else None


def unzstd(data: bytes, expected: int) -> np.ndarray:
    try:
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, expected))
    except zstandard.ZstdError as e:
        raise CodecError(str(e)) from e
    if len(raw) != expected:
        raise CodecError("a body has another length than its header says")
    return np.frombuffer(raw, np.uint8)


# Reversible forms: arrays of big-endian elements to planes of their bytes, and residuals of neighbours.


def planes(big: np.ndarray, width: int) -> np.ndarray:
    """All first bytes of the elements, then all second ones, and so on."""
    return np.ascontiguousarray(big.reshape(-1, width).T).reshape(-1)


def from_planes(data: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(width, -1).T).reshape(-1)


def words(big: np.ndarray, width: int) -> np.ndarray:
    return big.view(f">u{width}").astype(f"u{width}")


def as_bytes(values: np.ndarray) -> np.ndarray:
    return values.astype(values.dtype.newbyteorder(">")).view(np.uint8)


def xor_residual(values: np.ndarray, stride: int = 1) -> np.ndarray:
    out = values.copy()
    out[stride:] ^= values[:-stride]
    return out


def xor_restore(residual: np.ndarray, stride: int = 1) -> np.ndarray:
    """The values of a residual: a running XOR along each of `stride` interleaved sequences."""
    rows = -(-len(residual) // stride)
    padded = np.zeros(rows * stride, residual.dtype)
    padded[: len(residual)] = residual
    return np.bitwise_xor.accumulate(padded.reshape(rows, stride), axis=0).reshape(-1)[: len(residual)]


def chain_residual(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours modulo the word's range."""
    return np.diff(values, prepend=values.dtype.type(0))


def chain_restore(residual: np.ndarray) -> np.ndarray:
    return np.cumsum(residual, dtype=residual.dtype)


def plane_blocks(big: np.ndarray, most: int) -> bytes | None:
    """Each plane of 4 as one tag: all zero, all the same byte, or raw."""
    out = b""
    for plane in big.reshape(-1, 4).T:
        if len(plane) == 0 or (plane == plane[0]).all():
            out += bytes([runs.ZERO]) if len(plane) == 0 or plane[0] == 0 else bytes([runs.REPEAT, plane[0]])
        else:
            out += bytes([runs.RAW]) + plane.tobytes()
    return out if len(out) <= most else None


def plane_blocks_restore(body: bytes, count: int) -> np.ndarray:
    out, at = np.zeros((count, 4), np.uint8), 0
    for k in range(4):
        tag = body[at] if at < len(body) else 255
        size = {runs.ZERO: 0, runs.REPEAT: 1, runs.RAW: count}.get(tag, -1)
        if size < 0 or at + 1 + size > len(body):
            raise CodecError("a plane is not valid")
        if size:
            out[:, k] = np.frombuffer(body, np.uint8, size, at + 1)
        at += 1 + size
    if at != len(body):
        raise CodecError("bytes after the last plane")
    return out.reshape(-1)


def _word_runs(residual: np.ndarray) -> bytes:
    """Runs of zero and of other words, each at most 65,535 long."""
    out = []
    zero = residual == 0
    start = np.flatnonzero(np.concatenate([[True], zero[1:] != zero[:-1]])) if len(zero) else []
    big = as_bytes(residual).tobytes()
    for a, b in zip(start, [*start[1:], len(zero)], strict=True):
        for p in range(a, b, runs.PLAIN_LONGEST):
            n = min(runs.PLAIN_LONGEST, b - p)
            kind = runs.ZERO if zero[a] else runs.RAW
            out.append(struct.pack(">BH", kind, n) + (b"" if zero[a] else big[4 * p : 4 * (p + n)]))
    return b"".join(out)


def _word_runs_restore(body: bytes, count: int) -> np.ndarray:
    out, at, done = np.zeros(count, np.uint32), 0, 0
    while at < len(body):
        if at + 3 > len(body):
            raise CodecError("a run's header breaks off")
        kind, n = struct.unpack_from(">BH", body, at)
        at += 3
        size = 4 * n if kind == runs.RAW else 0
        if kind > runs.RAW or n == 0 or done + n > count or at + size > len(body):
            raise CodecError("a run is not valid")
        if size:
            out[done : done + n] = np.frombuffer(body, ">u4", n, at)
        at, done = at + size, done + n
    if done != count:
        raise CodecError("runs give another number of values")
    return out


# The gates of 16-bit forms.


def _sample_blocks(n: int, most: int) -> tuple[np.ndarray, int]:
    many = min(n, most)
    blocks = min(many, SAMPLE_BLOCKS)
    return np.arange(blocks) * n // blocks, -(-many // blocks)


def _zero_bytes(residual: np.ndarray) -> int:
    return int((residual.view(np.uint8) == 0).sum())


def adjacent_planes(values: np.ndarray) -> np.ndarray | None:
    """Planes of the XOR with the word before, where more than half of the bytes are zero in a sample and in all."""
    n = len(values)
    if n == 0:
        return None
    residual = xor_residual(values)
    start, size = _sample_blocks(n, ADJACENT_SAMPLE)
    at = (start[:, None] + np.arange(size)).reshape(-1)
    at = at[at < n]
    if _zero_bytes(residual[at]) <= len(at) or _zero_bytes(residual) <= n:
        return None
    return planes(as_bytes(residual), 2)


def strided_planes(values: np.ndarray, stride: int) -> np.ndarray | None:
    """Planes of the XOR with the word `stride` before, where a sample is mostly but not all zero and compresses well."""
    n = len(values)
    if not 0 < stride < n:
        return None
    start, size = _sample_blocks(n, STRIDED_SAMPLE)
    start = np.maximum(start, stride)
    at = start[:, None] + np.arange(size)
    at = at[at < n]
    sampled = values[at] ^ values[at - stride]
    zeros = _zero_bytes(sampled)
    if len(at) == 0 or zeros <= len(at) or zeros == 2 * len(at):
        return None
    residual = xor_residual(values, stride)
    zeros = _zero_bytes(residual)
    many = min(n, STRIDED_SAMPLE)
    if zeros <= n or 2 * n - zeros <= STRIDED_SAMPLE or many < 2:
        return None
    at = np.arange(many) * n // many
    plain, less = (len(zstandard.ZstdCompressor(level=3).compress(planes(as_bytes(x[at]), 2).tobytes())) for x in (values, residual))
    return planes(as_bytes(residual), 2) if 100 * less <= WIN_PERCENT * plain else None


def big_endian(data: bytes, dtype: str) -> np.ndarray:
    """The elements of little-endian data, each turned round."""
    width = WIDTHS[dtype]
    if len(data) % width:
        raise CodecError(f"{len(data)} bytes are no whole number of {dtype} elements")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, width)[:, ::-1]).reshape(-1)


def candidates(data: bytes, dtype: str = "f32", stride: int | None = None, every: bool = False) -> list[tuple[int, bytes]]:
    """(strategy, body) in the order that settles ties, the raw bits first; with `every`, forms longer than the data too."""
    big = big_endian(data, dtype)
    width, most = WIDTHS[dtype], len(big) if not every else 8 * len(big) + 64
    flat = planes(big, width)
    found: list[tuple[int, bytes | None]] = [
        (1, big.tobytes()),
        (2, runs.encode_plain(big, most)),
        (3, runs.encode_plain(flat, most)),
        (6, runs.encode_packed(flat, most)),
    ]
    values = words(big, width)
    if dtype != "f32":
        near = adjacent_planes(values)
        far = strided_planes(values, stride) if near is None and stride else None
        if near is not None:
            found.append((9, zstd(near.tobytes(), most)))
        elif far is not None:
            body = zstd(far.tobytes(), max(0, most - 4))
            found.append((10, None if body is None else struct.pack(">I", stride) + body))
        else:
            found.append((7, zstd(flat.tobytes(), most)))
    else:
        chain = planes(as_bytes(chain_residual(values)), 4)
        found += [
            (7, zstd(flat.tobytes(), most)),
            (8, zstd(chain.tobytes(), most)),
            (5, plane_blocks(big, most)),
            (4, runs.encode_plain(planes(as_bytes(xor_residual(values)), 4), most)),
        ]
        # nothing predicted is shorter than its own nibbles and signs
        lanes = -(-len(values) // 4) * 4
        best = min(len(b) for _, b in found if b is not None)
        if every or 12 + -(-lanes // 2) + -(-lanes // 8) < best:
            found.append((0, _predicted(values)[1]))
    return [(s, b) for s, b in found if b is not None]


def _predicted(values: np.ndarray) -> tuple[float, bytes]:
    parts = lossy.Phase1.of(values.view(np.float32))
    residual = values ^ parts.values(len(values)).view(np.uint32)
    body = struct.pack(">Qf", parts.seed, parts.residual) + lossy.pack_nibbles(parts.nibbles) + lossy.pack_bits(parts.signs) + _word_runs(residual)
    return float(parts.scale), body


def checksum(data: bytes, dtype: str) -> int:
    """f32 hashes its elements big-endian, the 16-bit types as they are."""
    return fnv1a64(big_endian(data, dtype).tobytes() if dtype == "f32" else data)


def encode_exact(data: bytes, dtype: str = "f32", stride: int | None = None, check: int | None = None) -> bytes:
    """The smallest exact payload of little-endian data; `check` is its checksum where that is known."""
    if stride is not None and (dtype == "f32" or not 0 < stride < 1 << 32):
        raise CodecError("a stride is for 16-bit types, and positive")
    strategy, body = min(candidates(data, dtype, stride), key=lambda x: len(x[1]))  # the first of the smallest
    return _payload(data, dtype, strategy, body, checksum(data, dtype) if check is None else check)


#: The selector has always tried every form; the name is kept for those who ask for that.
encode_exhaustive = encode_exact


def _payload(data: bytes, dtype: str, strategy: int, body: bytes, check: int) -> bytes:
    scale = _predicted(words(big_endian(data, dtype), 4))[0] if strategy == 0 else 1.0
    return write_header("exact", len(data) // WIDTHS[dtype], scale, check) + EXACT_MAGIC + bytes([strategy]) + PREFIXES[dtype] + body


def encode_each(data: bytes, dtype: str = "f32", stride: int | None = None) -> list[bytes]:
    """An exact payload of each form that there is for the data, however long."""
    check = checksum(data, dtype)
    return [_payload(data, dtype, strategy, body, check) for strategy, body in candidates(data, dtype, stride, every=True)]


def describe(payload: bytes) -> tuple[Header, str, str]:
    """(header, strategy, dtype) of an exact payload, without decoding it."""
    header = read_header(payload, "exact")
    dtype = next((k for k, v in PREFIXES.items() if v == payload[HEADER + 5 : HEADER + 8]), None)
    if payload[HEADER : HEADER + 4] != EXACT_MAGIC or payload[HEADER + 4] >= len(STRATEGIES) or dtype is None:
        raise CodecError("not an exact body")
    number = payload[HEADER + 4]
    if number not in TYPED if dtype != "f32" else number > 8:
        raise CodecError(f"no {STRATEGIES[number]} for {dtype}")
    return header, STRATEGIES[number], dtype


def decode_exact(payload: bytes, check: bool = True) -> tuple[bytes, str]:
    """(little-endian data, dtype) of an exact payload."""
    header, strategy, dtype = describe(payload)
    body, width = payload[HEADER + PREFIX :], WIDTHS[dtype]
    size, dt = header.count * width, f"u{width}"
    try:
        if strategy == "raw-bits":
            big = np.frombuffer(body, np.uint8)
        elif strategy == "byte-rle":
            big = runs.decode(body, size)
        elif strategy in ("byte-plane-rle", "byte-plane-packed-rle"):
            big = from_planes(runs.decode(body, size, "packed" in strategy), width)
        elif strategy == "byte-plane-zstd":
            big = from_planes(unzstd(body, size), width)
        elif strategy == "byte-plane-blocks":
            big = plane_blocks_restore(body, header.count)
        elif strategy == "predictor-xor":
            big = as_bytes(_restored(header, body))
        else:
            stride = 1
            if strategy.startswith("strided"):
                stride = struct.unpack_from(">I", body)[0] if len(body) >= 4 else 0
                body = body[4:]
                if not 0 < stride < max(1, header.count):
                    raise CodecError("a stride is out of range")
            flat = runs.decode(body, size) if strategy.startswith("delta") else unzstd(body, size)
            residual = words(from_planes(flat, width), width)
            values = chain_restore(residual) if strategy.startswith("quaternion") else xor_restore(residual, stride)
            big = as_bytes(values.astype(dt))
    except CodecError:
        raise
    except ValueError as e:
        raise CodecError(str(e)) from e
    if len(big) != size:
        raise CodecError("a body has another length than its header says")
    data = np.ascontiguousarray(big.reshape(-1, width)[:, ::-1]).tobytes()
    if check and checksum(data, dtype) != header.checksum:
        raise CodecError("the checksum differs")
    return data, dtype


def _restored(header: Header, body: bytes) -> np.ndarray:
    lanes = -(-header.count // 4) * 4
    nibbles, signs = 12 + -(-lanes // 2), -(-lanes // 8)
    if len(body) < nibbles + signs:
        raise CodecError("a predictor breaks off")
    seed, residual = struct.unpack_from(">Qf", body)
    if not np.isfinite(residual) or residual < 0:
        raise CodecError("a residual scale is out of range")
    parts = lossy.Phase1(seed, np.float32(header.scale), np.float32(residual), lossy.unpack_nibbles(body[12:nibbles], lanes), lossy.unpack_bits(body[nibbles : nibbles + signs], lanes))
    return parts.values(header.count).view(np.uint32) ^ _word_runs_restore(body[nibbles + signs :], header.count)


def encode(values: np.ndarray, mode: str) -> bytes:
    """A payload of f32 values in any mode."""
    values = np.asarray(values, np.float32)
    data = values.astype("<f4").tobytes()
    if mode == "exact":
        return encode_exact(data)
    check, n = checksum(data, "f32"), len(values)
    if mode == "lossless-f32":
        return write_header(mode, n, 1.0, check) + big_endian(data, "f32").tobytes()
    if mode == "lossy-i4":
        scale = lossy.scale_of(values)
        return write_header(mode, n, scale, check) + lossy.pack_nibbles(lossy.nibbles_of(values, scale))
    if mode == "phase1-q4":
        parts = lossy.Phase1.of(values)
        body = PHASE1_MAGIC + struct.pack(">Qf", parts.seed, parts.residual) + b"\0\0\0\0"
        return write_header(mode, n, parts.scale, check) + body + lossy.pack_nibbles(parts.nibbles) + lossy.pack_bits(parts.signs)
    if mode == "turboquant-q4":
        parts = lossy.Rotated.of(values)
        body = ROTATED_MAGIC + struct.pack(">Qf", parts.seed, parts.norm) + b"\0\0\0\0"
        return write_header(mode, n, parts.scale, check) + body + lossy.pack_nibbles(parts.nibbles) + lossy.pack_bits(parts.signs)
    raise CodecError(f"unknown mode {mode}")


def _four_bit(payload: bytes, header: Header, magic: bytes, lanes: int, signs: int) -> tuple[int, np.float32, np.ndarray, np.ndarray]:
    body, half = payload[HEADER:], -(-lanes // 2)
    if len(body) != 20 + half + -(-signs // 8) or body[:4] != magic or body[16:20] != b"\0\0\0\0":
        raise CodecError("a four-bit body is not valid")
    seed, extra = struct.unpack_from(">Qf", body, 4)
    if not np.isfinite(extra) or extra < 0:
        raise CodecError("a residual is out of range")
    return seed, np.float32(extra), lossy.unpack_nibbles(body[20 : 20 + half], lanes), lossy.unpack_bits(body[20 + half :], signs)


def rotated_parts(payload: bytes) -> tuple[Header, lossy.Rotated]:
    header = read_header(payload, "turboquant-q4")
    lanes = lossy.coordinates(header.count)
    seed, norm, nibbles, signs = _four_bit(payload, header, ROTATED_MAGIC, lanes, min(lanes, lossy.PROJECTIONS))
    return header, lossy.Rotated(seed, np.float32(header.scale), norm, nibbles, signs)


def decode(payload: bytes) -> np.ndarray:
    """The f32 values of a payload in any mode. Checksums of lossy payloads are those of the values before."""
    header = read_header(payload)
    mode = next(k for k, v in MODES.items() if v == header.mode)
    n, body = header.count, payload[HEADER:]
    if mode == "exact":
        data, dtype = decode_exact(payload)
        if dtype != "f32":
            raise CodecError("the payload holds 16-bit elements")
        return np.frombuffer(data, "<f4")
    if mode == "lossless-f32":
        if len(body) != 4 * n:
            raise CodecError("a body has another length than its header says")
        if fnv1a64(body) != header.checksum:
            raise CodecError("the checksum differs")
        return np.frombuffer(body, ">f4").astype(np.float32)
    if mode == "lossy-i4":
        if len(body) != -(-n // 2):
            raise CodecError("a body has another length than its header says")
        return lossy.values_of(lossy.unpack_nibbles(body, n), np.float32(header.scale))
    if mode == "phase1-q4":
        lanes = -(-n // 4) * 4
        seed, residual, nibbles, signs = _four_bit(payload, header, PHASE1_MAGIC, lanes, lanes)
        return lossy.Phase1(seed, np.float32(header.scale), residual, nibbles, signs).values(n)
    return rotated_parts(payload)[1].values(n)


def inner_product(payload: bytes, query: np.ndarray) -> np.float32:
    header, parts = rotated_parts(payload)
    if len(query) != header.count:
        raise CodecError("the query has another length")
    return parts.inner_product(np.asarray(query, np.float32))


# Chunks and containers.


def chunks(data: bytes, dtype: str, most_values: int) -> list[bytes]:
    """Little-endian data cut into chunks; no data is one empty chunk."""
    if not 0 < most_values <= MOST_VALUES:
        raise CodecError("a chunk's size is out of range")
    step = most_values * WIDTHS[dtype]
    return [data[i : i + step] for i in range(0, len(data), step)] or [b""]


def container(payloads: list[bytes]) -> bytes:
    """One container of exact payloads, in their order."""
    if not payloads:
        raise CodecError("a container has a chunk at least")
    total = sum(read_header(p, "exact").count for p in payloads)
    body = b"".join(struct.pack(">I", len(p)) + p for p in payloads)
    head = CONTAINER_MAGIC + bytes((CONTAINER_VERSION, MODES["exact"], 0, 0)) + struct.pack(">QI", total, len(payloads)) + b"\0\0\0\0"
    return head + struct.pack(">Q", fnv1a64(body, OFFSET)) + body


def container_head(data: bytes, most_chunks: int = 1 << 20, most_total: int = 1 << 32) -> tuple[int, int, int]:
    """(values, chunks, checksum) of a container, from its first 32 bytes."""
    if len(data) < 32 or data[:4] != CONTAINER_MAGIC or data[4] != CONTAINER_VERSION or data[5] != MODES["exact"]:
        raise CodecError("not a container of this version")
    total, many = struct.unpack_from(">QI", data, 8)
    if data[6:8] != b"\0\0" or data[20:24] != b"\0\0\0\0" or not 0 < many <= most_chunks or total > most_total:
        raise CodecError("a container's header is not valid")
    return total, many, struct.unpack_from(">Q", data, 24)[0]


def payloads(data: bytes, most_chunks: int = 1 << 20, most_total: int = 1 << 32) -> list[bytes]:
    """The payloads of a container, after all that its headers and its checksum say has been checked."""
    total, many, checksum = container_head(data, most_chunks, most_total)
    out, at = [], 32
    for _ in range(many):
        size = struct.unpack_from(">I", data, at)[0] if at + 4 <= len(data) else len(data)
        if at + 4 + size > len(data):
            raise CodecError("a container breaks off")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(data):
        raise CodecError("bytes after the last chunk")
    if fnv1a64(data[32:]) != checksum:
        raise CodecError("the container's checksum differs")
    if len({describe(p)[2] for p in out}) != 1 or sum(read_header(p).count for p in out) != total:
        raise CodecError("chunks are of several types or of another length in all")
    return out
