"""Reversible predictors of 16-bit tensors that are measured beside the codec and are no part of it.

Each takes words and gives words of the same number, or bit streams; each has an
inverse. `sizes` compares them with the codec's own payload.
"""

from __future__ import annotations

import numpy as np
import zstandard

from . import codec

U16 = np.uint16


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def split_planes(words: np.ndarray) -> bytes:
    """All low bytes, then all high ones."""
    return (words & 255).astype(np.uint8).tobytes() + (words >> 8).astype(np.uint8).tobytes()


# Ordered differences: floats in the order of their values, as integers.


def ordered(words: np.ndarray) -> np.ndarray:
    """Words whose integer order is the order of the floats."""
    return np.where(words & 0x8000, ~words, words ^ U16(0x8000)).astype(U16)


def unordered(words: np.ndarray) -> np.ndarray:
    return np.where(words & 0x8000, words ^ U16(0x8000), ~words).astype(U16)


def zigzag(x: np.ndarray) -> np.ndarray:
    """Small differences of either sign as small numbers."""
    signed = x.view(np.int16)
    return ((signed << 1) ^ (signed >> 15)).view(U16)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> 1) ^ (U16(0) - (x & 1)).astype(U16)


def ulp_residuals(words: np.ndarray, layer: int, stride: int = 1, second: bool = False) -> np.ndarray:
    """Differences to the word `stride` before in ordered units, or to the line through the two before; first words as they are."""
    rows = words.reshape(-1, layer)
    up, out = ordered(rows), rows.copy()
    first = stride * (2 if second else 1)
    if first < layer:
        near = up[:, first - stride : layer - stride]
        guess = near * U16(2) - up[:, : layer - first] if second else near
        out[:, first:] = zigzag(np.ascontiguousarray(up[:, first:] - guess))
    return out.reshape(-1)


def ulp_restored(residuals: np.ndarray, layer: int, stride: int = 1, second: bool = False) -> np.ndarray:
    rows = residuals.reshape(-1, layer)
    first = stride * (2 if second else 1)
    up = ordered(rows)
    for start in range(first, layer, stride):
        end = min(start + stride, layer)
        near = up[:, start - stride : end - stride]
        guess = near * U16(2) - up[:, start - 2 * stride : end - 2 * stride] if second else near
        up[:, start:end] = guess + unzigzag(rows[:, start:end])
    return unordered(up).reshape(-1)


# Lifting: K and V streams against each other, layers and heads against the ones before.


def _along(words: np.ndarray, shape: tuple[int, ...], axis: int, how: str, back: bool) -> np.ndarray:
    x = words.reshape(shape)
    if back:
        return (np.bitwise_xor.accumulate(x, axis=axis) if how == "xor" else np.cumsum(x, axis=axis, dtype=U16)).reshape(-1)
    out, later, earlier = x.copy(), [slice(None)] * x.ndim, [slice(None)] * x.ndim
    later[axis], earlier[axis] = slice(1, None), slice(None, -1)
    a, b = x[tuple(later)], x[tuple(earlier)]
    out[tuple(later)] = a ^ b if how == "xor" else a - b
    return out.reshape(-1)


def lift(k: np.ndarray, v: np.ndarray, step: str, rows: int, stride: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One step: kv-xor, kv-sub, layer-xor, layer-sub or headN-xor for heads of N words."""
    kind, how = step.split("-")
    if kind == "kv":
        return k, v ^ k if how == "xor" else (v + k if back else v - k)
    if kind == "layer":
        shape, axis = (-1, rows * stride), 0
    else:
        width = int(kind.removeprefix("head"))
        shape, axis = (-1, stride // width, width), 1
    return _along(k, shape, axis, how, back), _along(v, shape, axis, how, back)


def lifted(k: np.ndarray, v: np.ndarray, steps: list[str], rows: int, stride: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    for step in reversed(steps) if back else steps:
        k, v = lift(k, v, step, rows, stride, back)
    return k, v


def lifting_steps(stride: int) -> dict[str, list[str]]:
    """The candidates for rows of `stride` words."""
    found = {"identity-control": []} | {s: [s] for s in ("kv-xor", "kv-sub", "layer-xor", "layer-sub")}
    found |= {"layer-xor+kv-xor": ["layer-xor", "kv-xor"], "layer-sub+kv-sub": ["layer-sub", "kv-sub"]}
    for width in (64, 128):
        if stride % width == 0 and (width == 64 or stride > width):
            found |= {f"head{width}-xor": [f"head{width}-xor"], f"head{width}+layer+kv-xor": [f"head{width}-xor", "layer-xor", "kv-xor"]}
    return found


# Gauges: each four words as a quaternion, in blocks turned by one of eight units before the XOR with the one before.

#: Which word comes to each place, and whether its sign turns (fixed values: the units 1, -1 and both signs of i, j, k).
GAUGES = (
    ((0, 1, 2, 3), (0, 0, 0, 0)),
    ((0, 1, 2, 3), (1, 1, 1, 1)),
    ((1, 0, 3, 2), (1, 0, 1, 0)),
    ((1, 0, 3, 2), (0, 1, 0, 1)),
    ((2, 3, 0, 1), (1, 0, 0, 1)),
    ((2, 3, 0, 1), (0, 1, 1, 0)),
    ((3, 2, 1, 0), (1, 1, 0, 0)),
    ((3, 2, 1, 0), (0, 0, 1, 1)),
)
BACK = (0, 1, 3, 2, 5, 4, 7, 6)
GAUGE_BLOCK, GAUGE_SAMPLES = 256, 4
#: Quaternions that the gate looks at, and the part of the plain score, in percent, that gauges must reach.
GATE_SAMPLES, GATE_PERCENT = 1024, 95


def turn(q: np.ndarray, gauge: int) -> np.ndarray:
    places, signs = GAUGES[gauge]
    return q[:, places] ^ (np.array(signs, U16) << U16(15))


def gauge_score(residual: np.ndarray) -> int:
    """Bytes that aren't zero and bits that are set, weighed."""
    return int(((residual >> 8 != 0) * 8 + (residual & 255 != 0) * 4 + np.bitwise_count(residual)).sum())


def gauge_residuals(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gauge of each block, residual words); the last quaternion is filled with zeros."""
    q = np.zeros((-(-len(words) // 4), 4), U16)
    q.reshape(-1)[: len(words)] = words
    before = np.vstack([np.zeros((1, 4), U16), q[:-1]])[: len(q)]
    gauges, out = [], []
    for start in range(0, len(q), GAUGE_BLOCK):
        own, last = q[start : start + GAUGE_BLOCK], before[start : start + GAUGE_BLOCK]
        many = min(len(own), GAUGE_SAMPLES)
        at = np.arange(many) * len(own) // many
        best = min(range(len(GAUGES)), key=lambda g: gauge_score(turn(own[at], g) ^ last[at]))
        gauges.append(best)
        out.append(turn(own, best) ^ last)
    return np.array(gauges, np.uint8), np.concatenate(out).reshape(-1) if out else np.zeros(0, U16)


def gauge_restored(gauges: np.ndarray, residuals: np.ndarray, n: int) -> np.ndarray:
    q, last = residuals.reshape(-1, 4), np.zeros((1, 4), U16)
    out = np.empty_like(q)
    for i in range(len(q)):
        last = turn((q[i] ^ last[0])[None], BACK[gauges[i // GAUGE_BLOCK]])
        out[i] = last[0]
    return out.reshape(-1)[:n]


def gauge_pays(words: np.ndarray) -> bool:
    """Whether, on a sample, the best gauge of each quaternion scores well below none."""
    n = -(-len(words) // 4)
    if len(words) < 8:
        return False
    q = np.zeros((n, 4), U16)
    q.reshape(-1)[: len(words)] = words
    step = max(1, -(-n // GATE_SAMPLES))
    at = np.arange(step, n, step)[:GATE_SAMPLES]

    def scores(gauge: int) -> np.ndarray:
        x = turn(q[at], gauge) ^ q[at - 1]
        return ((x >> 8 != 0) * 8 + (x & 255 != 0) * 4 + np.bitwise_count(x)).sum(axis=1)

    every = np.stack([scores(g) for g in range(len(GAUGES))])
    return len(at) > 0 and int(every.min(axis=0).sum()) * 100 <= int(every[0].sum()) * GATE_PERCENT


# Rotary predictor: each row from the one before, turned by its position's angle.


def rope_angles(dim: int, layout: str, base: float = 1_000_000.0) -> tuple[np.ndarray, np.ndarray]:
    if layout == "identity":
        return np.zeros(dim // 2, np.float32), np.ones(dim // 2, np.float32)
    turned = np.float32(base) ** (-(2 * np.arange(dim // 2)).astype(np.float32) / np.float32(dim))
    return np.sin(turned), np.cos(turned)


def rope_guess(rows: np.ndarray, dim: int, layout: str) -> np.ndarray:
    """f16 words of the rows turned by one position; pairs are neighbours, or halves of a head for neox."""
    sin, cos = rope_angles(dim, layout)
    x = rows.view(np.float16).astype(np.float32).reshape(len(rows), -1, dim)
    if layout == "neox":
        left, right = x[..., : dim // 2], x[..., dim // 2 :]
    else:
        left, right = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    a, b = left * cos - right * sin, left * sin + right * cos
    if layout == "neox":
        out[..., : dim // 2], out[..., dim // 2 :] = a, b
    else:
        out[..., 0::2], out[..., 1::2] = a, b
    with np.errstate(over="ignore"):
        return out.astype(np.float16).view(U16).reshape(len(rows), -1)


def rope_residuals(words: np.ndarray, rows: int, width: int, dim: int, layout: str) -> np.ndarray:
    layers = words.reshape(-1, rows, width)
    out = layers.copy()
    for r in range(1, rows):
        out[:, r] ^= rope_guess(np.ascontiguousarray(layers[:, r - 1]), dim, layout)
    return out.reshape(-1)


def rope_restored(residuals: np.ndarray, rows: int, width: int, dim: int, layout: str) -> np.ndarray:
    out = residuals.reshape(-1, rows, width).copy()
    for r in range(1, rows):
        out[:, r] ^= rope_guess(np.ascontiguousarray(out[:, r - 1]), dim, layout)
    return out.reshape(-1)


# Shared exponents: signs, mantissas and exponents as streams of bits, exponents of four words against one of them.

FIELDS = {"f16": (5, 10), "bf16": (8, 7)}


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[:, None] >> np.arange(width) & 1).astype(np.uint8)


def exponent_bits(exponents: np.ndarray, width: int, coding: str) -> np.ndarray:
    """The bits of the exponents: raw, or against the first or the commonest of each four."""
    if coding == "raw-fields":
        return _bits(exponents, width).reshape(-1)
    out = []
    for start in range(0, len(exponents), 4):
        group = exponents[start : start + 4]
        at = int((group[:, None] == group).sum(axis=1).argmax()) if coding == "mode-reference" else 0
        if coding == "mode-reference":
            out.append(np.array([at & 1, at >> 1], np.uint8))
        out.append(_bits(group[at : at + 1], width)[0])
        for i, e in enumerate(group):
            if i != at:
                out.append(np.array([e == group[at]], np.uint8))
                if e != group[at]:
                    out.append(_bits(group[i : i + 1], width)[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def shared_exponents(words: np.ndarray, dtype: str, coding: str) -> tuple[bytes, bytes, bytes]:
    e, m = FIELDS[dtype]
    streams = (_bits(words >> 15, 1).reshape(-1), _bits(words & ((1 << m) - 1), m).reshape(-1), exponent_bits(words >> m & ((1 << e) - 1), e, coding))
    return tuple(np.packbits(s, bitorder="little").tobytes() for s in streams)


def shared_restored(streams: tuple[bytes, bytes, bytes], n: int, dtype: str, coding: str) -> np.ndarray:
    e, m = FIELDS[dtype]
    signs, mantissas, bits = (np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little").astype(np.int64) for s in streams)
    weight = 1 << np.arange(e)
    if coding == "raw-fields":
        exponents = bits[: n * e].reshape(n, e) @ weight
    else:
        exponents, at = np.zeros(n, np.int64), 0
        for start in range(0, n, 4):
            size, lead = min(4, n - start), 0
            if coding == "mode-reference":
                lead, at = int(bits[at] + 2 * bits[at + 1]), at + 2
            common, at = int(bits[at : at + e] @ weight), at + e
            for i in range(size):
                value = common
                if i != lead:
                    at += 1
                    if not bits[at - 1]:
                        value, at = int(bits[at : at + e] @ weight), at + e
                exponents[start + i] = value
    tail = mantissas[: n * m].reshape(n, m) @ (1 << np.arange(m))
    return (signs[:n] << 15 | exponents << m | tail).astype(U16)


def sizes(words: np.ndarray, dtype: str, layer: int, stride: int) -> dict[str, int]:
    """Bytes of each predictor's compressed form, and of the codec's payload."""
    raw = words.astype("<u2").tobytes()
    out = {"codec": len(codec.encode_exact(raw, dtype, stride))}
    for name, s, second in (("ulp-adjacent", 1, False), ("ulp-strided", stride, False), ("ulp-second-order", stride, True)):
        out[name] = len(packed(split_planes(ulp_residuals(words, layer, s, second))))
    gauges, residuals = gauge_residuals(words)
    out["gauge-xor"] = len(packed(np.packbits(_bits(gauges, 3).reshape(-1), bitorder="little").tobytes())) + len(packed(codec.planes(codec.as_bytes(residuals), 2).tobytes()))
    for coding in ("raw-fields", "lane0-reference", "mode-reference"):
        out[coding] = len(packed(b"".join(shared_exponents(words, dtype, coding))))
    return out
