"""Four-bit codecs, a software eight-bit float, and the rotations that they use.

All arithmetic is in single precision, each step rounded, sums from left to right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The seed of both rotations, streams of signs, and the constant of the projection estimate.
SEED = 0x51415451C0DE0001
SIGN_STREAMS = (0x54514657445F0001, 0x54514657445F0002)
QUATERNION_STREAM = 0xA0761D6478BD642F
PROJECTION_STREAM = 0x514A4C5F53524854
GOLDEN = 0x9E3779B97F4A7C15
PROJECTIONS = 256
ROOT_HALF_PI = np.float32(1.2533141)
F32 = np.float32


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The next output of SplitMix64 from each state."""
    x = np.asarray(x, np.uint64) + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def finite(values: np.ndarray) -> np.ndarray:
    """The values with 0 in place of what isn't finite."""
    return np.where(np.isfinite(values), values, F32(0)).astype(F32)


def scale_of(values: np.ndarray) -> np.float32:
    """The step of four-bit levels: a seventh of the largest finite magnitude, 1 for none."""
    top = np.abs(values[np.isfinite(values)]).max(initial=F32(0))
    return F32(top / F32(7)) if top > 0 else F32(1)


def nibbles_of(values: np.ndarray, scale: np.float32) -> np.ndarray:
    """Levels -7 to 7 plus 8; halves round away from zero, what isn't finite is level 0."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        x = (values / scale).astype(F32)
    whole = np.trunc(x)
    whole = np.where(np.abs(x - whole) >= F32(0.5), whole + np.sign(x), whole)
    return (np.where(np.isfinite(values), np.clip(whole, -7, 7), 0) + 8).astype(np.uint8)


def values_of(nibbles: np.ndarray, scale: np.float32) -> np.ndarray:
    return ((nibbles.astype(np.int16) - 8).astype(F32) * scale).astype(F32)


def pack_nibbles(nibbles: np.ndarray) -> bytes:
    """Two to a byte, the first in the upper half."""
    even = np.zeros(-(-len(nibbles) // 2) * 2, np.uint8)
    even[: len(nibbles)] = nibbles
    return (even[0::2] << 4 | even[1::2]).tobytes()


def unpack_nibbles(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n]


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)


def running_sum(values: np.ndarray) -> np.float32:
    """The sum from left to right in single precision."""
    return np.cumsum(values, dtype=F32)[-1] if len(values) else F32(0)


def quaternions(seed: int, lanes: int) -> np.ndarray:
    """A unit quaternion for each lane, by the seed."""
    with np.errstate(over="ignore"):
        state = np.uint64(seed) ^ (np.arange(lanes, dtype=np.uint64) * np.uint64(GOLDEN)) ^ np.uint64(QUATERNION_STREAM)
    parts = []
    for _ in range(4):
        state = splitmix64(state)
        unit = (state >> np.uint64(40)).astype(F32) / F32((1 << 24) - 1)
        parts.append((unit.astype(np.float64) * 2 - 1).astype(F32))  # rounded once
    q = np.stack(parts)
    square = np.zeros(lanes, F32)
    for p in q:
        square = square + p * p
    bad = ~(square > np.finfo(F32).eps) | ~np.isfinite(square)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = q / np.sqrt(square)
    q[:, bad] = np.array([[1], [0], [0], [0]], F32)
    return q.astype(F32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamilton's product, lane by lane."""
    (ar, ai, aj, ak), (br, bi, bj, bk) = a, b
    return np.stack(
        [
            ar * br - ai * bi - aj * bj - ak * bk,
            ar * bi + ai * br + aj * bk - ak * bj,
            ar * bj - ai * bk + aj * br + ak * bi,
            ar * bk + ai * bj - aj * bi + ak * br,
        ]
    )


def rotate(values: np.ndarray, seed: int, back: bool = False) -> np.ndarray:
    """Each four values turned by their lane's quaternion; the last lane is filled with zeros."""
    lanes = -(-len(values) // 4)
    x = np.zeros(lanes * 4, F32)
    x[: len(values)] = values
    q = quaternions(seed, lanes)
    p = q * np.array([[1], [-1], [-1], [-1]], F32)
    x = x.reshape(lanes, 4).T
    first, last = (p, q) if back else (q, p)
    return product(product(first, x), last).T.reshape(-1).astype(F32)


def _flip(values: np.ndarray, seed: int, stream: int) -> np.ndarray:
    mixed = splitmix64(np.uint64(seed ^ stream) ^ (np.arange(len(values), dtype=np.uint64) * np.uint64(GOLDEN)))
    return np.where(mixed & np.uint64(1) == 1, -values, values).astype(F32)


def hadamard(values: np.ndarray, seed: int, back: bool = False) -> np.ndarray:
    """A Walsh-Hadamard transform between two random changes of sign; its length is a power of 2."""
    if len(values) == 0:
        return values.astype(F32)
    streams = SIGN_STREAMS[::-1] if back else SIGN_STREAMS
    x = _flip(values.astype(F32), seed, streams[0])
    width = 1
    while width < len(x):
        pairs = x.reshape(-1, 2, width)
        x = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], 1).reshape(-1)
        width *= 2
    x = (x * (F32(1) / np.sqrt(F32(len(x))))).astype(F32)
    return _flip(x, seed, streams[1])


@dataclass
class Phase1:
    """Quaternion rotation, four bits, and a mean residual with its sign for each coordinate."""

    seed: int
    scale: np.float32
    residual: np.float32
    nibbles: np.ndarray
    signs: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, seed: int = SEED) -> Phase1:
        turned = rotate(finite(values), seed)
        scale = scale_of(turned)
        nibbles = nibbles_of(turned, scale)
        left = turned - values_of(nibbles, scale)
        mean = running_sum(np.abs(left)) / F32(len(turned)) if len(turned) else F32(0)
        return cls(seed, scale, F32(mean), nibbles, left >= 0)

    def values(self, n: int) -> np.ndarray:
        moved = values_of(self.nibbles, self.scale) + np.where(self.signs, self.residual, -self.residual).astype(F32)
        return rotate(moved.astype(F32), self.seed, back=True)[:n]


@dataclass
class Rotated:
    """Random Hadamard rotation, four bits, the residual's norm and signs of its projections."""

    seed: int
    scale: np.float32
    norm: np.float32
    nibbles: np.ndarray
    signs: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, seed: int = SEED) -> Rotated:
        n = len(values)
        padded = np.zeros(coordinates(n), F32)
        padded[:n] = finite(values)
        turned = hadamard(padded, seed)
        scale = scale_of(turned)
        nibbles = nibbles_of(turned, scale)
        left = (padded - hadamard(values_of(nibbles, scale), seed, back=True)).astype(F32)
        norm = np.sqrt(running_sum(left * left))
        many = min(len(padded), PROJECTIONS)
        signs = np.ones(many, bool) if norm == 0 else hadamard(left, seed ^ PROJECTION_STREAM)[:many] >= 0
        return cls(seed, scale, F32(norm), nibbles, signs)

    def base(self) -> np.ndarray:
        return hadamard(values_of(self.nibbles, self.scale), self.seed, back=True)

    def values(self, n: int) -> np.ndarray:
        out = self.base()
        if self.norm > 0 and len(self.signs):
            spread = np.zeros(len(out), F32)
            spread[: len(self.signs)] = np.where(self.signs, 1, -1)
            step = F32(F32(ROOT_HALF_PI / F32(len(self.signs))) * self.norm)
            out = out + step * hadamard(spread, self.seed ^ PROJECTION_STREAM, back=True)
        return out.astype(F32)[:n]

    def inner_product(self, query: np.ndarray) -> np.float32:
        """An estimate of the inner product of the values with a query of their length."""
        dot = running_sum(query.astype(F32) * self.base()[: len(query)])
        if self.norm == 0 or not len(self.signs):
            return dot
        padded = np.zeros(len(self.nibbles), F32)
        padded[: len(query)] = finite(query)
        seen = hadamard(padded, self.seed ^ PROJECTION_STREAM)[: len(self.signs)]
        more = running_sum(seen * np.where(self.signs, F32(1), F32(-1)))
        return F32(dot + F32(F32(ROOT_HALF_PI / F32(len(self.signs))) * self.norm) * more)


def coordinates(n: int) -> int:
    return n if n <= 1 else 1 << (n - 1).bit_length()


def eight_bit(values: np.ndarray) -> np.ndarray:
    """Values rounded to a sign, four bits of exponent from -6 to 7 and three of mantissa."""
    x = finite(values)
    size = np.clip(np.abs(x), F32(2**-6), F32(240))
    with np.errstate(divide="ignore"):
        power = np.clip(np.floor(np.log2(size)), -6, 7).astype(F32)
    unit = np.exp2(power).astype(F32)
    steps = np.minimum(np.floor((size / unit - F32(1)) * F32(8) + F32(0.5)), F32(7))
    return np.where(x == 0, F32(0), np.copysign(unit * (F32(1) + steps / F32(8)), x)).astype(F32)
