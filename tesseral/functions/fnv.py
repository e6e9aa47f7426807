"""FNV-1a with 64 bits: over bytes, over many rows at once, and as a Spark expression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


#: Bytes that are hashed together, and the fewest for which that pays.
BLOCK, FEW = 1 << 15, 48


def _powers() -> np.ndarray:
    """PRIME to the powers of BLOCK, BLOCK - 1, ... 1."""
    out = np.full(BLOCK, PRIME, np.uint64)
    return np.multiply.accumulate(out)[::-1].copy()


POWERS = _powers()


def _running_xor(bits: np.ndarray) -> np.ndarray:
    """For each place the XOR of all bits (0 or 1) before it."""
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(len(bits) // 64 + 1, np.uint64)
    words.view(np.uint8)[: len(packed)] = packed
    for shift in (1, 2, 4, 8, 16, 32):
        words ^= words << np.uint64(shift)
    odd = np.bitwise_xor.accumulate(words >> np.uint64(63))
    words = words << np.uint64(1)
    words[1:] ^= np.uint64(0) - odd[:-1]
    return np.unpackbits(words.view(np.uint8), count=len(bits), bitorder="little")


def _low_bytes(data: np.ndarray, low: int) -> np.ndarray:
    """The low byte of the state before each byte of data.

    A product's bit depends on the bits below it and on its own, and PRIME is odd,
    so bit by bit each sequence is a running XOR of what the lower bits give.
    """
    out = np.zeros(len(data), np.uint8)
    prime = np.uint8(PRIME & 255)
    for k in range(8):
        own = (out ^ data) & np.uint8((1 << k) - 1)
        own *= prime
        own ^= data
        own &= np.uint8(1 << k)
        bits = _running_xor(own)
        if low >> k & 1:
            bits ^= np.uint8(1)
        out |= bits << np.uint8(k)
    return out


def fnv1a64(data: bytes, state: int = OFFSET) -> int:
    """The hash of data, going on from a state; long data by whole arrays.

    With the low bytes known, an XOR is the addition of a known number, and the
    state after n bytes a sum of those times powers of the prime.
    """
    if len(data) < FEW:
        for byte in data:
            state = (state ^ byte) * PRIME & MASK
        return state
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), BLOCK):
        part = whole[start : start + BLOCK]
        low = _low_bytes(part, state & 255)
        added = ((low ^ part).astype(np.int16) - low).astype(np.int64).view(np.uint64)
        powers = POWERS[BLOCK - len(part) :]
        state = (int((added * powers).sum(dtype=np.uint64)) + state * int(powers[0])) & MASK
    return state


def fnv1a64_many(rows: Sequence[bytes]) -> list[int]:
    """The hash of each row. Many short rows move on by one byte together, longest first; others go one by one."""
    if len(rows) < 16 or sum(map(len, rows)) >= FEW * len(rows):
        return [fnv1a64(r) for r in rows]
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(-lengths, kind="stable")
    state = np.full(len(rows), OFFSET, np.uint64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    start = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    prime = np.uint64(PRIME)
    for k, n in enumerate(alive.tolist()):
        state[:n] = (state[:n] ^ data[start[:n] + k]) * prime
    out = np.empty(len(rows), np.uint64)
    out[order] = state
    return out.tolist()


def fnv1a64_column(data: Column) -> Column:
    """The hash of a binary column as 16 hexadecimal digits, by Spark's own functions.

    The state is kept as two halves of 32 bits, so that no product overflows.
    """
    text = F.hex(data)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    values = F.transform(places, lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("long"))
    low = 0xFFFFFFFF

    def step(state: Column, byte: Column) -> Column:
        lo = state["lo"].bitwiseXOR(byte)
        product = lo * (PRIME & low)
        hi = state["hi"] * (PRIME & low) + F.shiftright(product, 32) + lo * (PRIME >> 32)
        return F.struct(hi.bitwiseAND(F.lit(low)).alias("hi"), product.bitwiseAND(F.lit(low)).alias("lo"))

    start = F.struct(F.lit(OFFSET >> 32).alias("hi"), F.lit(OFFSET & low).alias("lo"))

    def text_of(state: Column) -> Column:
        return F.lower(F.concat(F.lpad(F.hex(state["hi"]), 8, "0"), F.lpad(F.hex(state["lo"]), 8, "0")))

    return F.aggregate(values, start, step, text_of)
