"""Run encodings of byte sequences, found by comparing whole arrays."""

from __future__ import annotations

import numpy as np

#: Kinds of a run in both formats (fixed values).
ZERO, RAW, REPEAT = 0, 1, 2
#: The plain format: a kind byte and a length of 16 bits; repeats of 4 bytes and more.
PLAIN_LONGEST, PLAIN_REPEAT = 65_535, 4
#: The packed format: a kind in the upper 2 bits and a length less 1 in the others; repeats of 3 bytes and more.
PACKED_LONGEST, PACKED_REPEAT = 64, 3


def _pieces(data: np.ndarray, longest: int, repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, length) of the runs of a sequence, none longer than `longest`."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    start = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    length = np.diff(np.append(start, n))
    zero = data[start] == 0
    long = ~zero & (length >= repeat)
    # what is left of a repeat after its full pieces is a repeat only if long enough itself
    over = np.where(long, length % longest, 0)
    tail = long & (length > longest) & (over > 0) & (over < repeat)
    kind = np.where(zero, ZERO, np.where(long, REPEAT, RAW))
    if tail.any():
        cut = np.where(tail, over, 0)
        kind = np.concatenate([kind, np.full(tail.sum(), RAW)])
        start = np.concatenate([start, (start + length - cut)[tail]])
        length = np.concatenate([length - cut, cut[tail]])
        order = np.argsort(start, kind="stable")
        kind, start, length = kind[order], start[order], length[order]
    # raw runs beside each other are one
    first = np.flatnonzero((kind != RAW) | np.concatenate([[True], kind[:-1] != RAW]))
    kind, start = kind[first], start[first]
    length = np.diff(np.append(start, n))
    parts = -(-length // longest)
    if (parts > 1).any():
        owner = np.repeat(np.arange(len(kind)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        kind = kind[owner]
        length = np.minimum(longest, length[owner] - number * longest)
        start = start[owner] + number * longest
    return kind, start, length


def _encode(data: np.ndarray, longest: int, repeat: int, header: int, most: int) -> bytes | None:
    kind, start, length = _pieces(data, longest, repeat)
    size = header + np.where(kind == RAW, length, np.where(kind == REPEAT, 1, 0))
    total = int(size.sum())
    if total > most:
        return None
    out = np.zeros(total, np.uint8)
    at = np.cumsum(size) - size
    if header == 3:
        out[at], out[at + 1], out[at + 2] = kind, length >> 8, length & 255
    else:
        out[at] = kind << 6 | (length - 1)
    again = kind == REPEAT
    out[at[again] + header] = data[start[again]]
    raw = kind == RAW
    many = length[raw]
    if len(many):
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(at[raw] + header, many) + inner] = data[np.repeat(start[raw], many) + inner]
    return out.tobytes()


def encode_plain(data: np.ndarray, most: int) -> bytes | None:
    """The plain encoding, or None where it is longer than `most`."""
    return _encode(data, PLAIN_LONGEST, PLAIN_REPEAT, 3, most)


def encode_packed(data: np.ndarray, most: int) -> bytes | None:
    """The packed encoding, or None where it is longer than `most`."""
    return _encode(data, PACKED_LONGEST, PACKED_REPEAT, 1, most)


def decode(body: bytes, expected: int, packed: bool = False) -> np.ndarray:
    """The bytes of an encoding, which must be `expected` many."""
    out = np.zeros(expected, np.uint8)
    at = done = 0
    header = 1 if packed else 3
    while at < len(body):
        if packed:
            kind, length = body[at] >> 6, (body[at] & 63) + 1
        else:
            if at + 3 > len(body):
                raise ValueError("a run's header breaks off")
            kind, length = body[at], body[at + 1] << 8 | body[at + 2]
        at += header
        carried = length if kind == RAW else int(kind == REPEAT)
        if kind > REPEAT or length == 0 or done + length > expected or at + carried > len(body):
            raise ValueError("a run is not valid")
        if kind == RAW:
            out[done : done + length] = np.frombuffer(body, np.uint8, length, at)
        elif kind == REPEAT:
            out[done : done + length] = body[at]
        at += carried
        done += length
    if done != expected:
        raise ValueError(f"runs give {done} bytes of {expected}")
    return out
