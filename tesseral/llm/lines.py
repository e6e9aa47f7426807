"""Fuzzy line deduplication: SimHash blocks and MinHash bands, edit similarity, one occurrence of each group."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fill, mix64, raw_bytes, row_key, segment_hashes, slices, stream64, words_of
from .edits import within
from .graph import compared_blocks, components

#: A SimHash has BLOCKS blocks of 32 bits; lines whose hashes differ in fewer than BLOCKS bits share a block.
BLOCKS = 4
#: SimHash alone leaves most lines that differ in more than one word of fifty without a common block. So a line has
#: MinHash keys beside them, over its pairs of neighbouring words: for each of ANCHORS a minimum with the words at two
#: places (from 0, or from the end), and FREE bands of ROWS minima wherever words stand.
ANCHORS = ((0, 1), (2, 3), (0, 2), (1, 3), (-1, -2), (-3, -4), (-1, -3), (-2, -4))
FREE, ROWS = 5, 3
KEYS = BLOCKS + len(ANCHORS) + FREE
#: Bytes that are kept of a key.
KEY_BYTES = 6
#: Lines are linked when their edit distance is at most this part, in percent, of the longer one.
APART = 20
#: ASCII letters in lower case, digits as 0, line feeds as they are, all other ASCII as a space.
PLAIN = bytes(c if c >= 128 or c == 10 or 97 <= c <= 122 else 48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ZEROS = re.compile(rb"00+")


def normal_lines(text: str) -> list[bytes]:
    """The lines of a text in lower case, numbers as 0, words parted by one space, in UTF-8; empty without any word.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
    """
    plain = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN)
    if b"00" in plain:
        plain = ZEROS.sub(b"0", plain)
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    return [line.strip(b" ") for line in plain.split(b"\n")]


def normal_line(line: str) -> str:
    return normal_lines(line.replace("\n", " "))[0].decode("utf-8", "surrogatepass")


#: Lines of more distinct words than this are summed word by word and not in bit planes.
SLICED = 255


def _majority(words: np.ndarray, at: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """For each line (words from at[i] to at[i + 1]) the bits that more than half of its words' hashes have.

    Counts are kept as planes of bits, so one operation adds 64 of them: the
    k-th words of all lines are added together.
    """
    sizes = np.diff(at)
    out = np.zeros((len(sizes), len(lanes)), np.uint64)
    order = np.argsort(-sizes, kind="stable")
    for i in order[: int((sizes > SLICED).sum())].tolist():
        bits = np.zeros((len(lanes) * 64), np.int64)
        for start in range(at[i], at[i + 1], 4096):
            own = mix64(words[start : min(start + 4096, at[i + 1])][:, None] ^ lanes)
            bits += np.unpackbits(own.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * bits > sizes[i], bitorder="little").view(np.uint64)
    rest = order[int((sizes > SLICED).sum()) :]
    for block in range(0, len(rest), 4096):
        own = rest[block : block + 4096]
        size, start = sizes[own], at[own]
        planes = np.zeros((max(1, int(size.max(initial=0)).bit_length()), len(own), len(lanes)), np.uint64)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k, side="left"))  # lines of more than k words
            carry = mix64(words[start[:n] + k][:, None] ^ lanes)
            for plane in planes[: (k + 1).bit_length()]:
                plane = plane[:n]
                over = plane & carry
                plane ^= carry
                carry = over
        more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
        for b in range(len(planes) - 1, -1, -1):
            half = np.where((size // 2) >> b & 1, ~np.uint64(0), np.uint64(0))[:, None]
            more |= same & planes[b] & ~half
            same &= ~(planes[b] ^ half)
        out[own] = more
    return out


#: Word pairs whose minima are found at a time.
MINIMA_AT_ONCE = 1 << 16


#: Of pairs of words, those of fewer bytes than this come last in the order of a lane: short words are in most lines.
RARE = 8


def _bands(words: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of each MinHash key of each line (words from at[i] to at[i + 1]); both ends of a line count as words.

    A lane orders the pairs of words by their hash times an odd number of its own, pairs of short words behind the others.
    """
    sizes = np.diff(at)
    lanes = stream64(len(ANCHORS) + FREE * ROWS, 5) | np.uint64(1)
    edge = np.uint64(0x2545F4914F6CDD1D)
    # a pair begins at each word and at the line's start
    before = np.full(len(words) + len(sizes), edge)
    after = np.full(len(words) + len(sizes), edge)
    starts = at[:-1] + np.arange(len(sizes))
    inner = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    after[inner], before[inner + 1] = words, words
    pairs = mix64(mix64(before) * np.uint64(3) + after)
    size = np.zeros((2, len(before)), np.int64)
    size[0, inner + 1], size[1, inner] = lengths, lengths
    short = np.where(size.sum(axis=0) < RARE, np.uint64(1 << 63), np.uint64(0))
    least = np.empty((len(sizes), len(lanes)), np.uint64)
    ends = starts + sizes + 1
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + MINIMA_AT_ONCE, side="right")))
        own, behind = pairs[starts[first] : ends[last - 1]], short[starts[first] : ends[last - 1]]
        for k, lane in enumerate(lanes):
            least[first:last, k] = np.minimum.reduceat(own * lane >> np.uint64(1) | behind if k < len(ANCHORS) else own * lane, starts[first:last] - starts[first])
        first = last
    out = np.zeros((len(sizes), len(ANCHORS) + FREE), np.uint64)
    words = np.append(words, edge)
    for k, places in enumerate(ANCHORS):
        out[:, k] = least[:, k]
        for place in places:
            near = np.clip(place if place >= 0 else sizes + place, 0, np.maximum(sizes - 1, 0))
            out[:, k] = mix64(out[:, k] * np.uint64(5) + words[np.where(sizes > 0, at[:-1] + near, -1)])
    for k in range(ROWS):
        out[:, len(ANCHORS) :] = mix64(out[:, len(ANCHORS) :] + least[:, len(ANCHORS) + k :: ROWS] + np.uint64(k + 1))
    return out >> np.uint64(32)


#: Words that are hashed at a time, as more don't stay in the processor's cache, and bytes of a word beyond which it goes the common way.
WORDS_AT_ONCE, WORD_BYTES = 1 << 13, 64


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`segment_hashes` of seed 31, with one table of what each byte adds at each place."""
    power = np.full(WORD_BYTES, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    table = (power[:, None] * stream64(256, 31)).ravel()
    out = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), WORDS_AT_ONCE):
        begin, end = starts[k : k + WORDS_AT_ONCE], ends[k : k + WORDS_AT_ONCE]
        sizes = end - begin
        if sizes.max() > WORD_BYTES:
            out[k : k + len(begin)] = segment_hashes(data, begin, end, seed=31)
            continue
        first = np.cumsum(sizes) - sizes
        byte = np.arange(int(sizes.sum()))
        place = byte - np.repeat(first, sizes)
        byte += np.repeat(begin - first, sizes)
        place <<= 8
        place |= np.take(data, byte)
        out[k : k + len(begin)] = mix64(np.add.reduceat(np.take(table, place), first) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


#: A line's number and a word's hash share 64 bits while a line's words are told apart.
LINE_BITS = 20


def hashed_lines(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each normal line, keys of the blocks of its SimHash over its distinct words and of its MinHash bands).

    A word counts once in a SimHash, else the few words that every line repeats would decide.
    """
    if len(lines) >= 1 << LINE_BITS:
        parts = [hashed_lines(lines.slice(i, 1 << (LINE_BITS - 1))) for i in range(0, len(lines), 1 << (LINE_BITS - 1))]
        return np.concatenate([h for h, _ in parts]), np.concatenate([k for _, k in parts])
    data, offsets = raw_bytes(lines)
    starts, ends, starts_of = words_of(data, offsets)
    words = _word_hashes(data, starts, ends)
    at = starts_of
    sizes = np.diff(at)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes)
    inner = np.arange(len(words)) - np.repeat(at[:-1], sizes)
    power = np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    np.multiply.accumulate(power, out=power)
    whole = np.zeros(len(lines), np.uint64)
    full = sizes > 0
    if full.any():
        whole[full] = np.add.reduceat(words * power[inner], at[:-1][full])
    whole = mix64(whole + sizes.astype(np.uint64))
    low = np.uint64(64 - LINE_BITS)
    both = line << low | words >> np.uint64(LINE_BITS)
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
    at = np.searchsorted(both, np.arange(len(lines) + 1, dtype=np.uint64) << low)
    bits = _majority(both & ((np.uint64(1) << low) - np.uint64(1)), at, stream64(BLOCKS // 2, 77))
    keys = np.hstack([np.ascontiguousarray(bits).view(np.uint32).astype(np.uint64), _bands(words, ends - starts, starts_of)])
    return whole.view(np.int64), mix64(keys ^ (np.arange(1, KEYS + 1, dtype=np.uint64) << np.uint64(32))) >> np.uint64(64 - 8 * KEY_BYTES)


def simhash_blocks(lines: list[str]) -> np.ndarray:
    return hashed_lines(pa.array(lines, pa.string()))[1]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words: its place and its normal form's hash; at its first place here, that form's keys."""
    for whole in batches:
        for batch in slices(whole, 2, 4 << 20):
            seen: dict[bytes, int] = {}
            row, number, which = [], [], []
            for i, text in enumerate(fill(batch.column(2)).to_pylist()):
                norms = normal_lines(text)
                full = [k for k, norm in enumerate(norms) if norm]
                row += [i] * len(full)
                number += full
                which += [seen.setdefault(norms[k], len(seen)) for k in full]
            hashes, keys = hashed_lines(pa.array(list(seen), pa.binary()))
            packed = np.ascontiguousarray(keys).view(np.uint8).reshape(len(seen), KEYS, 8)[:, :, :KEY_BYTES].tobytes()
            which, row = np.array(which, np.int64), np.array(row, np.int64)
            first = np.zeros(len(which), bool)
            first[np.unique(which, return_index=True)[1]] = True
            width = KEYS * KEY_BYTES
            blocks = [packed[w * width : w * width + width] if f else None for w, f in zip(which.tolist(), first.tolist(), strict=True)]
            places = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*places, pa.array(number, pa.int32()), pa.array(hashes[which]), pa.array(blocks, pa.binary())], names=["doc_id", "row", "line_no", "line", "blocks"])


#: Parts that keys and places are dealt to, at least, and rows in a part beyond which there are more parts.
PARTS, PART_KEYS = 1024, 1 << 20
#: Lines whose keys, and occurrences whose places, are dealt together.
DEALT_AT_ONCE, PLACES_AT_ONCE = 1 << 14, 1 << 16


def _by_part(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of numbers, packed: a row for each part that has any, by the first number."""
    part = (rows[:, 0] % parts).astype(np.uint16 if parts <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    blobs = [rows[p:q].tobytes() for p, q in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True)] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "keys"])


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Of packed rows in the order of parts all rows of each part."""
    part, held = None, []
    for batch in batches:
        for own, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and own != part:
                yield np.frombuffer(b"".join(held), np.int64).reshape(-1, width)
                held.clear()
            part = own
            held.append(rows)
    if held:
        yield np.frombuffer(b"".join(held), np.int64).reshape(-1, width)


def _first_places(rows: np.ndarray) -> np.ndarray:
    """Of rows (line, doc_id, row, line_no, many) the first of each line with the sum of many."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])[: len(rows)])
    out = rows[start]
    if len(out):
        out[:, 4] = np.add.reduceat(rows[:, 4], start)
    return out


def _places(parts: int):
    """Of occurrences (line, doc_id, row, line_no) the first place of each line of many, with their number, packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            rows = np.ones((len(batch), 5), np.int64)
            for k in range(4):
                rows[:, k] = batch.column(k).to_numpy()
            held.append(rows)
            many += len(rows)
            if many >= PLACES_AT_ONCE:
                yield _by_part(_first_places(np.concatenate(held)), parts)
                held, many = [], 0
        if held:
            yield _by_part(_first_places(np.concatenate(held)), parts)

    return deal


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, doc_id, row, line_no, many) of each line, from what `_places` dealt, in the order of parts."""
    for rows in _parts(batches, 5):
        out = _first_places(rows)
        columns = [pa.array(np.ascontiguousarray(out[:, k])) for k in range(5)]
        columns[3] = columns[3].cast(pa.int32())
        yield pa.RecordBatch.from_arrays(columns, names=["line", "doc_id", "row", "line_no", "many"])


def _dealt(parts: int):
    """Of rows (line, blocks) the keys with their lines, packed: a row for each part that has any."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), DEALT_AT_ONCE):
                batch = whole.slice(start, DEALT_AT_ONCE)
                packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
                keys = np.zeros((len(packed), 8), np.uint8)
                keys[:, :KEY_BYTES] = packed
                yield _by_part(np.stack([keys.view(np.int64).reshape(-1), np.repeat(batch.column(0).to_numpy(), KEYS)], axis=1), parts)

    return deal


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, keys) in the order of parts, the (key, rep) of each part in order, without keys that occur once."""
    for both in _parts(batches, 2):
        keys, reps = both[:, 0], both[:, 1]
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        again = np.append(same, False) | np.append(False, same)
        keys, reps = keys[again], reps[order[again]]
        order = np.lexsort((reps, keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(reps[order])], names=["key", "rep"])


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rep) in order, those whose key has another rep, each once, with the key's first rep as pivot.

    One row is held at a time beside the batch, however many share a key.
    """
    held: tuple[int, int, int] | None = None  # the last row seen, and its key's first rep
    for batch in batches:
        keys, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        pivot_before = None
        if held:
            keys, reps = np.concatenate([[held[0]], keys]), np.concatenate([[held[1]], reps])
            pivot_before = held[2]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (reps[1:] != reps[:-1])
        keys, reps = keys[fresh], reps[fresh]
        start = np.ones(len(keys), bool)
        start[1:] = keys[1:] != keys[:-1]
        pivots = reps[start][np.cumsum(start) - 1]
        if pivot_before is not None:
            pivots[: int(np.argmax(start[1:])) + 1 if start[1:].any() else len(pivots)] = pivot_before
        follows = np.zeros(len(keys), bool)
        follows[:-1] = ~start[1:]
        company = (pivots != reps) | follows
        held = (int(keys[-1]), int(reps[-1]), int(pivots[-1]))
        company[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[company]) for x in (keys, reps, pivots)], names=["key", "rep", "pivot"])
    if held and held[1] != held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], names=["key", "rep", "pivot"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normal forms of those lines of a text that are asked for by number."""
    for batch in batches:
        lines, forms = [], []
        for text, asked in zip(fill(batch.column(0)), batch.column(1), strict=True):
            norms = normal_lines(text.as_py())
            for x in asked.as_py():
                lines.append(x["line"])
                forms.append(norms[x["line_no"]])
        texts = pa.array(forms, pa.binary())
        size = pa.array([len(f) for f in texts.cast(pa.string()).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), texts.cast(pa.string()), size], names=["line", "norm", "n"])


def alike(pairs: list[tuple[str, str]], apart: int) -> np.ndarray:
    """Whether 100 * edit distance <= apart * length of the longer string, for each pair."""
    linked = np.zeros(len(pairs), bool)
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[start : start + PAIRS_AT_ONCE]
        linked[start : start + len(part)] = within(part, [apart * max(len(a), len(b)) // 100 for a, b in part])
    return linked


def _unlike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least distance that rows of letter counts leave."""
    return np.maximum(np.maximum(one - two, 0).sum(axis=1), np.maximum(two - one, 0).sum(axis=1))


#: Pairs that are looked at together.
PAIRS_AT_ONCE = 8192


def _verified(apart: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = alike(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), apart)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return verify


def _letter_counts(lines: list[str]) -> np.ndarray:
    """How often each class of characters occurs in each line."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 64
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(owner * 64 + code, minlength=len(lines) * 64).reshape(len(lines), 64).astype(np.int32)


#: Comparisons of keys that are made in one step.
KEYS_AT_ONCE = 1 << 18


def _candidates(left: np.ndarray, right: np.ndarray, apart: int, keys: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the lines left and right that share a key, are of different roots and whose lengths are near enough."""
    found, step = [], max(1, KEYS_AT_ONCE // (len(right) * keys.shape[1]))
    n, m = sizes[left], sizes[right]
    near = (np.abs(n[:, None] - m[None, :]) * 100 <= apart * np.maximum(n[:, None], m[None, :])) & (roots[left][:, None] != roots[right][None, :])
    own, other = keys[left], keys[right]
    i, j = np.nonzero(near)
    for k in range(0, len(i), step * len(right)):
        p, q = i[k : k + step * len(right)], j[k : k + step * len(right)]
        found.append(np.flatnonzero((own[p] == other[q]).any(axis=1)) + k)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return left[i[at]], right[j[at]]


#: Bytes of lines whose keys are found, and whose pairs are tried, together.
LOT_BYTES = 4 << 20


#: (rep of each line of a block, its root, its normal form)
Members = tuple[np.ndarray, np.ndarray, list[str]]


def _members(column: pa.ListArray) -> Iterator[Members]:
    """The lines of each block, a list of structs (rep, root, norm)."""
    lines, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
    reps, roots, norms = (lines.field(k) for k in range(3))
    reps, roots, norms = reps.to_numpy(), roots.to_numpy(), norms.to_pylist()
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield reps[start:end], roots[start:end], norms[start:end]


def _compared(apart: int):
    """Links between two blocks of lines: for each two roots of lines that have any, at least one.

    Lines that share no key are no candidates. Of two roots' candidates the
    first is tried, then, where it isn't alike, some more at a time; many small
    pairs of blocks are worked on together, a line or pair that several have once.
    """

    def links(lot: list[tuple[Members, Members]]) -> tuple[list[int], list[int]]:
        blocks = [block for pair in lot for block in pair]
        norms = [x for block in blocks for x in block[2]]
        reps, first, which = np.unique(np.concatenate([b[0] for b in blocks]), return_index=True, return_inverse=True)
        texts = [norms[k] for k in first.tolist()]
        keys, counts = simhash_blocks(texts), _letter_counts(texts)
        sizes, roots = np.array([len(t) for t in texts]), np.concatenate([b[1] for b in blocks])[first]
        at, found = 0, [np.zeros(0, np.int64)]
        for left, right in lot:
            middle, end = at + len(left[0]), at + len(left[0]) + len(right[0])
            i, j = _candidates(which[at:middle], which[middle:end], apart, keys, sizes, roots)
            found.append(np.minimum(i, j) * len(texts) + np.maximum(i, j))
            at = end
        i, j = np.divmod(np.unique(np.concatenate(found)), len(texts))
        most = apart * np.maximum(sizes[i], sizes[j]) // 100
        # a candidate whose letters alone are too far apart goes before any turn
        kept = [k + np.flatnonzero(_unlike(counts[i[k : k + PAIRS_AT_ONCE]], counts[j[k : k + PAIRS_AT_ONCE]]) <= most[k : k + PAIRS_AT_ONCE]) for k in range(0, len(i), PAIRS_AT_ONCE)]
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        i, j, most = i[kept], j[kept], most[kept]
        low, high = np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])
        order = np.lexsort((high, low))
        i, j, most, low, high = i[order], j[order], most[order], low[order], high[order]
        start = np.ones(len(i), bool)
        start[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(start) - 1
        done = np.zeros(int(start.sum()), bool)
        turn, at_once = np.arange(len(i)) - np.flatnonzero(start)[group], 1
        a, b = [], []
        while len(i):
            now = turn < at_once
            linked = within([(texts[p], texts[q]) for p, q in zip(i[now].tolist(), j[now].tolist(), strict=True)], most[now].tolist())
            won = np.flatnonzero(now)[linked]
            _, first = np.unique(group[won], return_index=True)
            a += reps[i[won[first]]].tolist()
            b += reps[j[won[first]]].tolist()
            done[group[won]] = True
            rest = ~now & ~done[group]
            i, j, most, group, turn = i[rest], j[rest], most[rest], group[rest], turn[rest] - at_once
            at_once *= 4
        return a, b

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(lot: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(lot)], names=["a", "b"])

        lot, held = [], 0
        for batch in batches:
            for pair in zip(_members(batch.column(0)), _members(batch.column(1)), strict=True):
                lot.append(pair)
                held += sum(len(x) for block in pair for x in block[2])
                if held >= LOT_BYTES:
                    yield result(lot)
                    lot, held = [], 0
        if lot:
            yield result(lot)

    return compare


#: Bytes of lines that are compared with as many others at a time.
BLOCK_BYTES = 128 << 10


def line_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", apart: int = APART) -> tuple[DataFrame, DataFrame]:
    """Lines of all docs: occurrences (doc_id, row, line_no, line) and keepers (line, doc_id, row, line_no, root, total) of repeated ones.

    Lines are parted by line feeds and equal when their normal forms are: lower
    case, every number as 0, everything between words as one space. Different
    forms are linked when they share a block of their SimHashes or a MinHash
    band and their edit distance is at most `apart` percent of the longer one;
    groups are what links reach. Every member of a bucket is compared with the
    bucket's first; where members are then still apart, they are compared block by
    block, so no link between candidates is lost and no pair of lines is a row. The keeper
    is the first occurrence, by doc_id, row, then line_no, in a form's group; row is a hash
    of the text and tells rows of one id apart (rows alike in both count as one place).
    Lines without words belong to no group. Null and empty texts have no lines;
    rows without an id are left as they are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text <> ''").select("doc_id", row_key(F.col("text")).alias("row"), "text")
    found = scratch.write(rows.mapInArrow(_occurrences, "doc_id long, row long, line_no int, line long, blocks binary"), "found")
    parts = max(PARTS, found.count() // PART_KEYS)
    dealt = found.select("line", "doc_id", "row", "line_no").mapInArrow(_places(parts), "part int, keys binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    forms = scratch.write(dealt.mapInArrow(_forms, "line long, doc_id long, row long, line_no int, many long"), "forms")
    forms = forms.select("line", F.struct("doc_id", "row", "line_no").alias("first"), "many")
    parts = max(PARTS, forms.count() * KEYS // PART_KEYS)
    dealt = found.where("blocks is not null").select("line", "blocks").mapInArrow(_dealt(parts), "part int, keys binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    members = scratch.write(dealt.mapInArrow(lambda batches: _company(_ordered(batches)), "key long, rep long, pivot long"), "members")

    # only lines with company are read again, from the text of their first place
    asked = members.select(F.col("rep").alias("line")).distinct().join(forms, "line")
    asked = asked.groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct("line", F.col("first.line_no").alias("line_no"))).alias("asked"))
    read = rows.join(asked, ["doc_id", "row"]).select("text", "asked").mapInArrow(_texts, "line long, norm string, n long")
    wanted = scratch.write(read.dropDuplicates(["line"]), "wanted")  # rows may repeat

    sizes = wanted.select("line", "n")
    pairs = members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(sizes.withColumnsRenamed({"line": "a", "n": "p"}), "a").join(sizes.withColumnsRenamed({"line": "b", "n": "q"}), "b")
    pairs = pairs.where((F.greatest("p", "q") - F.least("p", "q")) * 100 <= F.greatest("p", "q") * apart).select("a", "b")
    full = pairs.join(wanted.select(F.col("line").alias("a"), F.col("norm").alias("x")), "a")
    full = full.join(wanted.select(F.col("line").alias("b"), F.col("norm").alias("y")), "b")
    links = scratch.write(full.select("a", "b", "x", "y").mapInArrow(_verified(apart), "a long, b long"), "links")
    roots = scratch.write(components(links, scratch, "stars"), "roots")

    named = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = scratch.write(named, "named")
    split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = named.join(split, "key", "left_semi").select("pivot", "rep", "root").distinct()
    centre = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pr"))
    open_ = open_.join(centre, "pivot", "left").select("pivot", "rep", "root", (F.col("root") != F.coalesce("pr", "pivot")).alias("outside"))
    own = wanted.select(F.col("line").alias("rep"), "norm")
    rest = scratch.write(compared_blocks(scratch.write(open_, "open"), own, "norm", BLOCK_BYTES, _compared(apart), scratch), "links-rest")
    scratch.drop("members", "named", "open", "lefts", "rights", "wanted")
    if not rest.isEmpty():
        roots = scratch.write(components(links.union(rest), scratch, "stars-rest"), "roots-rest")

    # a line that occurs once and is linked with none is in no group of more
    linked = roots.select(F.col("node").alias("line"), "root").union(roots.select(F.col("root").alias("line"), "root").distinct())
    grouped = forms.join(linked, "line", "left").where("many > 1 or root is not null").withColumn("root", F.coalesce("root", "line"))
    grouped = scratch.write(grouped, "grouped")
    groups = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.sum("many").alias("total")).where("total > 1")
    keepers = grouped.join(groups, "root").select("line", "keep.doc_id", "keep.row", "keep.line_no", "root", "total")
    return found.select("doc_id", "row", "line_no", "line"), scratch.write(keepers, "keepers")


def _marked(docs: DataFrame, **options) -> DataFrame:
    """The rows of `duplicate_lines` with the document row's key."""
    found, keepers = line_groups(docs, **options)
    keepers = keepers.select("line", "root", F.col("doc_id").alias("keep_doc"), F.col("row").alias("keep_row"), F.col("line_no").alias("keep_line"))
    kept = (F.col("doc_id") == F.col("keep_doc")) & (F.col("row") == F.col("keep_row")) & (F.col("line_no") == F.col("keep_line"))
    return found.join(keepers, "line").select("doc_id", "row", "line_no", "root", kept.alias("kept"))


def duplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, line_no, root, kept) of every line that has a like one; kept for the one occurrence that stays."""
    return _marked(docs, **options).drop("row")


def _per_row(marked: DataFrame) -> DataFrame:
    """(_id, _row, _lines, _gone): the numbers of each row's repeated lines and of those that go."""
    gone = F.collect_set(F.when(~F.col("kept"), F.col("line_no")))
    return marked.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.size(F.collect_set("line_no")).alias("_lines"), F.sort_array(gone).alias("_gone"))


def summary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_dropped, dropped) for each row of docs.

    n_lines counts the pieces between line feeds, 0 for an empty text;
    n_repeated those with a like line anywhere; dropped lists the numbers, from
    0, of those that go. Rows of one id with different texts have their own counts;
    of rows alike in id and text the same lines stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    many = F.when(text == "", 0).otherwise(feeds + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text).alias("row"), many.cast("long").alias("n_lines"))
    per = _per_row(_marked(docs, id_col=id_col, text_col=text_col, **options))
    out = rows.join(per, (rows["doc_id"] == per["_id"]) & (rows["row"] == per["_row"]), "left")
    number = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    dropped = F.array_join(F.col("_gone").cast("array<string>"), ",")
    return out.select("doc_id", "n_lines", number(F.col("_lines")).alias("n_repeated"), number(F.size("_gone")).alias("n_dropped"), F.coalesce(dropped, F.lit("")).alias("dropped"))


def drop_duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the lines that go, with their own columns; null texts stay null."""
    per = _per_row(_marked(docs, id_col=id_col, text_col=text_col, **options)).where("size(_gone) > 0")
    joined = docs.join(per, (docs[id_col].cast("long") == per["_id"]) & (row_key(docs[text_col].cast("string")) == per["_row"]), "left")
    left = F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.array_contains(per["_gone"], i))
    text = F.when(per["_gone"].isNull(), docs[text_col]).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
