"""Edit distances of many pairs of strings at a time, up to a limit of each."""

from __future__ import annotations

import numpy as np

#: Pairs that are compared together, characters of them, and cells of their table of letters, at most.
PAIRS_AT_ONCE, CHARACTERS_AT_ONCE, LETTER_CELLS = 2048, 1 << 20, 1 << 21
#: Microseconds of one column, of pairs together and of a pair of its own, the latter also for each row.
TOGETHER, ALONE, ALONE_ROW = 30.0, 0.8, 0.0007
ONES = np.uint64((1 << 64) - 1)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a column of the table at a time as bits (Myers 1999, Hyyro 2003)."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        score += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & full
        up = (left << 1 | ~(diagonal | right)) & full
        down = right & diagonal
    return score


#: Columns between two looks at whether a limit can still be kept, and rows between the cells that are looked at.
LOOK = 32
#: Looks at a pair of its own, at most.
LOOKS = 64


def at_most(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: `edit_distance` until no cell of a column leads to an end within it."""
    n, m = len(b), len(a)
    if abs(n - m) > most or not a or not b:
        return max(n, m) <= most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, up, down, get = (1 << m) - 1, (1 << m) - 1, 0, places.get
    look = max(LOOK, -(-n // LOOKS))
    for start in range(0, n, look):
        for c in b[start : start + look]:
            same = get(c, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            right = (down | full & ~(diagonal | up)) << 1 | 1
            up = (up & diagonal) << 1 | ~(diagonal | right)
            up &= full
            down = right & diagonal & full
        if not _can_end(up, down, min(start + look, n), m, n, most):
            return False
    return n + up.bit_count() - down.bit_count() <= most


def _can_end(up: int, down: int, j: int, m: int, n: int, most: int) -> bool:
    """Whether some cell of column j may lie on a way of at most `most` edits.

    Rows further than `most` from the diagonal are not on one. Rows beside each other differ by 1
    at most, so two cells tell the least between them; from a cell on, the rests' lengths tell the least.
    """
    i, high, before = max(0, j - most), min(m, j + most), -1
    while True:
        mask = (1 << i) - 1
        cell, skew = j + (up & mask).bit_count() - (down & mask).bit_count(), n - j - m + i
        if before < 0:
            if cell + abs(skew) <= most:
                return True
        else:
            away = 0 if skew - step <= 0 <= skew else min(abs(skew - step), abs(skew))
            if before + cell - step <= 2 * (most - away):
                return True
        if i == high:
            return False
        step, before = min(LOOK, high - i), cell
        i += step


def same_length(a: str, b: str) -> int:
    """How many characters both begin with, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with in common."""
    lead = same_length(a, b)
    a, b = a[lead:], b[lead:]
    tail = same_length(a[::-1], b[::-1])
    return a[: len(a) - tail], b[: len(b) - tail]


#: Words that are skipped on both sides together, at most, until two lines go on alike.
SKIPPED = 4
#: (words of one, words of the other) that may be skipped, the fewest first.
SKIPS = [(p, n - p) for n in range(1, SKIPPED + 1) for p in sorted(range(n + 1), key=lambda p, n=n: abs(2 * p - n))]


def surely_within(a: str, b: str, most: int) -> bool:
    """Whether replacing, word by word, what differs takes at most `most` edits; if not, fewer may still do."""
    one, two = a.split(" "), b.split(" ")
    i, j, n, m, total = 0, 0, len(one), len(two), 0
    while i < n and j < m:
        if one[i] == two[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(((p, q) for p, q in SKIPS if (one[i + p] == two[j + q] if i + p < n and j + q < m else (i + p, j + q) == (n, m))), (0, 0))
        if not p and not q:
            return False
        total += max(p + sum(map(len, one[i : i + p])), q + sum(map(len, two[j : j + q])))
        if total > most:
            return False
        i, j = i + p, j + q
    total += max(n - i + sum(map(len, one[i:])), m - j + sum(map(len, two[j:])))
    return total <= most


def within(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit.

    The bit columns of many pairs move on together; the longest pairs go one by one where they are too few for that.
    """
    out = np.zeros(len(pairs), bool)
    rest: list[tuple[int, str, str, int]] = []
    for i, ((a, b), k) in enumerate(zip(pairs, most, strict=True)):
        if abs(len(a) - len(b)) > k:
            continue
        a, b = trimmed(a, b)
        if max(len(a), len(b)) <= k or a and b and surely_within(a, b, k):
            out[i] = True
        elif a and b:
            rest.append((i, a, b, k) if len(a) <= len(b) else (i, b, a, k))
    rest.sort(key=lambda x: -len(x[2]))
    start = 0
    while start < len(rest):
        stop, held = start, 0
        while stop < len(rest) and stop - start < PAIRS_AT_ONCE and held < CHARACTERS_AT_ONCE:
            held += len(rest[stop][1]) + len(rest[stop][2])
            stop += 1
        batch = rest[start:stop]
        m, n = (np.array([len(x[k]) for x in batch], np.float64) for k in (1, 2))
        alone = int(np.argmin(np.concatenate([[0], np.cumsum(n * (ALONE + ALONE_ROW * m))]) + TOGETHER * np.append(n, 0)))
        for i, a, b, k in batch[:alone]:
            out[i] = at_most(a, b, k)
        if alone < len(batch):
            out[[x[0] for x in batch[alone:]]] = _together(batch[alone:])
        start = stop
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _together(batch: list[tuple[int, str, str, int]]) -> np.ndarray:
    """`within` for rows (_, a, b, most), a not empty nor longer than b, and b longer by `most` at most.

    The rows of a table are cut into pieces of 64. A piece is one column behind the piece above it, from
    which it takes how its upper edge rises, so all pieces of all pairs move on in one step. It begins and ends where a
    way of `most` edits can't be before or after; what lies outside counts as steps along its edge, which is never too little.
    """
    rows, columns = (_codes("".join(x[k] for x in batch)) for k in (1, 2))
    kind = np.zeros(1 + max(int(rows.max()), int(columns.max())), np.int64)
    kind[rows] = 1
    kinds = 1 + int(kind.sum())
    kind *= np.cumsum(kind)  # 0: no letter of any row
    m, n, most = (np.array(x, np.int64) for x in zip(*[(len(a), len(b), k) for _, a, b, k in batch], strict=True))
    many = -(-m // 64)
    if int(many.sum()) * kinds > LETTER_CELLS:
        if len(batch) == 1:
            return np.array([at_most(*batch[0][1:])])
        half = len(batch) // 2
        return np.concatenate([_together(batch[:half]), _together(batch[half:])])
    last = np.cumsum(many) - 1
    pair = np.repeat(np.arange(len(batch)), many)
    turn = np.arange(len(pair)) - (last - many + 1)[pair]
    begin = 64 * turn
    size = np.minimum(64, m[pair] - begin)
    slack = (most - (n - m)) // 2
    first = (np.maximum(0, begin - slack[pair]) + turn) // LOOK * LOOK  # the steps of a piece, from its column `first - turn` on
    until = np.minimum(n[pair], begin + 65 + (n - m + slack)[pair]) - 1 + turn
    # columns before the first hold no letter and change nothing
    text = np.zeros(len(columns) + LOOK * (len(batch) + 2), np.int64)
    text_at = np.cumsum(n) - n + LOOK * np.arange(1, len(batch) + 1)
    text[np.arange(len(columns)) + np.repeat(LOOK * np.arange(1, len(batch) + 1), n)] = kind[columns]
    rows, rows_at = kind[rows], (np.cumsum(m) - m)[pair] + begin
    one, table = np.uint64(1), np.arange(len(pair)) * kinds
    places = np.zeros(len(pair) * kinds, np.uint64)
    for k in range(int(size.max())):
        who = np.flatnonzero(size > k)
        places[table[who] + rows[rows_at[who] + k]] |= one << np.uint64(k)
    edge = (size - 1).astype(np.uint64)
    valid = ONES >> (np.uint64(63) - edge)
    up, down, score = np.full(len(pair), ONES), np.zeros(len(pair), np.uint64), begin + size
    rose, fell = np.zeros(len(pair), np.uint64), np.zeros(len(pair), np.uint64)
    ends, out, open_ = n - 1 + turn[last], np.zeros(len(batch), bool), np.ones(len(batch), bool)
    for start in range(0, int(ends.max()) + 1, LOOK):
        now = np.flatnonzero((first <= start) & (until >= start) & open_[pair])
        new = now[(first[now] == start) & (start > turn[now])]
        score[new] = score[new - 1] - (rose[new - 1].view(np.int64) - fell[new - 1].view(np.int64)) + size[new]
        # of a piece's cells none is below the mean of its ends less half its rows; the lengths that are left add to that
        skew = (n - m)[pair[now]] - (start - turn[now]) + begin[now]
        least = 2 * score[now] - _heights(up[now] & valid[now], down[now] & valid[now]) - size[now] + 2 * np.maximum(0, np.maximum(skew, -skew - size[now]))
        near = np.zeros(len(batch), bool)
        near[pair[now[least <= 2 * most[pair[now]]]]] = True
        open_ &= near
        if not open_.any():
            break
        now = now[near[pair[now]]]
        linked = np.append(False, now[1:] == now[:-1] + 1) & (turn[now] > 0)
        mask, free = np.where(linked, ONES, np.uint64(0)), np.where(linked, np.uint64(0), one)
        above, under, height, bottom, letters = up[now], down[now], score[now], edge[now], table[now]
        spot = text_at[pair[now]] + start - turn[now]
        same, high, more, less, into_more, into_less = np.empty((6, len(now)), np.uint64)
        out_more, out_less = np.append(np.uint64(0), rose[now]), np.append(np.uint64(0), fell[now])
        at = same.view(np.int64)
        ending = np.flatnonzero(open_ & (ends >= start) & (ends < start + LOOK))
        found, when = np.searchsorted(now, last[ending]), ends[ending] - start
        steps = set(when.tolist())
        for step in range(LOOK):
            np.take(text, spot, out=at, mode="clip")
            at += letters
            spot += 1
            same = np.take(places, at, mode="clip")
            np.bitwise_and(out_more[:-1], mask, out=into_more)
            into_more |= free
            np.bitwise_and(out_less[:-1], mask, out=into_less)
            vertical = same | under
            same |= into_less
            np.bitwise_and(same, above, out=high)
            high += above
            high ^= above
            high |= same
            np.bitwise_and(above, high, out=less)
            high |= above
            np.invert(high, out=more)
            more |= under
            rise, fall = out_more[1:], out_less[1:]
            np.right_shift(more, bottom, out=rise)
            rise &= one
            np.right_shift(less, bottom, out=fall)
            fall &= one
            height += rise.view(np.int64)
            height -= fall.view(np.int64)
            more <<= one
            more |= into_more
            less <<= one
            less |= into_less
            np.bitwise_and(more, vertical, out=under)
            more |= vertical
            np.invert(more, out=above)
            above |= less
            if step in steps:
                p = when == step
                out[ending[p]] = height[found[p]] <= most[ending[p]]
        up[now], down[now], score[now], rose[now], fell[now] = above, under, height, out_more[1:], out_less[1:]
        open_[ending] = False
    return out


def _heights(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The difference between a word's last row and the one above it."""
    return np.bitwise_count(up).astype(np.int64) - np.bitwise_count(down)
