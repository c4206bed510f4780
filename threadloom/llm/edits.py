"""Edit distances of texts by bit-parallel columns, of one pair or many, with a cheap bound before them."""

from __future__ import annotations

import numpy as np

#: Pairs that are worked off together at least and at most, their code points, and the longest text of such a pair.
FEW, TOGETHER, POINTS, LONGEST = 24, 1024, 1 << 19, 4096
#: One more than the last code point.
NO_POINT = 0x110000
_ONE, _TOP = np.uint64(1), np.uint64(63)


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns over one long integer.

    Past ``limit`` the columns end as soon as the rest cannot bring it back: some number above it.
    """
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    most = len(b) + (len(a) + len(b) if limit is None else limit)
    for c in b:
        equal = places.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        grow, shrink = down | (every & ~(diagonal | up)), up & diagonal
        score += bool(grow & top) - bool(shrink & top)
        most -= 1
        if score > most:
            return score
        grow, shrink = (grow << 1 | 1) & every, (shrink << 1) & every
        up, down = shrink | (every & ~(diagonal | grow)), grow & diagonal
    return score


#: Words to leave out on either side until both go on alike, the fewest first.
_STEPS = ((1, 1), (0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (2, 2), (0, 3), (3, 0))


def at_most(a: str, b: str) -> int:
    """A bound that the distance does not exceed: the cost of one way from ``a`` to ``b`` by words."""
    left, right = a.split(" "), b.split(" ")
    n, m = len(left), len(right)
    i = j = cost = 0
    while i < n and j < m:
        if left[i] == right[j]:
            i, j = i + 1, j + 1
            continue
        for di, dj in _STEPS:
            if i + di < n and j + dj < m and left[i + di] == right[j + dj]:
                break
        else:
            di = dj = 1
        # a word counts with the space behind it
        cost += max(sum(map(len, left[i : i + di])) + di, sum(map(len, right[j : j + dj])) + dj)
        i, j = i + di, j + dj
    return cost + max(sum(map(len, left[i:])) + n - i, sum(map(len, right[j:])) + m - j)


def similar(a: str, b: str, percent: int) -> bool:
    """Whether 100 * (1 - distance / longer length) is at least ``percent``."""
    longer = max(len(a), len(b))
    if 100 * min(len(a), len(b)) < percent * longer:
        return False
    limit = (100 - percent) * longer // 100
    return at_most(a, b) <= limit or edit_distance(a, b, limit) <= limit


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, a row each, filled up with a value that no text has."""
    out = np.full((len(texts), max(map(len, texts))), NO_POINT, np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def distances(a: list[str], b: list[str], limits: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of pairs of texts that are not empty, a step of all pairs at a time.

    Bits are the rows of a column, 64 to a block; each block passes the horizontal difference at
    its last row on to the block below, which is a column behind, so that a step is all blocks. With ``limits``, no smaller than the difference in length,
    a distance above a pair's limit comes out as some number above it: only blocks that such a
    distance leaves room for are worked off, and pairs go once their whole column is above it.
    """
    n, rows, columns = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    left, right = _points(a), _points(b)
    known, blocks = np.flatnonzero(np.bincount(left.ravel())), -(-left.shape[1] // 64)
    codes = np.full(NO_POINT + 1, len(known))
    codes[known] = np.arange(len(known))
    code, place = codes[left], codes[right]
    pairs = np.arange(n)
    if limits is None:
        above, below, out = right.shape[1], left.shape[1], np.zeros(n, np.int64)
    else:
        out = limits + 1
        pairs = np.flatnonzero(_unmatched(code, rows, place, columns, len(known)) <= limits)
        if not len(pairs):
            return out
        rows, columns, code, place, limits = rows[pairs], columns[pairs], code[pairs], place[pairs], limits[pairs]
        above, below = int((limits + columns - rows).max()) // 2, int((limits + rows - columns).max()) // 2
    n, most = len(pairs), int(columns.max())
    equal = np.zeros((blocks, n, len(known) + 1), np.uint64)
    for row in range(int(rows.max())):
        held = np.flatnonzero(row < rows)
        equal[row // 64, held, code[held, row]] |= _ONE << np.uint64(row % 64)
    place = np.ascontiguousarray(place.T)
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    # what each block gets from above, and the value at its last row
    plus, minus = np.ones((blocks + 1, n), np.uint64), np.zeros((blocks + 1, n), np.uint64)
    score = np.repeat(np.arange(64, 64 * blocks + 1, 64)[:, None], n, axis=1)
    last = (rows - 1) // 64
    ends, moved, entered = columns - 1 + last, True, 1
    for step in range(int(ends.max()) + 1):
        if moved:
            own, moved = np.arange(n) * (len(known) + 1) + np.arange(blocks)[:, None] * (n * (len(known) + 1)), False
            flat, work, soonest = equal.reshape(-1), np.empty((6, blocks, n), np.uint64), int(ends.min())
        first, before = max(0, -((63 + above - step) // 65), step - most + 1), entered
        entered = min(blocks, step + 1, (step + below) // 65 + 1)
        if entered > before:
            # the block above is a column ahead
            score[before] = score[before - 1] + 64 - plus[before].view(np.int64) + minus[before].view(np.int64)
        now = slice(first, entered)
        eq = flat.take(place[step - entered + 1 : step - first + 1][::-1] + own[now])
        pv, mv, from_plus, from_minus = up[now], down[now], plus[now], minus[now]
        t, across, ph, mh, plus_below, minus_below = work[:, : entered - first]
        np.bitwise_or(eq, mv, out=across)
        np.bitwise_or(eq, from_minus, out=eq)
        np.add(np.bitwise_and(eq, pv, out=t), pv, out=t)
        np.bitwise_or(np.bitwise_xor(t, pv, out=t), eq, out=t)
        np.bitwise_and(pv, t, out=mh)
        np.bitwise_or(mv, np.invert(np.bitwise_or(t, pv, out=t), out=t), out=ph)
        np.right_shift(ph, _TOP, out=plus_below)
        np.right_shift(mh, _TOP, out=minus_below)
        score[now] += plus_below.view(np.int64)
        score[now] -= minus_below.view(np.int64)
        np.bitwise_or(np.left_shift(ph, _ONE, out=ph), from_plus, out=ph)
        np.bitwise_or(np.left_shift(mh, _ONE, out=mh), from_minus, out=mh)
        np.invert(np.bitwise_or(across, ph, out=t), out=t)
        np.bitwise_or(mh, t, out=pv)
        np.bitwise_and(ph, across, out=mv)
        plus[first + 1 : entered + 1], minus[first + 1 : entered + 1] = plus_below, minus_below
        # the block above the first gives nothing any more: values there only rise
        plus[first], minus[first] = 1, 0
        if step >= soonest:
            ended = np.flatnonzero(ends == step)
            at = last[ended]
            # back from the block's last row to the pair's
            past = ~np.uint64(0) << ((rows[ended] - 1) % 64).astype(np.uint64) << _ONE
            rise = np.bitwise_count(up[at, ended] & past).astype(np.int64) - np.bitwise_count(down[at, ended] & past)
            out[pairs[ended]] = score[at, ended] - rise
        if limits is not None and step % 32 == 31:
            # one less, as a path may pass between two blocks
            low = (score[now] - np.bitwise_count(up[now])).min(axis=0) - 1
            stay = np.flatnonzero(((low <= limits) | (step - first >= columns) | (first == 0 and step <= above)) & (ends > step))
            if len(stay) < 0.8 * n:
                if len(stay) < FEW:
                    for k in pairs[stay].tolist():
                        out[k] = edit_distance(a[k], b[k], int(out[k]) - 1)
                    break
                pairs, rows, columns, last, ends, limits, n, moved = pairs[stay], rows[stay], columns[stay], last[stay], ends[stay], limits[stay], len(stay), True
                equal, place, up, down, score, plus, minus = equal[:, stay], place[:, stay], up[:, stay], down[:, stay], score[:, stay], plus[:, stay], minus[:, stay]
    return out


def _unmatched(code: np.ndarray, rows: np.ndarray, place: np.ndarray, columns: np.ndarray, known: int) -> np.ndarray:
    """Characters of the longer text, wherever they are, that the shorter one lacks: no distance is smaller."""
    counts = []
    for codes, sizes in ((code, rows), (place, columns)):
        held = np.arange(codes.shape[1]) < sizes[:, None]
        at = (codes + np.arange(len(sizes))[:, None] * (known + 1))[held]
        counts.append(np.bincount(at, minlength=len(sizes) * (known + 1)).reshape(len(sizes), -1))
    same = np.minimum(*counts)[:, :known].sum(axis=1)
    return np.maximum(rows, columns) - same


def all_similar(a: list[str], b: list[str], percent: int) -> np.ndarray:
    """``similar`` of every pair; those of moderate length that the bound leaves open are worked off together."""
    out, left = np.zeros(len(a), bool), []
    for k, (x, y) in enumerate(zip(a, b)):
        longer = max(len(x), len(y))
        if not x or not y or longer > LONGEST:
            out[k] = similar(x, y, percent)
        elif 100 * min(len(x), len(y)) >= percent * longer:
            limit = (100 - percent) * longer // 100
            out[k] = at_most(x, y) <= limit
            if not out[k]:
                left.append((longer, k, limit))
    left.sort(reverse=True)
    lo = 0
    while lo < len(left):
        # the longest texts of a step set its columns and blocks
        hi, most = lo, min(TOGETHER, POINTS // left[lo][0])
        while hi < len(left) and hi - lo < most and 4 * left[hi][0] >= 3 * left[lo][0]:
            hi += 1
        _, part, limits = map(list, zip(*left[lo:hi]))
        lo = hi
        if len(part) < FEW:
            out[part] = [edit_distance(a[k], b[k], most) <= most for k, most in zip(part, limits)]
        else:
            out[part] = distances([a[k] for k in part], [b[k] for k in part], np.array(limits)) <= np.array(limits)
    return out
