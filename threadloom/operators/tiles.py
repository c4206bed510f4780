"""Every query with every row, tile by tile as matrices: only what a query keeps leaves a task.

Queries come in blocks (see ``retrieval.blocks_of``) that all tasks get; the table's rows stay where
they are dealt. A task holds one tile of pairs at a time and the best ``k`` rows of each query so
far. A matrix product says which pairs may belong to them, within a bound of its rounding; these
alone are scored as the expressions in ``functions.vectors`` do, term by term, and rounded as Spark
does. So scores, ties and ranks are those of the expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Queries and rows of a tile, and pairs that are scored at once.
HIGH, WIDE, AT_ONCE = 1024, 4096, 1 << 17
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_NULL = np.iinfo(np.int64).min
_UNIT = Decimal("0.000001")


def rounded(x: np.ndarray) -> np.ndarray:
    """``x`` to six places as Spark rounds: half away from zero, by the shortest decimal that names the number."""
    with np.errstate(all="ignore"):
        scaled = x * 1e6
        out = np.rint(scaled) / 1e6 + 0.0
        unsure = (np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-3) | (np.abs(scaled) > 1e14)
    for i in np.flatnonzero(unsure & np.isfinite(x)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(_UNIT, ROUND_HALF_UP)) if abs(x[i]) < 1e15 else x[i]
    return out


def summed(products: np.ndarray) -> np.ndarray:
    """Sums over the last axis, one term after the other."""
    return np.add.accumulate(products, axis=-1)[..., -1] if products.shape[-1] else np.zeros(products.shape[:-1])


def whole(column) -> pa.Array:
    """A column in one piece."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def by_width(column: pa.Array, kind: type = np.float64) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(width, places, matrix)`` of a column of vectors; width -1: null, or with a null in it."""
    column = whole(column)
    starts = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(starts)
    values = column.values
    if values.null_count:
        holes = np.cumsum(np.concatenate([[0], values.is_null().to_numpy(zero_copy_only=False)]))
        sizes = np.where(holes[starts[1:]] > holes[starts[:-1]], -1, sizes)
        values = values.fill_null(0)
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, sizes)
    flat = values.to_numpy(zero_copy_only=False).astype(kind)
    out = []
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        out.append((int(width), at, flat[starts[at][:, None] + np.arange(max(width, 0))]))
    return out


def plain(column: pa.Array) -> np.ndarray:
    """A column as numbers, or as objects that sort like it; nulls sort first."""
    column = whole(column)
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False) if column.null_count else column.cast(pa.int64()).to_numpy()
    return np.array([("", "") if x is None else (" ", x) for x in column.to_pylist()] + [None], dtype=object)[:-1]


def back(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The column that ``plain`` read."""
    if pa.types.is_integer(kind):
        return pa.array(values, pa.int64(), mask=values == _NULL).cast(kind)
    return pa.array([x[1] if x[0] else None for x in values], kind)


def _codes(values: np.ndarray) -> np.ndarray:
    """Numbers that sort like ``values``."""
    if values.dtype != object:
        return values
    place = {x: i for i, x in enumerate(sorted(set(values)))}
    return np.fromiter((place[x] for x in values), np.int64, len(values))


class Best:
    """The best ``k`` of each query so far: score, then the first column; ``once``: one row for each of its values, by score, then the second column."""

    def __init__(self, n: int, k: int, kinds: list[pa.DataType], once: bool):
        self.k, self.kinds, self.once = k, kinds, once
        self.score = np.full((n, k), -np.inf)
        self.known = np.zeros((n, k), bool)
        self.columns = [np.zeros((n, k), np.int64 if pa.types.is_integer(t) else object) for t in kinds]

    def add(self, query: np.ndarray, score: np.ndarray, columns: list[np.ndarray]) -> None:
        asked, query = np.unique(query, return_inverse=True)
        have = self.known[asked]
        query = np.concatenate([np.nonzero(have)[0], query])
        score = np.concatenate([self.score[asked][have], score])
        columns = [np.concatenate([old[asked][have], new]) for old, new in zip(self.columns, columns)]
        first = _codes(columns[0])
        if self.once:
            order = np.lexsort((_codes(columns[1]), -score, first, query))
            q, f = query[order], first[order]
            order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (f[1:] != f[:-1])])]
            order = order[np.lexsort((first[order], -score[order], query[order]))]
        else:
            order = np.lexsort((first, -score, query))
        q = query[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = (x[place < self.k] for x in (order, q, place))
        self.known[asked], self.score[asked] = False, -np.inf
        self.known[asked[q], place], self.score[asked[q], place] = True, score[order]
        for old, new in zip(self.columns, columns):
            old[asked[q], place] = new[order]

    def meet(self, queries: np.ndarray, guess: np.ndarray, out: Out, slack: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: list[np.ndarray], worst, least: np.ndarray | None = None, shift: float = 0.0) -> None:
        """Take in a tile: ``guess`` less ``shift`` lies within ``slack`` of the score that ``exact`` gives a pair's places.

        ``out`` are pairs that don't count. With ``once`` the tile's rows are sorted by the first
        column. ``least`` is a score that others are known to reach, ``worst`` the least of all guesses.
        """
        if not guess.size:
            return
        if out.matrix is not None:
            np.copyto(guess, worst, where=out.matrix)
        if out.pairs is not None:
            guess[out.pairs] = worst
        full = self.known[queries, -1]
        # equal scores may differ by a unit of the last place before they are rounded
        margin = slack + 1e-6 if slack else 0.0
        bar = np.where(full, self.score[queries, -1], -np.inf) if least is None else np.where(full, np.fmax(self.score[queries, -1], least), np.fmax(least, -np.inf))
        bar = bar - margin + shift
        open_ = np.isneginf(bar)
        if open_.any():
            some = guess[open_]
            if guess.dtype.kind == "f":
                some[some == np.inf] = -np.inf  # may be any score
            if self.once:
                first = _codes(columns[0])
                some = np.maximum.reduceat(some, np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), axis=1)
            if some.shape[1] >= self.k:
                at = some.shape[1] - self.k
                bar[open_] = np.partition(some, at, axis=1)[:, at].astype(float) - slack - margin
        # in the guesses' own kind, and never higher
        if guess.dtype == np.float32:
            low = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
        else:
            low = bar if guess.dtype.kind == "f" else np.maximum(bar, worst).astype(guess.dtype)
        hits, wide = np.flatnonzero(guess >= low[:, None]), guess.shape[1]
        if (low <= worst).any():
            if out.matrix is not None:
                hits = hits[~out.matrix.ravel()[hits]]
            if out.pairs is not None:
                hits = np.setdiff1d(hits, out.pairs[0] * wide + out.pairs[1])
        for a in range(0, len(hits), AT_ONCE):
            q, t = np.divmod(hits[a : a + AT_ONCE], wide)
            self.add(queries[q], exact(q, t), [c[t] for c in columns])

    def batches(self, asked: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
        query, place = np.nonzero(self.known)
        for a in range(0, len(query), 1 << 16):
            q, p = query[a : a + (1 << 16)], place[a : a + (1 << 16)]
            score = self.score[q, p]
            out = [whole(asked.column(c).take(pa.array(q))) for c in keys]
            out += [back(c[q, p], kind) for c, kind in zip(self.columns, self.kinds)]
            out.append(pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf))
            yield pa.RecordBatch.from_arrays(out, [*keys, *[f"c{k}" for k in range(len(self.kinds))], "score"])


class Out(NamedTuple):
    """Pairs of a tile that don't count: a matrix, and places."""

    matrix: np.ndarray | None = None
    pairs: tuple[np.ndarray, np.ndarray] | None = None


class Left:
    """Which pairs a block of queries leaves out: keys that a query has in ``_gone``, rows of another ``_same``; null ones may be ``open`` to all."""

    def __init__(self, asked: pa.Table, open_: bool):
        self.open, self.n, self.gone, self.same = open_, asked.num_rows, None, None
        if "_gone" in asked.column_names:
            lists = asked.column("_gone").to_pylist()
            self.who = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
            self.gone = [y for x in lists for y in x or ()]
        if "_same" in asked.column_names:
            self.same = asked.column("_same").to_pylist()

    def of(self, rows: pa.RecordBatch, order: np.ndarray) -> Callable[[np.ndarray, int, int], Out]:
        """What goes of ``(queries, start, end)``, places of rows in ``order``."""
        pairs = codes = None
        if self.gone:
            keys, at = field(rows, "_gone").to_pylist(), {}
            for i, r in enumerate(order):
                if keys[r] is not None:
                    at.setdefault(keys[r], []).append(i)
            pairs = np.array([(q, i) for q, x in zip(self.who, self.gone) if x in at for i in at[x]], np.int64).reshape(-1, 2)
        if self.same is not None:
            own = field(rows, "_same").to_pylist()
            place = {x: i for i, x in enumerate({*own, *self.same} - {None})}
            codes = np.array([place.get(x, -1) for x in self.same]), np.array([place.get(own[i], -2) for i in order])

        def out(queries: np.ndarray, start: int, end: int) -> Out:
            matrix = found = None
            if codes is not None:
                own = codes[0][queries]
                matrix = own[:, None] != codes[1][None, start:end]
                if self.open:
                    matrix[own == -1] = False
            if pairs is not None and len(pairs):
                row = np.full(self.n, -1)
                row[queries] = np.arange(len(queries))
                mine = pairs[(pairs[:, 1] >= start) & (pairs[:, 1] < end)]
                mine = mine[row[mine[:, 0]] >= 0]
                found = (row[mine[:, 0]], mine[:, 1] - start) if len(mine) else None
            return Out(matrix, found)

        return out


class Cosines:
    """Vectors of one width with what their cosines take."""

    def __init__(self, width: int, matrix: np.ndarray):
        self.width, self.matrix = width, matrix
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(summed(matrix * matrix))
            # beyond these, norms or their products leave the range in which a product of matrices tells anything
            self.odd = ~((self.norm == 0) | ((self.norm > 1e-150) & (self.norm < 1e150)))
            self.unit = np.where((self.norm > 0)[:, None] & ~self.odd[:, None], matrix / self.norm[:, None], 0).astype(np.float32)

    def guess(self, own: np.ndarray, other: Cosines) -> np.ndarray:
        if self.width != other.width or self.width < 1:
            return np.zeros((len(own), len(other.norm)), np.float32)
        out = self.unit[own] @ other.unit.T
        if self.odd[own].any() or other.odd.any():
            out[self.odd[own][:, None] | other.odd[None, :]] = np.inf
        return out

    @property
    def slack(self) -> float:
        return (max(self.width, 0) + 16) * 2.0**-23

    def exact(self, own: np.ndarray, other: Cosines, at: np.ndarray) -> np.ndarray:
        """Rounded scores of pairs; NaN, which sorts before all, as infinity."""
        if self.width != other.width or self.width < 1:
            return np.zeros(len(own))
        with np.errstate(all="ignore"):
            sizes = self.norm[own] * other.norm[at]
            score = rounded(summed(self.matrix[own] * other.matrix[at]) / sizes)
            return np.where(sizes <= 0, 0.0, np.where(np.isnan(score), np.inf, score))


def field(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def _tiles(rows: pa.RecordBatch, first: np.ndarray, bucket: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(width, places, matrix, bucket)`` of rows that one tile takes at most, sorted by ``first``."""
    for width, at, matrix in by_width(field(rows, "_vector")):
        order = np.lexsort((_codes(first[at]), bucket[at])) if bucket is not None else np.argsort(_codes(first[at]), kind="stable")
        at, matrix = at[order], matrix[order]
        ends = [len(at)] if bucket is None else [*(np.flatnonzero(np.diff(bucket[at])) + 1), len(at)]
        begin = 0
        for end in ends:
            for a in range(begin, end, WIDE):
                b = min(a + WIDE, end)
                yield width, at[a:b], matrix[a:b], -1 if bucket is None else int(bucket[at[a]])
            begin = end


def closest(asked: Callable[[], pa.Table], keys: list[str], names: list[str], k: int, once: bool, open_: bool, probing: Callable[[pa.Table], Callable[[int], np.ndarray]] | None = None) -> Task:
    """A task's part of ``retrieval.closest``: each query's best ``k`` rows by cosine among the task's own.

    ``names`` are the rows' columns that go along, the one that tells equal scores apart first.
    ``probing`` says which queries meet a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = asked()
        parts = [(at, Cosines(width, matrix)) for width, at, matrix in by_width(asking.column("_vector"))]
        left, found = Left(asking, open_), None
        least = asking.column("_least").to_numpy().astype(float) if "_least" in asking.column_names else None
        met = probing(asking) if probing else None
        for rows in batches:
            fields = [field(rows, c) for c in names]
            found = found or Best(asking.num_rows, k, [f.type for f in fields], once)
            columns = [plain(f) for f in fields]
            tiles = list(_tiles(rows, columns[0], field(rows, "bucket").to_numpy(zero_copy_only=False) if met else None))
            out, start = left.of(rows, np.concatenate([at for _, at, _, _ in tiles]) if tiles else np.zeros(0, int)), 0
            for width, at, matrix, bucket in tiles:
                other, own = Cosines(width, matrix), [c[at] for c in columns]
                going = met(bucket) if met else None
                for places, part in parts:
                    chosen = np.arange(len(places)) if going is None else np.flatnonzero(going[places])
                    for a in range(0, len(chosen), HIGH):
                        mine = chosen[a : a + HIGH]
                        queries = places[mine]
                        exact = lambda q, t: part.exact(mine[q], other, t)  # noqa: E731, B023
                        found.meet(queries, part.guess(mine, other), out(queries, start, start + len(at)), part.slack, exact, own, -np.inf, None if least is None else least[queries])
                start += len(at)
        if found:
            yield from found.batches(asking, keys)

    return run


def ahead(asked: Callable[[], pa.Table], keys: list[str]) -> Task:
    """How many of a task's rows come before each query's row ``_id`` of the score ``_top`` (null: it has none), and how many it meets: ``keys, met, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = asked()
        parts = [(at, Cosines(width, matrix)) for width, at, matrix in by_width(asking.column("_vector"))]
        top, first = asking.column("_top").to_numpy().astype(float), plain(asking.column("_id"))
        left, before, met = Left(asking, False), np.zeros(asking.num_rows, np.int64), np.zeros(asking.num_rows, np.int64)
        none = np.isnan(top)
        top = np.where(none, np.inf, top)
        for rows in batches:
            ids = plain(field(rows, "vec_id"))
            tiles = list(_tiles(rows, ids, None))
            out, start = left.of(rows, np.concatenate([at for _, at, _, _ in tiles]) if tiles else np.zeros(0, int)), 0
            for width, at, matrix, _ in tiles:
                other, end = Cosines(width, matrix), start + len(at)
                for places, part in parts:
                    for a in range(0, len(places), HIGH):
                        mine = np.arange(a, min(a + HIGH, len(places)))
                        queries = places[mine]
                        guess, gone = part.guess(mine, other), out(queries, start, end).pairs
                        met[queries] += len(at)
                        if gone is not None:
                            guess[gone] = -np.inf
                            np.subtract.at(met, queries[gone[0]], 1)
                        low = np.nextafter((top[queries] - 1e-6 - part.slack).astype(np.float32), np.float32(-np.inf))
                        hits = np.flatnonzero(guess >= low[:, None])
                        for c in range(0, len(hits), AT_ONCE):
                            q, t = np.divmod(hits[c : c + AT_ONCE], len(at))
                            near = guess[q, t]
                            sure = (near - part.slack > top[queries[q]] + 1e-6) & (near < np.inf)
                            check = np.flatnonzero(~sure & ~none[queries[q]])
                            score, asker = part.exact(mine[q[check]], other, t[check]), queries[q[check]]
                            wins = (score > top[asker]) | ((score == top[asker]) & (ids[at[t[check]]] < first[asker]))
                            before += np.bincount(queries[q[sure]], minlength=len(before)) + np.bincount(asker[wins], minlength=len(before))
                start = end
        if asking.num_rows:
            yield pa.RecordBatch.from_arrays([*[whole(asking.column(c)) for c in keys], pa.array(met), pa.array(before.astype(float))], [*keys, "met", "score"])

    return run


_FACTOR, _MASK = 2654435761, 0xFFFFFFFF


def drawn(asked: Callable[[], pa.Table], keys: list[str], n: int, open_: bool) -> Task:
    """A task's part of ``retrieval.draw``: each event's ``n`` rows of the smallest keys among the task's own; the score is the key below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = asked()
        seed = plain(asking.column("seed"))
        left, found = Left(asking, open_), None
        for rows in batches:
            fields = [field(rows, "vec_id"), field(rows, "row_no")]
            found = found or Best(asking.num_rows, n, [f.type for f in fields], False)
            columns = [plain(f) for f in fields]
            number = columns[1]
            out = left.of(rows, np.arange(len(number)))
            below = len(number) and len(seed) and int(number.min()) + int(seed.min()) < 0
            for a in range(0, len(number), WIDE):
                b = min(a + WIDE, len(number))
                for c in range(0, len(seed), HIGH):
                    queries = np.arange(c, min(c + HIGH, len(seed)))
                    if below:
                        x = seed[queries][:, None] + number[None, a:b]
                        key = (np.abs(x).astype(np.uint64) & np.uint64(_MASK)) * np.uint64(_FACTOR) & np.uint64(_MASK)
                        guess, shift = -np.sign(x) * key.astype(np.int64), 0
                    else:
                        guess = ~((seed[queries].astype(np.uint32)[:, None] + number[a:b].astype(np.uint32)[None, :]) * np.uint32(_FACTOR))
                        shift = _MASK
                    exact = lambda q, t: guess[q, t].astype(float) - shift  # noqa: E731, B023
                    found.meet(queries, guess, out(queries, a, b), 0.0, exact, [x[a:b] for x in columns], shift - _MASK, shift=shift)
        if found:
            yield from found.batches(asking, keys)

    return run


def _words(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Sign codes as vectors of 1 and -1 by their number of words; equal bits of two less different ones are their product."""
    out = []
    for width, at, words in by_width(column, np.int64):
        bits = np.unpackbits(np.ascontiguousarray(words.astype("<i8")).view(np.uint8).reshape(len(at), -1), axis=1) if width > 0 else np.zeros((len(at), 0), np.uint8)
        out.append((width, at, bits.astype(np.float32) * 2 - 1))
    return out


def _far(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs; products of up to 2^24 bits are exact."""
    return ((own.shape[1] - own @ other.T) / 2).astype(np.int32)


def distances(asked: Callable[[], pa.Table], keys: list[str]) -> Task:
    """How many of a task's rows each query has at each distance of sign codes (null: codes of another length): ``keys, distance, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = asked()
        parts = [(width, at, bits) for width, at, bits in _words(asking.column("_sign"))]
        counts = {i: np.zeros((len(at), bits.shape[1] + 2), np.int64) for i, (_, at, bits) in enumerate(parts)}
        for rows in batches:
            for width, at, other in _words(field(rows, "_sign")):
                for i, (own_width, _, own) in enumerate(parts):
                    if own_width != width or width < 1:
                        counts[i][:, -1] += len(at)
                        continue
                    wide = own.shape[1] + 2
                    for a in range(0, len(at), WIDE):
                        for b in range(0, len(own), HIGH):
                            far = _far(own[b : b + HIGH], other[a : a + WIDE])
                            far += np.arange(len(far), dtype=np.int32)[:, None] * wide
                            counts[i][b : b + HIGH] += np.bincount(far.ravel(), minlength=len(far) * wide).reshape(-1, wide)
        for i, (_, at, _) in enumerate(parts):
            query, distance = np.nonzero(counts[i])
            none = distance == counts[i].shape[1] - 1
            for a in range(0, len(query), 1 << 16):
                q = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([*[whole(asking.column(c).take(pa.array(at[query[q]]))) for c in keys], pa.array(distance[q].astype(np.int32), mask=none[q]), pa.array(counts[i][query[q], distance[q]].astype(float))], [*keys, "distance", "score"])

    return run


def reranked(asked: Callable[[], pa.Table], keys: list[str], names: list[str], k: int, once: bool) -> Task:
    """A task's part of ``retrieval.shortlisted``: each query's best ``k`` rows by int8 codes among those within its ``_radius``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = asked()
        found, radius = None, asking.column("_radius").to_numpy().astype(float)
        signs = {int(i): (width, bits[j]) for width, at, bits in _words(asking.column("_sign")) for j, i in enumerate(at)}
        parts = []
        for width, at, matrix in by_width(asking.column("_vector")):
            for words in {signs[int(i)][0] for i in at}:
                mine = np.array([j for j, i in enumerate(at) if signs[int(i)][0] == words])
                parts.append((width, words, at[mine], matrix[mine], np.stack([signs[int(i)][1] for i in at[mine]])))
        for rows in batches:
            fields = [field(rows, c) for c in names]
            found = found or Best(asking.num_rows, k, [f.type for f in fields], once)
            columns = [plain(f) for f in fields]
            scale = field(rows, "scale").to_numpy(zero_copy_only=False).astype(float)
            row_signs = {int(i): (width, bits[j]) for width, at, bits in _words(field(rows, "_sign")) for j, i in enumerate(at)}
            for width, at, codes in by_width(field(rows, "_code")):
                order = np.argsort(_codes(columns[0][at]), kind="stable")
                at, codes = at[order], codes[order]
                for a in range(0, len(at), WIDE):
                    here, code = at[a : a + WIDE], codes[a : a + WIDE]
                    own = [c[here] for c in columns]
                    words = np.array([row_signs[int(i)][0] for i in here])
                    for query_width, query_words, places, matrix, bits in parts:
                        fit = np.flatnonzero(words == query_words)
                        if query_words < 1 or not len(fit):
                            continue
                        other = np.stack([row_signs[int(here[i])][1] for i in fit])
                        dense = code[fit] * scale[here[fit]][:, None]
                        for b in range(0, len(places), HIGH):
                            queries, asks = places[b : b + HIGH], matrix[b : b + HIGH]
                            near = _far(bits[b : b + HIGH], other) <= radius[queries][:, None]
                            # vectors of other widths have no score and come last
                            sound = query_width == width and np.isfinite(asks).all() and np.isfinite(dense).all()
                            guess = asks @ dense.T if sound else np.full(near.shape, np.inf)
                            slack = 1e-13 * (width + 16) * float(np.abs(asks).sum(1).max() * np.abs(dense).max() + 1e-9) if sound and guess.size else 1e-9

                            def exact(q: np.ndarray, t: np.ndarray) -> np.ndarray:
                                if query_width != width:  # noqa: B023
                                    return np.full(len(q), -np.inf)
                                with np.errstate(all="ignore"):
                                    score = rounded(summed(asks[q] * code[fit[t]]) * scale[here[fit[t]]])  # noqa: B023
                                return np.where(np.isnan(score), np.inf, score)

                            found.meet(queries, guess, Out(~near), slack, exact, [c[fit] for c in own], -np.inf)
        if found:
            yield from found.batches(asking, keys)

    return run


def probing(centers: list[tuple[int, list[float] | None, float]], probes: int, rest: bool, slack: float) -> Callable[[pa.Table], Callable[[int], np.ndarray]]:
    """Which queries meet a bucket of ``vector_index``: its ``probes`` nearest ones, or of the ``rest`` those that may reach the query's ``_least``.

    ``centers``: bucket, middle and cone.
    """

    def of(asking: pa.Table) -> Callable[[int], np.ndarray]:
        buckets = np.array([b for b, _, _ in centers])
        near = np.full((asking.num_rows, len(centers)), -1.0)
        bound = np.zeros(near.shape)
        real = np.array([c is not None for _, c, _ in centers], bool)
        near[:, real] = 0.0
        if real.any():
            middles = np.array([c for _, c, _ in centers if c is not None], float)
            middles /= np.linalg.norm(middles, axis=1, keepdims=True)
            cones = np.array([a for _, c, a in centers if c is not None], float)
            for width, at, matrix in by_width(asking.column("_vector")):
                part = Cosines(width, matrix)
                fine = ~(part.norm <= 0)
                if width != middles.shape[1] or not fine.any():
                    continue
                with np.errstate(all="ignore"):
                    cosine = matrix[fine] / part.norm[fine][:, None] @ middles.T
                cosine = np.where(np.isnan(cosine), 1.0, np.clip(cosine, -1.0, 1.0))
                cells = np.ix_(at[fine], np.flatnonzero(real))
                near[cells], bound[cells] = cosine, np.cos(np.maximum(np.arccos(cosine) - cones, 0.0))
        place = np.empty(near.shape, np.int32)
        np.put_along_axis(place, np.lexsort((np.broadcast_to(buckets, near.shape), -near), axis=1), np.arange(len(centers), dtype=np.int32)[None, :], axis=1)
        met = place < probes
        if rest:
            least = asking.column("_least").to_numpy().astype(float)
            met = ~met & (np.isnan(least)[:, None] | (bound + slack >= least[:, None]))
        at = {int(b): i for i, b in enumerate(buckets)}
        return lambda bucket: met[:, at[bucket]]

    return of
