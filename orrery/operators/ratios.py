"""Ratcliff-Obershelp matches of all pairs of two lists of names at once, equal to the standard library's pair by pair.

A name is a row of numbers for its letters.  Of two lists the longest common run of every pair comes from one pass over the
places of both: places at which all names of a list agree are compared once for the list, so sorted names cost little.  What
is left and right of the runs is again two lists of few and short names, each pair of which is matched once.

Rows meet in tiles: a task gets some sorted rows of either side, as lists, and gives their pairs, so pairs are shuffled at no time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.storage import stage
from orrery.workers import per_worker

#: Names of more letters are compared by the standard library, pair by pair (it also leaves out common letters from 200 on).
LONGEST = 64
#: Pairs that are worked on at once, and of how many with the same run the rests are compared by themselves.
PAIRS, FEW = 1 << 20, 512
#: Pairs of which one number each stays in a core's cache.
CACHED = 1 << 15
#: Rows of a side of a tile, pairs of tiles of a task, rows of a batch of pairs, and pieces the right side of a block is dealt in.
ROWS, SOME, BATCH, SALTS = 1024, 32, 1 << 16, 16


def _letters(names: tuple[Sequence[str], Sequence[str]]) -> list[np.ndarray]:
    """Both lists as a row of numbers a name, filled up with the ``_pad`` of its side."""
    sizes = [np.fromiter(map(len, own), np.int64, len(own)) for own in names]
    wide = [int(n.max(initial=0)) for n in sizes]
    raw = [np.array(own, dtype=f"U{max(w, 1)}").view(np.uint32).reshape(len(own), -1)[:, :w] for own, w in zip(names, wide, strict=True)]
    filled = [np.arange(w) < n[:, None] for w, n in zip(wide, sizes, strict=True)]
    codes, at = np.unique(np.concatenate([r[f] for r, f in zip(raw, filled, strict=True)]), return_inverse=True)
    kind = np.dtype(next(k for k in (np.uint8, np.uint16, np.uint32) if len(codes) <= np.iinfo(k).max - 1))
    found = [np.full(r.shape, _pad(kind) + side, kind) for side, r in enumerate(raw)]
    for own, f, numbers in zip(found, filled, np.split(at, [filled[0].sum()]), strict=True):
        own[f] = numbers
    return found


def _pad(kind: np.dtype) -> int:
    """From here on numbers fill up short names; no letter has them, and the two sides have not the same."""
    return np.iinfo(kind).max - 1


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the place of each row among them."""
    if not x.shape[1] or (x == x[0]).all():
        return x[:1], np.zeros(len(x), np.int64)
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, at = np.unique(raw, return_index=True, return_inverse=True)
    return x[first], at


def _runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of the pairs that ``x`` and ``y`` are broadcast to (letters first), the longest common run.

    A number that holds its length and, of equal ones, the first place in ``x``, then in ``y``: ``length * p * q + p * q - 1 - place
    of its end``.
    """
    p, q = len(x), len(y)
    size = p * q
    kind = np.uint16 if size * (min(p, q) + 1) < 1 << 16 else np.uint32
    step = kind(size)
    best: dict[tuple[int, int], np.ndarray] = {}
    above: list[np.ndarray | None] = [None] * q
    for i in range(p):
        row: list[np.ndarray | None] = []
        for j in range(q):
            hit = x[i] == y[j]
            before = above[j - 1] if i and j else None
            if before is None:
                run = hit * step
            else:
                run = before + step
                run = np.multiply(run, hit, out=run) if run.shape == hit.shape else run * hit
            row.append(run)
            told = run + kind(size - 1 - (i * q + j))
            if told.shape in best:
                np.maximum(best[told.shape], told, out=best[told.shape])
            else:
                best[told.shape] = told
        above = row
    found = None
    for part in best.values():
        found = part if found is None else np.maximum(found, part)
    return found


def _columns(x: np.ndarray, axis: int) -> list[np.ndarray]:
    """Letters by place, along ``axis`` of a matrix of pairs; one number where all names agree."""
    shape = (-1, 1) if axis == 0 else (1, -1)
    return [c[:1].reshape(1, 1) if (c == c[0]).all() else np.ascontiguousarray(c).reshape(shape) for c in x.T]


def _table() -> np.ndarray:
    """Letters in common runs for each of the 65,536 ways in which two names of four letters can agree (bit ``4 * i + j``)."""
    way = np.arange(1 << 16, dtype=np.uint32)
    hit = [[(way >> (4 * i + j) & 1).astype(bool) for j in range(4)] for i in range(4)]
    sums = np.zeros(len(way), np.uint8)
    while True:
        best, run = np.zeros(len(way), np.int64), {}
        for i in range(4):
            for j in range(4):
                run[i, j] = (run.get((i - 1, j - 1), 0) + 1) * hit[i][j]
                best = np.maximum(best, run[i, j] * 16 + (15 - (4 * i + j)))
        long, (i, j) = best // 16, np.divmod(15 - best % 16, 4)
        if not long.any():
            return sums
        sums += long.astype(np.uint8)
        for k in range(4):  # what is left lies before both ends of the run, or after
            for m in range(4):
                hit[k][m] = hit[k][m] & (((k <= i - long) & (m <= j - long)) | ((k > i) & (m > j)))


def _few_letters(x: Sequence[np.ndarray], y: Sequence[np.ndarray]) -> np.ndarray:
    """Letters in common runs for pairs of names of at most four letters."""
    way: np.ndarray | int = 0
    for i, own in enumerate(x):
        for j, other in enumerate(y):
            way = way | (own == other).astype(np.uint16) << np.uint16(4 * i + j)
    return per_worker("runs of four letters", _table)[way]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters in common runs of each row of ``x`` with the same row of ``y``; what is left of all runs is compared together."""
    sums, every, pad = np.zeros(len(x), np.uint8), np.arange(len(x)), _pad(x.dtype)
    todo = [(every, x, y)]
    while todo:
        row, x, y = todo.pop()
        if len(row) > CACHED:
            todo += [(row[k : k + CACHED], x[k : k + CACHED], y[k : k + CACHED]) for k in range(0, len(row), CACHED)]
            continue
        p, q = x.shape[1], y.shape[1]
        ends = list(np.ascontiguousarray(x.T)), list(np.ascontiguousarray(y.T))
        if max(p, q) <= 4:
            np.add.at(sums, row, _few_letters(*ends))
            continue
        told, size = _runs(*ends), p * q
        long, end = np.divmod(told, told.dtype.type(size))
        np.add.at(sums, row, long.astype(np.uint8))
        long = long.astype(np.int64)
        i, j = np.divmod(size - 1 - end.astype(np.int64), q)
        n, m = (x < pad).sum(axis=1), (y < pad).sum(axis=1)
        left = np.flatnonzero((long > 0) & (i >= long) & (j >= long))
        right = np.flatnonzero((long > 0) & (i + 1 < n) & (j + 1 < m))
        own = np.concatenate([left, right])
        if not len(own):
            continue
        start = [np.concatenate([np.zeros(len(left), np.int64), at[right] + 1]) for at in (i, j)]
        stop = [np.concatenate([(at - long + 1)[left], whole[right]]) for at, whole in ((i, n), (j, m))]
        wide, high = stop[0] - start[0], stop[1] - start[1]
        band = np.where(np.maximum(wide, high) <= 4, 0, np.where(np.maximum(wide, high) <= 12, 1, 2))
        for k in range(3):
            some = np.flatnonzero(band == k)
            if len(some):
                cut = []
                for z, s, e, fill in ((x, start[0][some], stop[0][some], pad), (y, start[1][some], stop[1][some], pad + 1)):
                    at = s[:, None] + np.arange((e - s).max())
                    cut.append(np.where(at < e[:, None], z[own[some][:, None], np.minimum(at, z.shape[1] - 1)], z.dtype.type(fill)))
                todo.append((row[own[some]], *cut))
    return sums


def _matched(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in common runs of the pairs of rows ``a`` of ``x`` and ``b`` of ``y``, all of them distinct."""
    p, q = x.shape[1], y.shape[1]
    if not p or not q or not len(a):
        return np.zeros(len(a), np.uint8)
    if 4 * len(a) < len(x) * len(y):
        return _apart(x[a], y[b])
    step = max(1, CACHED // len(y))
    of, other = _few_letters if max(p, q) <= 4 else _runs, _columns(y, 1)
    told = np.concatenate([np.broadcast_to(of(_columns(x[k : k + step], 0), other), (len(x[k : k + step]), len(y))) for k in range(0, len(x), step)])
    told = told.ravel() if len(a) == len(x) * len(y) else told[a, b]
    if max(p, q) <= 4:
        return told
    size = p * q
    sums = (told // told.dtype.type(size)).astype(np.uint8)
    if p == 1 or q == 1:
        return sums
    order = np.argsort(told, kind="stable")
    told = told[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(told)) + 1, [len(told)]])
    before: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def part(side: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        if (side, start, stop) not in before:
            before[side, start, stop] = _distinct((y if side else x)[:, start:stop])
        return before[side, start, stop]

    few, rest = [], {}
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        long, end = divmod(int(told[lo]), size)
        if not long:
            continue
        i, j = divmod(size - 1 - end, q)
        own = order[lo:hi]
        if len(own) < FEW:
            few.append(own)
            continue
        for s, e, t, f in ((0, i - long + 1, 0, j - long + 1), (i + 1, p, j + 1, q)):
            if e > s and f > t:
                (left, at), (right, to) = part(0, s, e), part(1, t, f)
                pair = at[a[own]] * len(right) + to[b[own]]
                if len(left) * len(right) <= 4 * len(own):
                    there = np.zeros(len(left) * len(right), bool)
                    there[pair] = True
                    met = np.flatnonzero(there)
                    counts = np.zeros(len(there), np.uint8)
                    counts[met] = _matched(left, right, met // len(right), met % len(right))
                    sums[own] += counts[pair]
                else:
                    rest.setdefault((e - s, f - t), []).append((own, x[a[own], s:e], y[b[own], t:f]))
    for parts in rest.values():
        own, one, two = (np.concatenate(some) for some in zip(*parts, strict=True))
        sums += np.bincount(own, _apart(one, two), len(sums)).astype(np.uint8)
    if few:
        own = np.concatenate(few)
        sums[own] = _apart(x[a[own]], y[b[own]])
    return sums


def matched_letters(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """A matrix of ``left`` by ``right``: how many letters lie in the matching blocks of ``SequenceMatcher(None, a, b)``.

    Names are best sorted and distinct.  A name of more than ``LONGEST`` letters is compared by the standard library.
    """
    sums = np.zeros((len(left), len(right)), np.uint32)
    short = [np.array([k for k, n in enumerate(names) if len(n) <= LONGEST], np.int64) for names in (left, right)]
    if len(short[0]) and len(short[1]):
        x, y = _letters(([left[k] for k in short[0]], [right[k] for k in short[1]]))
        rows = max(1, PAIRS // len(y))
        for k in range(0, len(x), rows):
            some = x[k : k + rows]
            a, b = np.divmod(np.arange(len(some) * len(y)), len(y))
            sums[np.ix_(short[0][k : k + rows], short[1])] = _matched(some, y, a, b).reshape(len(some), -1)
    if len(short[0]) < len(left) or len(short[1]) < len(right):
        pair = SequenceMatcher(None)
        for j, b in enumerate(right):
            pair.set_seq2(b)
            for i, a in enumerate(left):
                if len(a) > LONGEST or len(b) > LONGEST:
                    pair.set_seq1(a)
                    sums[i, j] = sum(block.size for block in pair.get_matching_blocks())
    return sums


def four_digits(value: float) -> float:
    """Rounded as Spark rounds the number's decimal form, half up."""
    return float(Decimal(repr(value)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


#: Of a tile: ratios that occur, the number of the ratio of each pair of distinct names (left by right), and both lists of names.
Ratios = tuple[list[float], np.ndarray, list[str | None], list[str | None]]


def of_rows(pairs: np.ndarray, at: np.ndarray, to: np.ndarray, some: slice) -> np.ndarray:
    """What ``pairs`` of distinct names are for some left rows and all right ones; distinct names are numbered in order of the rows."""
    there = pairs[some] if len(at) == len(pairs) else pairs[at[some]]
    return there if len(to) == pairs.shape[1] else there[:, to]


def _ratios(left: list[str | None], right: list[str | None]) -> Ratios:
    a, b = ([n or "" for n in own] for own in (left, right))
    letters = np.add.outer(*(np.fromiter(map(len, own), np.int64, len(own)) for own in (a, b)))
    form = matched_letters(a, b) * (letters.max() + 1) + letters
    if form.max() < 1 << 22:
        there = np.bincount(form.ravel())
        forms = np.flatnonzero(there)
        there[forms] = np.arange(len(forms))
        at = there[form]
    else:
        forms, at = np.unique(form, return_inverse=True)
    common, whole = np.divmod(forms, letters.max() + 1)
    return [2.0 * c / n if n else 1.0 for c, n in zip(common.tolist(), whole.tolist(), strict=True)], at.reshape(form.shape), left, right


def _tiles(rows: DataFrame, block: list[str], name: str, key: str) -> DataFrame:
    """``block`` and lists of the other columns, of at most ``ROWS`` rows each, in order of the names."""
    order, rest = [*block, name, key], [c for c in rows.columns if c not in block]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in block:
                own = b.column(c)
                new[1:] |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            place = np.arange(b.num_rows) - np.repeat(first, np.diff([*first, b.num_rows]))
            starts = np.flatnonzero(place % ROWS == 0)
            ends = pa.array([*starts, b.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, b.column(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(starts)) for c in block), *lists], [*block, *rest])

    schema = T.StructType([T.StructField(f.name, f.dataType if f.name in block else T.ArrayType(f.dataType)) for f in (rows.schema[c] for c in [*block, *rest])])
    parts = 1 + rows.count() // (16 * ROWS)
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(sorted_.select(*block, *rest).mapInArrow(cut, schema), "tiles")


def ratio_pairs(
    left: DataFrame, right: DataFrame, keys: tuple[str, str], names: tuple[str, str], block: list[str], added: str,
    score: Callable[[Ratios, np.ndarray, np.ndarray, pa.RecordBatch], Callable[[slice], tuple[np.ndarray | None, list[np.ndarray]]]],
) -> DataFrame:
    """Both ``keys`` and the columns ``added`` (a schema) of the pairs of rows within equal ``block`` columns, scored by
    the ratio of their ``names`` as the standard library's ``SequenceMatcher`` has it, left before right, null as empty.

    Names that occur often in a tile are compared once for it.  ``score`` gets the ratios of a tile, for either side the places of the rows' names, and
    the right rows; it gives a function from a slice of the left rows to a mask of the pairs to keep (or none) and the columns
    of those kept, row by row.  All columns of both sides but their key and ``block`` have to have names of their own.
    """
    one, two = _tiles(left.dropna(subset=block), block, names[0], keys[0]), _tiles(right.dropna(subset=block), block, names[1], keys[1])
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    pairs = one.withColumn("__salt", F.explode(salts)).join(two.withColumn("__salt", F.pmod(F.xxhash64(F.col(keys[1])[0]), F.lit(SALTS)).cast("int")), [*block, "__salt"])
    met = one.groupBy(*block).agg(F.count("*").alias("m")).join(two.groupBy(*block).agg(F.count("*").alias("n")), block).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    parts = max(4 * left.sparkSession.sparkContext.defaultParallelism, (met or 0) // SOME)
    theirs = [c for c in right.columns if c not in block]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                a, of_left = (b.column(c)[k].values for c in (names[0], keys[0]))
                rows = pa.RecordBatch.from_arrays([b.column(c)[k].values for c in theirs], theirs)
                own, other = (pc.dictionary_encode(x, null_encoding="encode") for x in (a, rows.column(names[1])))
                at, to = own.indices.to_numpy(), other.indices.to_numpy()
                told = score(_ratios(own.dictionary.to_pylist(), other.dictionary.to_pylist()), at, to, rows)
                m, of_right = len(to), rows.column(keys[1])
                step = max(1, BATCH // m)
                for s in range(0, len(at), step):
                    n = min(step, len(at) - s)
                    kept, columns = told(slice(s, s + n))
                    x, y = np.repeat(np.arange(s, s + n), m), np.tile(np.arange(m), n)
                    if kept is not None:
                        x, y = x[kept], y[kept]
                    yield pa.RecordBatch.from_arrays([of_left.take(pa.array(x)), of_right.take(pa.array(y)), *map(pa.array, columns)], [*keys, *more])

    kinds = T.StructType.fromDDL(added)
    more = kinds.fieldNames()
    schema = T.StructType([T.StructField(keys[0], left.schema[keys[0]].dataType), T.StructField(keys[1], right.schema[keys[1]].dataType), *kinds.fields])
    return pairs.select(*names, *keys, *(c for c in theirs if c not in (names[1], keys[1]))).repartition(parts).mapInArrow(work, schema)
