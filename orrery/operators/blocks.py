"""Cosines of two sets of vectors in blocks: single precision first, double precision where it decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

ROWS, COLUMNS = 512, 4096


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def error(x: np.ndarray) -> float:
    """More than a product of unit vectors in single precision may differ from that in double precision."""
    return (x.shape[1] + 8) * 1.3e-7


def _blocks(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, ROWS):
        for j in range(0, m, COLUMNS):
            yield slice(i, min(i + ROWS, n)), slice(j, min(j + COLUMNS, m))


def _best(a: np.ndarray, others: np.ndarray, exact: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of every row ``a``, row by row."""
    order = np.lexsort((others, -np.round(exact, 9), a))
    rows = a[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """``id, neighbor, similarity``: the ``k`` best of ``y`` for every row of ``x`` by the similarity to nine digits, then by id.

    What may be among the best by single precision is compared in double precision, and its ``k``-th bounds the next block.
    """
    left, right, slack = x.astype(np.float32), y.astype(np.float32), error(x) + 2e-9
    whole = bool(np.isfinite(left).all() and np.isfinite(right).all())
    meet = len(np.intersect1d(ids, others)) > 0
    found = []
    for i in range(0, len(x), ROWS):
        rows = slice(i, min(i + ROWS, len(x)))
        own, bound = x[rows], np.full(rows.stop - i, -2.0)
        a, b, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(y), COLUMNS):
            columns = slice(j, min(j + COLUMNS, len(y)))
            sims = left[rows] @ right[columns].T
            if meet:
                sims[ids[rows, None] == others[None, columns]] = -np.inf
            if not whole:
                sims[np.isnan(sims)] = -np.inf
            if not len(a) and sims.shape[1] > k:  # the k-th of the first block is a bound
                bound = np.maximum(bound, np.partition(sims, sims.shape[1] - k, axis=1)[:, -k].astype(np.float64) - slack)
            r, c = np.nonzero(sims >= np.maximum(bound - slack, -2)[:, None].astype(np.float32))
            if not len(r):
                continue
            new = np.concatenate([np.einsum("ij,ij->i", own[r[at : at + 65536]], y[j + c[at : at + 65536]]) for at in range(0, len(r), 65536)])
            a, b, exact = np.concatenate([a, r]), np.concatenate([b, c + j]), np.concatenate([exact, new])
            best = _best(a, others[b], exact, k)
            a, b, exact = a[best], b[best], exact[best]
            last = np.flatnonzero(np.bincount(a, minlength=len(bound)) == k)
            bound[last] = np.maximum(bound[last], exact[np.searchsorted(a, last, side="right") - 1])
        found.append(pd.DataFrame({"id": ids[rows][a], "neighbor": others[b], "similarity": exact}))
    return pd.concat(found) if found else pd.DataFrame({"id": [], "neighbor": [], "similarity": []})


def close(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, gx: np.ndarray | None = None, gy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many of the other side each vector has at ``threshold`` or more, and of each a place that stands for its component.

    Places count ``x`` first, then ``y``; with ``same`` both are one set, whose own pairs do not count.  Only groups that agree meet.
    """
    n = len(x)
    counts, up = np.zeros(n if same else n + len(y), np.int64), np.arange(n if same else n + len(y), dtype=np.int32)
    left, right, slack = x.astype(np.float32), y.astype(np.float32), error(x)

    def root(a: np.ndarray) -> np.ndarray:
        while not np.array_equal(up[a], a):
            a = up[a]
        return a

    for rows, columns in _blocks(n, len(y)):
        if same and columns.stop <= rows.start:
            continue
        sims = left[rows] @ right[columns].T
        hit, sure = sims >= np.float32(threshold - slack), sims > np.float32(threshold + slack)
        if np.count_nonzero(hit) > np.count_nonzero(sure):
            for r, c in np.argwhere(hit ^ sure):
                hit[r, c] = x[rows.start + r] @ y[columns.start + c] >= threshold
        if gx is not None:
            hit &= gx[rows, None] == gy[None, columns]
        if same:  # each pair once
            if columns.start < rows.stop:
                hit &= np.arange(columns.start, columns.stop)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        counts[rows] += np.count_nonzero(hit, axis=1)
        first = columns.start if same else n + columns.start
        to = slice(first, first + columns.stop - columns.start)
        counts[to] += np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint16)  # of at most ROWS rows
        while True:  # one link out of each row and into each column between components, until there is none
            own, there = root(up[rows]), root(up[to])
            up[rows], up[to] = own, there
            if (own == own[0]).all() and (there == own[0]).all():
                break
            apart = hit & (own[:, None] != there[None, :])
            r = np.flatnonzero(apart.any(axis=1))
            c = np.flatnonzero(apart.any(axis=0))
            if not len(r):
                break
            ends = np.concatenate([np.stack([own[r], there[apart[r].argmax(axis=1)]], 1), np.stack([own[apart[:, c].argmax(axis=0)], there[c]], 1)])
            for a, b in np.unique(ends, axis=0).tolist():
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                if a != b:
                    up[max(a, b)] = min(a, b)
    return counts, root(up.copy())
