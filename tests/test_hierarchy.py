"""Hierarchical density clusters against a plain version over all pairs."""

import numpy as np
import pytest

from orrery.operators.hierarchy import density_hierarchy, merges_of


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def plain(x, k, least):
    """Kruskal over all pairs, then the tree of clusters by recursion."""
    n = len(x)
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * unit(x) @ unit(x).T)), 6)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min(k, n - 1) - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    up, node, size, merge = list(range(n)), list(range(n)), [1] * n, {}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for weight, a, b in sorted((w[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        a, b = root(a), root(b)
        if a != b:
            merge[len(size)] = (weight, node[a], node[b])
            size.append(size[node[a]] + size[node[b]])
            up[b], node[a] = a, len(size) - 1

    def leaves(v):
        stack, out = [v], []
        while stack:
            v = stack.pop()
            stack += merge[v][1:] if v in merge else []
            out += [] if v in merge else [v]
        return out

    def grow(v, birth):
        """``score, [(members, lambdas)]`` taken at or below, and everything that lies below."""
        fell, here, start, n_start = {}, v, v, size[v]
        while True:
            weight, a, b = merge[here]
            lam = 1 / max(weight, 1e-6)
            small = [s for s in (a, b) if size[s] < least]
            fell |= {p: lam for s in small for p in leaves(s)}
            if len(small) == 1:
                here = b if small[0] == a else a
            else:
                break
        below = [] if small else [grow(s, lam) for s in (a, b)]
        stable = round(sum(fell.values()) + (0 if small else lam * (size[a] + size[b])) - birth * n_start, 6)
        members = dict(fell)
        for _, _, m in below:
            members |= m
        if v != len(size) - 1 and stable >= sum(s for s, _, _ in below):
            return stable, [members], members
        return max(stable, sum(s for s, _, _ in below)), [m for _, t, _ in below for m in t], members

    found = {i: (-1, 0.0) for i in range(n)}
    if n >= 2 * least:
        for m in grow(len(size) - 1, 0.0)[1]:
            found |= {p: (min(m), lam / max(m.values())) for p, lam in m.items()}
    return found


def groups(seed=3):
    draw = np.random.default_rng(seed)
    centres = 3 * unit(draw.normal(size=(6, 8)))
    nested = [c + 0.5 * draw.normal(size=8) for c in centres[:2] for _ in range(3)]
    parts = [c + s * draw.normal(size=(m, 8)) for c, s, m in zip([*centres, *nested], [0.3, 0.3, 0.2, 0.4, 0.1, 0.6] + [0.08] * 6, [30, 25, 40, 20, 12, 30] + [9] * 6, strict=True)]
    return np.concatenate([*parts, np.repeat(centres[5:6], 14, axis=0), draw.normal(size=(30, 8))])  # copies and strays


@pytest.mark.parametrize("k, least, block", [(3, 5, 40), (5, 8, 100_000)])
def test_hierarchy_equals_all_pairs(spark, k, least, block):
    x = groups()
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(9999, None, "x")], "k long, v array<double>, cluster string")
    got = {r.k: (r.cluster, r.strength) for r in density_hierarchy(rows, "k", "v", k, least, pivots=12, tile=40, block=block).collect()}
    want = plain(x, k, least)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert len({c for c, _ in want.values()}) > 6 and -1 in {c for c, _ in want.values()}


def test_hierarchy_of_few(spark):
    rows = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "k long, v array<double>")
    assert {(r.k, r.cluster) for r in density_hierarchy(rows, "k", "v", 3, 5).collect()} == {(7, -1), (8, -1)}
    assert density_hierarchy(rows.limit(0), "k", "v", 3, 5).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_merges_are_the_same_for_any_block(spark, block):
    tree = spark.createDataFrame([(1.0, 0, 1), (2.0, 2, 3), (2.0, 1, 2), (5.0, 4, 5), (6.0, 3, 4), (7.0, 0, 6)], "w double, lo long, hi long")
    got = {(r.node, r.w, frozenset([r.left, r.right]), r.nl + r.nr) for r in merges_of(tree, 7, block).collect()}
    pair = frozenset
    assert got == {(7, 1.0, pair([0, 1]), 2), (8, 2.0, pair([7, 2]), 3), (9, 2.0, pair([8, 3]), 4), (10, 5.0, pair([4, 5]), 2), (11, 6.0, pair([9, 10]), 6), (12, 7.0, pair([11, 6]), 7)}
