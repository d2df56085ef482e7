"""Hierarchical density clusters: a spanning tree, its merges, and the most stable clusters.

Nothing here is gathered: edges of the spanning tree come from the trees of tiles and
of pairs of tiles, among which rounds choose each component's lightest, merges from halving the edges by weight, in
which both halves go on at once, and clusters from pointers that double.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.graph import connected_components
from orrery.operators.blocks import unit
from orrery.operators.neighbours import Cells, _vectors, cells_of, knn_in_cells
from orrery.operators.ranking import global_rank
from orrery.storage import drop_staged, stage

BLOCK, DIGITS, LEAST = 100_000, 6, 1e-6
#: Edges that one task may finish; rows of a block of products.
FEW, ROWS = 250_000, 256
_EDGE = "w double, lo long, hi long"


def _ways_out(x: np.ndarray, core: np.ndarray, comp: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lightest weight from each of ``rows`` to one of ``columns`` (in order) in another component, and the first place that has it.

    Weights are rounded, so ties are common: the first of what is as light up to rounding is taken, and checked.
    """
    weight, place = np.full(len(rows), np.inf), np.full(len(rows), -1)
    there, level, of = x[columns].T, 1 - core[columns] ** 2 / 2, comp[columns]  # level: the cosine at which the core takes over
    for i in range(0, len(rows), ROWS):
        own = rows[i : i + ROWS]
        raw = x[own] @ there
        near = np.minimum(raw, level[None, :])
        near[comp[own][:, None] == of[None, :]] = -np.inf
        most = near.max(axis=1)
        some = np.isfinite(most)
        least = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * np.where(some, most, 0))), DIGITS)
        least = np.maximum(least, core[own])
        first = (near >= (1 - (least + 0.6 * 10.0**-DIGITS) ** 2 / 2 - 1e-15)[:, None]).argmax(axis=1)
        d = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * raw[np.arange(len(own)), first])), DIGITS)
        for r in np.flatnonzero(some & (np.maximum(d, core[columns[first]]) > least)):  # next to a border of rounding
            w = np.maximum(np.round(np.sqrt(np.maximum(0.0, 2 - 2 * raw[r])), DIGITS), core[columns])
            w[comp[own[r]] == of] = np.inf
            first[r], least[r] = np.maximum(w, core[own[r]]).argmin(), max(w.min(), core[own[r]])
        weight[i : i + ROWS], place[i : i + ROWS] = np.where(some, least, np.inf), np.where(some, columns[first], -1)
    return weight, place


def tree_of(x: np.ndarray, core: np.ndarray, side: np.ndarray | None = None, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(w, lo, hi)`` of the minimum spanning tree of unit vectors in order of their ids, by places.

    With ``side`` only edges between the two sides and the ``known`` ones count.  A vector's lightest way out stays so until both
    ends are in one component, and bounds its later ones; it is sought again only if its component has no lighter one.
    """
    n = len(x)
    comp, low, to, stale = np.arange(n), core.copy(), np.full(n, -1), np.ones(n, bool)
    kw, kl, kh = known if known is not None else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sides = [(np.ones(n, bool), np.arange(n))] if side is None else [(side == s, np.flatnonzero(side != s)) for s in (0, 1)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        bound = np.full(n, np.inf)
        np.minimum.at(bound, comp[~stale], low[~stale])
        np.minimum.at(bound, comp[kl], kw)
        np.minimum.at(bound, comp[kh], kw)
        need = stale & (low <= bound[comp]) & np.isfinite(low)
        for mine, columns in sides:
            rows = np.flatnonzero(need & mine)
            if len(rows) and len(columns):
                low[rows], to[rows] = _ways_out(x, core, comp, rows, columns)
                stale[rows] = False
        own = np.flatnonzero(~stale & (to >= 0))
        c = np.concatenate([comp[own], comp[kl], comp[kh]])
        other = np.concatenate([comp[to[own]], comp[kh], comp[kl]])
        w = np.concatenate([low[own], kw, kw])
        lo, hi = (np.concatenate([f(own, to[own]), k, k]) for f, k in ((np.minimum, kl), (np.maximum, kh)))
        order = np.lexsort((hi, lo, w, c))
        first = order[np.flatnonzero(np.diff(c[order], prepend=-1))]
        if not len(first):
            break
        ends, at = np.unique(lo[first] * n + hi[first], return_index=True)
        out.append((w[first][at], ends // n, ends % n))
        up = np.arange(n)
        up[c[first]] = other[first]
        both = up[up] == np.arange(n)  # two components with the same edge: the only rings there are
        up = np.where(both & (np.arange(n) < up), np.arange(n), up)
        while not np.array_equal(up, up[up]):
            up = up[up]
        comp = up[comp]
        stale |= (to >= 0) & (comp[to] == comp)
        open_ = comp[kl] != comp[kh]
        kw, kl, kh = kw[open_], kl[open_], kh[open_]
    return tuple(np.concatenate(a) if out else np.zeros(0, t) for a, t in zip(zip(*out) if out else ((), (), ()), (float, np.int64, np.int64), strict=True))


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """The spanning forest of few edges between components ``a`` and ``b``."""
    edges = edges.sort_values(["w", "lo", "hi"])
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := up.get(a, a)) != a:
            up[a] = a = up.get(b, b)
        return a

    taken = []
    for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
        a, b = root(a), root(b)
        taken.append(a != b)
        up[a] = b
    return edges.loc[taken, ["w", "lo", "hi"]]


def spanning_tree(cells: Cells, k: int) -> DataFrame:
    """``w, lo, hi``: the minimum spanning tree of mutual reachability, unique by ``(w, lo, hi)``.

    A vector's core distance is that to its k-th other (the farthest where there are fewer); an edge weighs
    the greatest of both cores and the distance, to six digits.  An edge of the whole tree is one of the tree of any
    part that holds both its ends, so the trees of all pairs of tiles hold it: each tile's tree is found once, each pair of tiles adds
    edges between the two, and a vector is sent once for each other tile in all.  Rounds over these few edges, each component's lightest, give the whole tree.
    """
    placed, total = cells.placed, 1 + max(t for own in cells.tiles for t in own)
    chord = F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))), DIGITS)
    cores = knn_in_cells(cells, k)[0].groupBy("id").agg(F.max(chord).alias("core"))
    points = stage(placed.join(cores, "id"), "points")

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids = part["id"].to_numpy()
        w, lo, hi = tree_of(unit(part["v"]), part["core"].to_numpy())
        return pd.DataFrame({"tile": part["tile"].iloc[0], "w": w, "lo": ids[lo], "hi": ids[hi]})

    trees = stage(points.groupBy("tile").applyInPandas(inside, f"tile int, {_EDGE}"), "trees")
    if total == 1:
        return trees.select("w", "lo", "hi")

    def meet(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The edges between two tiles in the tree of both."""
        part = part.sort_values("id")
        ids, side = part["id"].to_numpy(), (part["tile"] == part["y"]).to_numpy().astype(int)
        if side.min(initial=1) == side.max(initial=0):
            return pd.DataFrame({"w": [], "lo": [], "hi": []})
        own = (known["w"].to_numpy(), *(np.searchsorted(ids, known[c].to_numpy()) for c in ("lo", "hi")))
        w, lo, hi = tree_of(unit(part["v"]), part["core"].to_numpy(), side, own)
        new = side[lo] != side[hi]
        return pd.DataFrame({"w": w[new], "lo": ids[lo[new]], "hi": ids[hi[new]]})

    others = F.filter(F.sequence(F.lit(0), F.lit(total - 1)), lambda t: t != F.col("tile"))
    meets = F.explode(F.transform(others, lambda t: F.struct(F.least(t, "tile").alias("x"), F.greatest(t, "tile").alias("y")))).alias("m")
    parts = min(total * (total - 1) // 2, 2048)
    sent = points.select("id", "v", "core", "tile", meets).select("id", "v", "core", "tile", "m.x", "m.y").repartition(parts, "x", "y")
    known = trees.select("w", "lo", "hi", meets).select("w", "lo", "hi", "m.x", "m.y").repartition(parts, "x", "y")
    between = sent.groupBy("x", "y").cogroup(known.groupBy("x", "y")).applyInPandas(meet, _EDGE)
    edges = trees.select("w", "lo", "hi").unionByName(between).withColumns({"a": F.col("lo"), "b": F.col("hi")})
    edges, tree = stage(edges, "edges"), None
    while (left := edges.count()) > FEW:
        both = edges.withColumn("comp", F.col("a")).unionByName(edges.withColumn("comp", F.col("b")))
        out = both.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "a", "b")).alias("e")).select("e.*").distinct()
        out = stage(out, "lightest")
        tree = out.select("w", "lo", "hi") if tree is None else tree.unionByName(out.select("w", "lo", "hi"))
        joined = stage(connected_components(out, "a", "b"), "joined")
        for end in "ab":
            edges = edges.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        edges = stage(edges.filter("a <> b"), "edges")
    if left:  # a bounded rest in one task
        rest = edges.groupBy().applyInPandas(_kruskal, _EDGE)
        tree = rest if tree is None else tree.unionByName(rest)
    return stage(tree, "tree")


def merges_of(tree: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """``node, w, left, right, nl, nr``: every merge of a tree over leaves 0 to n - 1, in order of ``(w, lo, hi)``.

    The merge at place p (from 1) is node n + p - 1; ``nl`` and ``nr`` are leaves below each side.  Places are cut in
    halves: parts that the lower half joins become single nodes of the upper half, and both halves are cut again at once
    until none has more than ``block`` edges; each is then one bounded task.
    """
    ranked = global_rank(tree, [F.asc("w"), F.asc("lo"), F.asc("hi")], "place")
    rows = stage(ranked.select("place", "w", F.col("lo").alias("x"), F.col("hi").alias("y"), F.lit(1).cast("long").alias("nx"), F.lit(1).cast("long").alias("ny")), "places")
    levels = max(0, int(np.ceil(np.log2(max(1, -(-(n - 1) // block))))))
    for level in range(levels):
        half = F.shiftright(F.floor((F.col("place") - 1) / block), levels - level - 1)
        keyed = rows.withColumn("half", half).withColumn("part", F.shiftright("half", 1))
        low, high = keyed.filter("half % 2 = 0"), keyed.filter("half % 2 = 1")
        name = F.col("part") * (2 * n)  # a node may be in several parts
        ends = low.select("place", (name + F.col("x")).alias("x"), (name + F.col("y")).alias("y"), "nx", "ny")
        held = stage(connected_components(ends, "x", "y"), "held")
        tops = ends.join(held, ends.x == held.node).groupBy("component").agg((F.max("place") + (n - 1)).alias("top"))
        leaves = ends.select(F.col("x").alias("node"), F.col("nx").alias("n")).unionByName(ends.select(F.col("y").alias("node"), F.col("ny").alias("n"))).distinct()
        sizes = held.join(leaves, "node").groupBy("component").agg(F.sum("n").alias("n"))
        became = stage(held.join(tops, "component").join(sizes, "component").select("node", "top", "n"), "became")
        for side in "xy":
            to = became.select(F.col("node").alias("key"), "top", "n")
            high = high.withColumn("key", name + F.col(side)).join(to, "key", "left")
            high = high.withColumn(side, F.coalesce("top", side)).withColumn(f"n{side}", F.coalesce("n", f"n{side}")).drop("key", "top", "n")
        rows = stage(low.unionByName(high).drop("half", "part"), "places")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        up, size, out = {}, {}, []

        def root(a: int) -> int:
            while a in up:
                if up[a] in up:
                    up[a] = up[up[a]]
                a = up[a]
            return a

        for r in part.sort_values("place").itertuples():
            a, b, node = root(r.x), root(r.y), n + r.place - 1
            na, nb = size.get(a, r.nx), size.get(b, r.ny)
            up[a] = up[b] = node
            size[node] = na + nb
            out.append((node, r.w, a, b, na, nb))
        return pd.DataFrame(out, columns=["node", "w", "left", "right", "nl", "nr"])

    blocks = rows.withColumn("block", F.floor((F.col("place") - 1) / block))
    return blocks.groupBy("block").applyInPandas(join, "node long, w double, left long, right long, nl long, nr long")


def _follow(links: DataFrame) -> DataFrame:
    """``node, up`` with ``up`` the end of the way; ends point to themselves.  Pointers double in every round."""
    now = stage(links, "pointers")
    while True:
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        nxt = stage(now.join(ahead, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "pointers")
        drop_staged(now)
        now = nxt.select("node", "up")
        if nxt.filter("moved").isEmpty():
            return now


_SCORED = "cluster long, parent long, stability double, score double, own boolean"


def _scores(part: pd.DataFrame) -> pd.DataFrame:
    """Scores of clusters, from below; ids grow upwards.  Those that have a score only give it to the cluster above."""
    below: dict[int, float] = {}
    out = []
    part = part.sort_values("cluster")
    for c, up, stable, score in zip(*(part[name].tolist() for name in ("cluster", "parent", "stability", "score")), strict=True):
        if score != score:  # none yet
            parts = below.get(c)
            score = stable if parts is None else max(stable, parts)
            out.append((c, up, stable, score, parts is None or stable >= parts))
        below[up] = below.get(up, 0.0) + score
    return pd.DataFrame(out, columns=["cluster", "parent", "stability", "score", "own"])


def _selected(clusters: DataFrame, few: int | None = None) -> DataFrame:
    """``cluster, best``: the topmost cluster above each, or itself, that is at least as stable as all below it.

    At most ``few`` clusters are scored by one task, however deep they lie in one another; while there are more, each round
    scores those whose parts are scored.  The root (null ``parent``) is never taken.
    """
    few = FEW if few is None else few
    waiting, done = stage(clusters.select("cluster", "parent", "stability"), "waiting"), None
    while (left := waiting.count()) > few:
        if done is None:
            ready = waiting.join(waiting.select(F.col("parent").alias("cluster")), "cluster", "left_anti").withColumn("score", F.col("stability")).withColumn("own", F.lit(True))
        else:
            below = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("score").alias("below"), F.count("*").alias("k")).filter("k = 2")
            ready = waiting.join(below, "cluster").withColumn("own", F.col("stability") >= F.col("below")).withColumn("score", F.greatest("stability", "below"))
        ready = stage(ready.select("cluster", "parent", "stability", "score", "own"), "ready")
        kept, done = done, stage(ready if done is None else done.unionByName(ready), "done")
        before, waiting = waiting, stage(waiting.join(ready.select("cluster"), "cluster", "left_anti"), "waiting")
        for old in (before, ready, kept):
            if old is not None:
                drop_staged(old)
    if left:
        none = F.lit(None).cast("double").alias("score")
        rest = waiting.select("cluster", "parent", "stability", none)
        if done is not None:
            rest = rest.unionByName(done.join(waiting.select(F.col("cluster").alias("parent")), "parent", "left_semi").select("cluster", "parent", "stability", "score"))
        rest = rest.withColumn("parent", F.coalesce("parent", F.lit(-1))).groupBy().applyInPandas(_scores, _SCORED).withColumn("parent", F.expr("nullif(parent, -1)"))
        done = stage(rest if done is None else done.unionByName(rest), "done")
    if done is None:
        return clusters.select("cluster", F.col("cluster").alias("best")).limit(0)
    now = stage(done.select("cluster", F.col("parent").alias("up"), F.when(F.col("own") & F.col("parent").isNotNull(), F.col("cluster")).alias("best")), "ways")
    while not now.filter("up is not null").isEmpty():
        ahead = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("best").alias("higher"))
        before, now = now, stage(now.join(ahead, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "best").alias("best")), "ways")
        drop_staged(before)
    return now.select("cluster", "best")


def density_hierarchy(vectors: DataFrame, key: str, vector: str, k: int, least: int, pivots: int = 256, tile: int | None = None, block: int = BLOCK) -> DataFrame:
    """``key, cluster, strength`` of every vector: the most stable density clusters of at least ``least`` members.

    Cores are distances to the ``k``-th other.  A merge of two sides that have ``least`` members each is where two clusters part;
    a smaller side falls out of its cluster there.  A cluster's stability sums, over its members, 1 / distance at which each
    left it less that at which it began (distances below 1e-6 count as that).  Clusters are taken where they are at least as stable as what
    is taken below them, never the whole.  ``cluster`` is its smallest id; -1 and strength 0 is noise.
    ``strength`` is a member's own 1 / distance over the greatest of its cluster.  Null vectors have no row; ids are unique longs.
    """
    rows = _vectors(vectors, key, vector)
    leaves = stage(global_rank(rows.select("id"), [F.asc("id")], "at").select("id", (F.col("at") - 1).alias("leaf")), "leaves")
    n = leaves.count()
    numbered = stage(rows.join(leaves, "id").select(F.col("leaf").alias("id"), "v"), "vectors")
    noise = leaves.select(F.col("id").alias(key), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("strength"))
    if n < 2 * least:  # two clusters below the whole need as many
        return noise
    merges = stage(merges_of(spanning_tree(cells_of(numbered, pivots, tile), k), n, block), "merges")
    sides = F.inline(F.array(F.struct(F.col("left").alias("node"), F.col("nl").alias("n")), F.struct(F.col("right").alias("node"), F.col("nr").alias("n"))))
    nodes = merges.select(F.col("node").alias("parent"), (1 / F.greatest("w", F.lit(LEAST))).alias("lam"), (F.least("nl", "nr") >= least).alias("parts"), sides)
    root = merges.agg(F.max("node").alias("node")).select("node", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("lam"), F.lit(True).alias("parts"), F.lit(n).cast("long").alias("n"))
    nodes = stage(nodes.unionByName(root), "nodes")
    large = F.col("n") >= least
    starts = stage(nodes.filter(large & F.col("parts")), "starts")
    first = _follow(nodes.select("node", F.when(large, F.col("node")).otherwise(F.col("parent")).alias("up")))
    begun = _follow(nodes.filter(large).select("node", F.when(F.col("parts"), F.col("node")).otherwise(F.col("parent")).alias("up"))).withColumnRenamed("up", "cluster")
    at = merges.select(F.col("node").alias("up"), (1 / F.greatest("w", F.lit(LEAST))).alias("lam"))
    points = stage(first.filter(F.col("node") < n).join(at, "up").join(begun.withColumnRenamed("node", "up"), "up").select(F.col("node").alias("leaf"), "cluster", "lam"), "points")
    clusters = starts.join(begun.select(F.col("node").alias("parent"), F.col("cluster").alias("above")), "parent", "left")
    clusters = stage(clusters.select(F.col("node").alias("cluster"), F.col("above").alias("parent"), F.col("lam").alias("birth"), "n"), "clusters")
    left = points.select("cluster", "lam", F.lit(1).cast("long").alias("n")).unionByName(clusters.filter("parent is not null").select(F.col("parent").alias("cluster"), F.col("birth").alias("lam"), "n"))
    mass = left.groupBy("cluster").agg(F.sum(F.col("lam") * F.col("n")).alias("m"))
    stable = stage(clusters.join(mass, "cluster").withColumn("stability", F.round(F.col("m") - F.col("birth") * F.col("n"), DIGITS)), "stable")
    taken = points.join(_selected(stable).filter("best is not null"), "cluster").join(leaves, "leaf")
    whole = taken.groupBy("best").agg(F.min("id").alias("smallest"), F.max("lam").alias("greatest"))
    found = taken.join(whole, "best").select(F.col("id").alias(key), F.col("smallest").alias("cluster"), (F.col("lam") / F.col("greatest")).alias("strength"))
    return stage(found.unionByName(noise.join(found.select(key), key, "left_anti")), "hierarchy")
