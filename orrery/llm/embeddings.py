"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label collapse first, so copies cost one row.  The rest of a
label is dealt into tiles of about ``TILE`` rows, and every pair of tiles of a
label is one group of work: a label with a third of all rows becomes many
groups of bounded size.  In a group, unit vectors are quantised to int8 codes
``q`` with a scale ``s`` and the exact norm ``e`` of what the codes leave out;
a tile product of codes gives an approximate cosine, off by no more than
``e_x * |s_y q_y| + e_y``.  Pairs whose upper bound is under the threshold are
done; the others are computed again in double precision.  A group returns
counts of links by vector and a spanning forest, never the pairs.

Defined results: null, empty, zero vectors and those with a null or non-finite
component link with nothing, nor do rows with a null label, nor vectors of
different lengths; repeated rows link like any others; a null id is a vector
that others may link to but names no component; extra columns are dropped,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.graph import connected_components
from orrery.storage import stage

THRESHOLD = 0.93
TILE = 2048
ROWS = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the coded vectors, and norms of the errors, of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    slack = 1e-12 * unit.shape[1]  # of these sums themselves
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1) + slack


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of rows of two tiles whose cosine is at least ``threshold``; i < j if the tile is the ``same``."""
    ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, _, ex), (qy, sy, cy, ey) = quantise(ux), quantise(uy)
    right = qy.T.astype(np.float32)  # products of codes are whole and stay below 2**24 up to 1040 components
    exact = x.shape[1] * 127 * 127 < 2**24
    if not exact:
        right = right.astype(np.float64)
    for k in range(0, len(x), ROWS):
        rows = slice(k, k + ROWS)
        near = (qx[rows].astype(right.dtype) @ right).astype(np.float64) * sx[rows, None] * sy
        i, j = np.nonzero(near + (ex[rows, None] * cy + ey) >= threshold)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 18):
            a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            linked = cosine >= threshold
            yield a[linked], b[linked]


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """A row a vector: id, ``n_links, component_id, kept``; links need equal labels."""
    vector = F.col(vector_col)
    usable = (
        F.col(label_col).isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(vector, lambda v: v != 0)
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("v"), F.coalesce(usable, F.lit(False)).alias("ok"))
    # a node is a label and a vector, named by a hash; vectors travel by their nodes once they are counted
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "v")))
    good = rows.filter("ok")
    classes = good.groupBy("node", "label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = stage(classes.withColumn("dim", F.size("v")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    sizes = sizes.withColumn("tiles", F.ceil(F.col("rows") / TILE).cast("int"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.col("node"), F.col("tiles")).cast("int"))
    # tile t meets tiles u >= t: it is sent to the groups (t, u) and (u, t)
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(u, F.col("tile")).alias("a"), F.greatest(u, F.col("tile")).alias("b")))
    sent = dealt.withColumn("pair", F.explode(others)).select(
        "label", "dim", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "tile", "node", "n", "v"
    )

    def work(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group["a"].iloc[0], group["b"].iloc[0]
        left, right = group[group["tile"] == a], group[group["tile"] == b]
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "links": [], "up": []})
        same = a == b
        x = np.stack(left["v"].to_numpy()).astype(np.float64)
        y = x if same else np.stack(right["v"].to_numpy()).astype(np.float64)
        every = left if same else pd.concat([left, right])
        nodes, many = every["node"].to_numpy(np.int64), every["n"].to_numpy(np.int64)
        links, up = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        shift = 0 if same else len(left)

        def root(p: np.ndarray) -> np.ndarray:
            r = up[p]
            while not np.array_equal(up[r], r):
                r = up[r]
            return r

        for i, j in tile_links(x, y, threshold, same):
            j = j + shift
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            while len(i):
                p, q = root(i), root(j)
                apart = p != q
                if not apart.any():
                    break
                i, j, p, q = i[apart], j[apart], p[apart], q[apart]
                np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[hit], "links": links[hit], "up": nodes[root(hit)]})

    found = stage(sent.groupBy("label", "dim", "a", "b").applyInPandas(work, "node long, links long, up long"), "links")
    groups = connected_components(found, "node", "up")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        classes.select("node", "n", "least")
        .join(counts, "node", "left")
        .join(groups, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("id", "node").join(named, "node").select("id", "n_links", "component_id")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: links, component and verdict of every vector; nulls, ties and repeats as the module says."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
