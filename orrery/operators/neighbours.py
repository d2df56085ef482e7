"""Exact nearest neighbours with pivots that prune, and hashed text vectors.

Vectors of unit length lie in the cell of their nearest pivot.  A query knows how
far its k-th neighbour among its own tile is; a cell whose ball of radius r around
its pivot p is farther than that, |q - p| - r > bound, can hold no neighbour, and its
tiles are not visited for it.  Cells that lie near one another share a tile, and one
place with a third of all vectors is many tiles, cut by a hash of the id: a vector goes to
few tiles even where nothing can be pruned, once for each, never once for a cell.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.operators.blocks import nearest, unit
from orrery.operators.vectors import LEAST, MOST
from orrery.storage import stage

PIVOTS, SLACK = 256, 1e-6


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` without null vectors; single precision stays as it is, so that it is shuffled so."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter("v is not null")


def _chain(centres: np.ndarray) -> list[int]:
    """All centres, each followed by the nearest of the rest."""
    at, left = 0, set(range(len(centres)))
    order = []
    while True:
        order.append(at)
        left.discard(at)
        if not left:
            return order
        rest = sorted(left)
        at = rest[int((centres[rest] @ centres[at]).argmax())]


@dataclass(frozen=True)
class Cells:
    """Vectors as ``id, v, tile``, and of each cell: its centre, its radius and its tiles."""

    placed: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    tiles: list[list[int]]


def cells_of(rows: DataFrame, pivots: int = PIVOTS, tile: int | None = None) -> Cells | None:
    """Cells of ``id, v`` in tiles of about ``tile`` vectors; at most ``pivots`` vectors come to the driver.  None without a vector."""
    n = rows.count()
    many, tile = max(1, min(pivots, int(n**0.5))), tile or min(MOST, max(LEAST, n // 8))
    chosen = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(many).collect()]
    if not chosen:
        return None
    centres = unit(pd.Series(chosen))
    kind = rows.schema["v"].dataType.simpleString()

    def settle(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _apart(unit(b["v"]), centres) if len(b) else np.zeros((0, len(centres)))
            yield b.assign(cell=d.argmin(axis=1).astype("int32"), d=d.min(axis=1, initial=np.inf))

    settled = stage(rows.mapInPandas(settle, f"id long, v {kind}, cell int, d double"), "cells")
    sizes = {r.cell: (r.n, r.d) for r in settled.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()}  # a row a pivot
    known = sorted(sizes)
    first, many_tiles, total, held = {}, {}, 0, tile
    for c in (known[i] for i in _chain(centres[known])):
        size = sizes[c][0]
        if size > tile:  # tiles of its own
            many_tiles[c], first[c], held = -(-size // tile), total, tile
            total += many_tiles[c]
        else:
            if held + size > tile:
                total, held = total + 1, 0
            many_tiles[c], first[c], held = 1, total - 1, held + size
    spread = F.create_map(*[F.lit(x) for c in known for x in (c, many_tiles[c])])
    start = F.create_map(*[F.lit(x) for c in known for x in (c, first[c])])
    placed = settled.withColumn("tile", (start[F.col("cell")] + F.pmod(F.xxhash64("id"), spread[F.col("cell")])).cast("int"))
    tiles = [list(range(first[c], first[c] + many_tiles[c])) for c in known]
    return Cells(stage(placed.select("id", "v", "tile"), "tiles"), centres[known], np.array([sizes[c][1] for c in known]), tiles)


def pruned_knn(vectors: DataFrame, key: str, vector: str, k: int, pivots: int = PIVOTS, tile: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``id, neighbor, similarity, rank`` as all pairs would give them, and one row ``(visited, pairs)`` of tile pairs.

    Null vectors have no neighbours and are nobody's; ids are unique longs.
    """
    rows = _vectors(vectors, key, vector)
    cells = cells_of(rows, pivots, tile)
    if cells is None:
        none = rows.select("id", F.col("id").alias("neighbor"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("rank"))
        return none, rows.agg(F.count("*").alias("visited"), F.count("*").alias("pairs"))
    return knn_in_cells(cells, k)


def knn_in_cells(cells: Cells, k: int) -> tuple[DataFrame, DataFrame]:
    """`pruned_knn` over vectors that lie in cells.  What a query has to visit is kept as a list of tiles, not as copies of its vector."""
    placed, centres, radius, tiles = cells.placed, cells.centres, cells.radius, cells.tiles
    kind, total = placed.schema["v"].dataType.simpleString(), 1 + max(t for own in tiles for t in own)
    of = np.zeros((len(tiles), total), np.float32)  # which tiles a cell has
    for c, own in enumerate(tiles):
        of[c, own] = 1
    parts = min(total * total, 2048)

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        """Which tiles each query of a tile has to visit."""
        x, ids = unit(part["v"]), part["id"].to_numpy()
        least = nearest(x, ids, x, ids, k).groupby("id")["similarity"].agg(["min", "size"])
        least = least["min"].where(least["size"] == k).reindex(ids).to_numpy()
        kth = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least)))
        near = _apart(x, centres) - radius[None, :] <= kth[:, None] + SLACK
        to = near.astype(np.float32) @ of > 0
        return pd.DataFrame({"id": ids, "v": part["v"], "a": part["tile"], "b": [np.flatnonzero(row).tolist() for row in to]})

    asked = stage(placed.groupBy("tile").applyInPandas(bound, f"id long, v {kind}, a int, b array<int>"), "asked")
    pairs = stage(asked.select("a", F.explode("b").alias("b")).distinct(), "pairs")
    queries = asked.withColumn("b", F.explode("b")).repartition(parts, "a", "b")
    corpus = placed.select(F.col("id").alias("other"), F.col("v").alias("w"), F.col("tile").alias("b")).join(F.broadcast(pairs), "b")  # a row a pair of tiles
    corpus = corpus.repartition(parts, "a", "b")

    def top(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"id": [], "neighbor": [], "similarity": []})
        return nearest(unit(q["v"]), q["id"].to_numpy(), unit(c["w"]), c["other"].to_numpy(), k)

    near = queries.groupBy("a", "b").cogroup(corpus.groupBy("a", "b")).applyInPandas(top, "id long, neighbor long, similarity double")
    best = W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "neighbor")
    found = near.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return found, pairs.agg(F.count("*").alias("visited"), F.lit(total * total).cast("long").alias("pairs"))


def text_vectors(rows: DataFrame, key: str, text: Column, size: int = 256) -> DataFrame:
    """``key, vector``: hashed words weighted by inverse document frequency, of unit length; null without a word.

    One pass counts in how many texts each of the ``size`` places occurs; no vocabulary is kept.
    """
    words = rows.select(key, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("__words"))
    counted = HashingTF(numFeatures=size, inputCol="__words", outputCol="__tf").transform(words)
    weighted = IDF(inputCol="__tf", outputCol="__w").fit(counted).transform(counted)
    unit = Normalizer(inputCol="__w", outputCol="__u").transform(weighted)
    return unit.select(key, F.when(F.size("__words") > 0, vector_to_array("__u")).alias("vector"))
