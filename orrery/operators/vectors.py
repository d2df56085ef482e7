"""Nearest neighbours, centroids and weights of terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.blocks import close, nearest, unit
from orrery.storage import stage

LEAST, MOST = 1024, 16_384
#: Terms a task counts before it passes them on.
HELD = 250_000


def _tiles(vectors: DataFrame, key: str, vector: str, *more: Column, fill: bool = False) -> tuple[DataFrame, int]:
    """Rows with their tile: eight tiles or more of few vectors, of at most ``MOST`` of many, so that a vector is sent to few; ``fill`` makes no more tiles than needed."""
    many = vectors.count()
    n = max(1, -(-many // (MOST if fill else min(MOST, max(LEAST, many // 8)))))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), *more).filter(F.col("v").isNotNull())
    return rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def knn(vectors: DataFrame, key: str, vector: str, k: int, asked: Column | None = None) -> DataFrame:
    """``id, neighbor, similarity, rank``: exact cosine neighbours, ties by id; of the rows ``asked`` for only, if given, among all.

    Every pair of tiles is one bounded task that keeps k for each query; a window merges them.  The number of partitions is
    given, since Spark would deal by bytes, of which there are few beside the work.
    """
    rows, n = _tiles(vectors, key, vector)
    own, m = (rows, n) if asked is None else _tiles(vectors.filter(asked), key, vector, fill=True)
    other, mine, parts = F.sequence(F.lit(0), F.lit(n - 1)), F.sequence(F.lit(0), F.lit(m - 1)), min(m * n, 2048)
    queries = own.withColumn("b", F.explode(other)).select("id", "v", F.col("tile").alias("a"), "b").repartition(parts, "a", "b")
    corpus = rows.withColumn("a", F.explode(mine)).select(F.col("id").alias("other"), F.col("v").alias("w"), "a", F.col("tile").alias("b")).repartition(parts, "a", "b")

    def top(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"id": [], "neighbor": [], "similarity": []})
        return nearest(unit(q["v"]), q["id"].to_numpy(), unit(c["w"]), c["other"].to_numpy(), k)

    near = queries.groupBy("a", "b").cogroup(corpus.groupBy("a", "b")).applyInPandas(top, "id long, neighbor long, similarity double")
    best = W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "neighbor")
    return near.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def similar(vectors: DataFrame, key: str, vector: str, threshold: float, within: str | None = None) -> DataFrame:
    """``(id, n, up)``: from every pair of tiles, how many vectors of cosine ``threshold`` or more a vector has, and one to hang it on.

    Never the pairs themselves: sums of ``n`` are degrees, and components of ``(id, up)`` are those of all pairs.
    ``within`` names a column on which vectors must agree.
    """
    rows, n = _tiles(vectors, key, vector, (F.lit(0) if within is None else F.xxhash64(within)).alias("g"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda u: F.struct(F.least(u, "tile").alias("x"), F.greatest(u, "tile").alias("y")))
    sent = rows.withColumn("m", F.explode(meets)).select("id", "v", "g", "tile", "m.x", "m.y").repartition(min(n * (n + 1) // 2, 2048), "x", "y")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].iloc[0], part["y"].iloc[0]
        left, right = part[part["tile"] == x], part[part["tile"] == y]
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "n": [], "up": []})
        groups = (None, None) if within is None else (left["g"].to_numpy(), right["g"].to_numpy())
        one = unit(left["v"])
        counts, up = close(one, one if x == y else unit(right["v"]), threshold, x == y, *groups)
        ids = left["id"].to_numpy() if x == y else np.concatenate([left["id"], right["id"]])
        some = counts > 0
        return pd.DataFrame({"id": ids[some], "n": counts[some], "up": ids[up[some]]})

    return sent.groupBy("x", "y").applyInPandas(work, "id long, n long, up long")


def representatives(vectors: DataFrame, key: str, vector: str, group: str, k: int) -> DataFrame:
    """``group, id, similarity, rank``: the k rows nearest to their group's mean vector."""
    cells = vectors.select(group, F.posexplode(vector).alias("at", "x"))
    mean = cells.groupBy(group, "at").agg(F.avg("x").alias("m")).groupBy(group)
    centroid = mean.agg(F.sort_array(F.collect_list(F.struct("at", "m")))["m"].alias("c"))  # as long as a vector
    dot = F.aggregate(F.zip_with(vector, "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = vectors.join(centroid, group).select(group, F.col(key).alias("id"), F.round(dot, 4).alias("similarity"))
    best = W.partitionBy(group).orderBy(F.desc("similarity"), "id")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def term_counts(rows: DataFrame, group: str, words: str, n: int = 2) -> DataFrame:
    """``group, term, tf`` of words and runs of up to ``n`` words: each batch counts its own terms before any is shuffled.

    A task holds about ``HELD`` terms, or those of one text, whatever the length of its batch.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def passed(found: dict[object, Counter]) -> Iterator[pd.DataFrame]:
            for g, counts in found.items():
                yield pd.DataFrame({group: [g] * len(counts), "term": counts.keys(), "tf": counts.values()})

        for b in batches:
            found: dict[object, Counter] = {}
            for g, own in zip(b[group], b[words], strict=True):
                if own is not None:
                    own = list(own)
                    counts = found.setdefault(None if pd.isna(g) else g, Counter())
                    counts.update(own)
                    for k in range(2, n + 1):
                        counts.update(map(" ".join, zip(*(own[i:] for i in range(k)), strict=False)))
                    if sum(map(len, found.values())) > HELD:
                        yield from passed(found)
                        found = {}
            yield from passed(found)

    kind = rows.schema[group].dataType.simpleString()
    parts = rows.select(group, words).mapInPandas(count, f"{group} {kind}, term string, tf long")
    return parts.repartition("term").groupBy(group, "term").agg(F.sum("tf").alias("tf"))  # so that a term's groups lie together


def group_tfidf(tf: DataFrame, group: str, term: str, k: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """``group, term, weight, rank`` from counts ``tf``: the k terms of most weight, groups as documents, smooth idf, unit length.

    Only terms of ``min_df`` groups or more, and of at most the share ``max_df`` of all groups, count.
    """
    tf = stage(tf.withColumn("df", F.count("*").over(W.partitionBy(term))), "tf")
    n = tf.select(group).distinct().agg(F.count("*").alias("n"))
    counted = tf.join(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))  # n: one row
    weighted = counted.select(group, term, (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weighted.groupBy(group).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    scored = weighted.join(norm, group).withColumn("weight", F.round(F.col("w") / F.col("norm"), 4))
    best = W.partitionBy(group).orderBy(F.desc("weight"), term)
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).select(group, term, "weight", "rank")
