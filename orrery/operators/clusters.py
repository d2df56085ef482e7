"""Density clusters that are cut again while they are too large."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.blocks import close, unit
from orrery.operators.graph import connected_components
from orrery.operators.ranking import global_rank
from orrery.operators.vectors import similar
from orrery.storage import stage

CUT = 16_384


def _parts(inside: DataFrame, least: float, neighbours: int) -> DataFrame:
    """``(id, part)`` of core vectors: components, within each cluster, of those with so many near neighbours.

    Where all are core vectors, what counted their neighbours links them too, and no pair is compared again.
    """
    links = stage(similar(inside, "id", "v", least, within="cluster"), "near")
    degree = links.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= neighbours)
    cores = stage(inside.join(degree.select("id"), "id", "left_semi"), "cores")
    if cores.count() < inside.count():
        links = stage(similar(cores, "id", "v", least, within="cluster"), "links")
    found = connected_components(links, "id", "up")
    return cores.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("part"))


def _cut(x: np.ndarray, ids: np.ndarray, least: float, neighbours: int) -> list[np.ndarray]:
    """Places of the members of every part of one cluster, in order of the parts' smallest ids."""
    core = np.flatnonzero(close(x, x, least, True)[0] >= neighbours)
    if not len(core):
        return []
    core = core[np.argsort(ids[core])]
    up = close(x[core], x[core], least, True)[1]
    _, first, part = np.unique(up, return_index=True, return_inverse=True)
    order = np.argsort(part, kind="stable")
    groups = np.split(core[order], np.cumsum(np.bincount(part))[:-1])
    return [groups[k] for k in np.argsort(first)]


def recursive_clusters(
    vectors: DataFrame, key: str, vector: str, least: float, neighbours: int, most: int, step: float = 0.05, top: float = 0.999, cut: int = CUT
) -> DataFrame:
    """``key, cluster, parent, depth``: every vector at every depth at which it belongs to a cluster.

    Clusters of depth 0 are components of core vectors (``neighbours`` others of cosine ``least`` or more).  Those with more
    than ``most`` members wait on a list; each round cuts all of them at once by a similarity higher by ``step``, and parts
    that are too large still wait for the next.  A cluster that is not split keeps its place and is tried at the next
    similarity, until ``top``; one without a core vector has none at any higher similarity and waits no longer.  Ids are
    dense from 0 and those of a round lie above all given before; a part's order is that of its parent, then of its smallest
    vector.  Vectors that leave a cluster when it is cut stay with the parent only.

    A cluster of at most ``cut`` vectors goes through all its rounds in one task; larger ones are cut by tiles, a round for all.
    Until the end a cluster is named by its ``path``: the depths from its own to the first, then the smallest vectors from the
    first cluster to its own.  Paths sort as ids do.
    """
    rows = stage(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null"), "vectors")
    none = F.array().cast("array<long>")
    waiting, found, depth = rows.withColumns({"cluster": F.lit(-1).cast("long"), "path": none}), [], 0

    def finish(at: int, start: float):
        def work(part: pd.DataFrame) -> pd.DataFrame:
            x, ids, depth, least = unit(part["v"]), part["id"].to_numpy(), at, start
            todo, out = [(np.arange(len(ids)), list(part["path"].iloc[0]))], []
            while todo and least <= top:
                later = []
                for own, path in todo:
                    parts = _cut(x[own], ids[own], least, neighbours)
                    if depth and len(parts) == 1:  # one part of all members splits nothing
                        later.append((own, path))
                    if depth and len(parts) < 2:
                        continue
                    for p in parts:
                        new = [depth, *path, int(ids[own[p]].min())]
                        out.append(pd.DataFrame({"id": ids[own[p]], "path": [new] * len(p)}))
                        if len(p) > most:
                            later.append((own[p], new))
                todo, depth, least = later, depth + 1, least + step
            if not out:  # columns of no type would become numbers, which Arrow has no path for
                return pd.DataFrame({"id": pd.Series(dtype="int64"), "path": pd.Series(dtype="object")})
            return pd.concat(out)

        return work

    while least <= top:
        sizes = stage(waiting.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
        if sizes.isEmpty():
            break
        small = waiting.join(sizes.filter(F.col("n") <= cut).select("cluster"), "cluster", "left_semi")
        found.append(stage(small.repartition("cluster").groupBy("cluster").applyInPandas(finish(depth, least), "id long, path array<long>"), "finished"))
        large = sizes.filter(F.col("n") > cut).select("cluster")
        if large.isEmpty():
            break
        waiting = stage(waiting.join(large, "cluster", "left_semi"), "large")
        parts = stage(waiting.select("id", "cluster", "path").join(_parts(waiting, least, neighbours), "id"), "parts")
        many = stage(parts.groupBy("cluster", "part").agg(F.count("*").alias("n")), "many")
        again = waiting.limit(0)
        if depth:  # one part of all members splits nothing
            number = many.groupBy("cluster").agg(F.count("*").alias("k"))
            again = waiting.join(number.filter("k = 1").select("cluster"), "cluster", "left_semi")
            many = many.join(number.filter("k > 1").select("cluster"), "cluster", "left_semi")
        path = F.concat(F.array(F.lit(depth).cast("long")), "path", F.array("part"))
        new = stage(parts.join(many, ["cluster", "part"]).select("id", F.col("part").alias("cluster"), path.alias("path"), "n"), "clusters")
        found.append(new.select("id", "path"))
        deeper = rows.join(new.filter(F.col("n") > most).select("id", "cluster", "path"), "id")
        waiting = stage(deeper.select("id", "v", "cluster", "path").unionByName(again.select("id", "v", "cluster", "path")), "waiting")
        depth, least = depth + 1, least + step
    if not found:
        return rows.sparkSession.createDataFrame([], f"{key} long, cluster long, parent long, depth int")
    members = reduce(DataFrame.unionByName, found)
    ids = stage(global_rank(members.select("path").distinct(), [F.asc("path")], "place").select("path", (F.col("place") - 1).alias("cluster")), "ids")
    above = ids.select(F.col("path").alias("up"), F.col("cluster").alias("parent"))
    named = ids.withColumn("up", F.slice("path", F.lit(2), F.size("path") - 2)).join(above, "up", "left")
    found = members.join(named, "path").select("id", "cluster", "parent", F.col("path")[0].cast("int").alias("depth"))
    return found.withColumnRenamed("id", key)
