"""String similarity in Arrow batches, and joins that block before they compare."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.storage import stage


def indel(a: str, b: str) -> float:
    """2 * longest common subsequence / total length; 1 for two empty strings. Bits of one integer hold a row of the table."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def indels(a: list[str], b: list[str]) -> np.ndarray:
    """``indel`` of every pair; names of at most 63 letters go through the table together, in two bands of length."""
    m, n = (np.fromiter(map(len, own), np.int64, len(own)) for own in (a, b))
    longest, found = np.maximum(m, n), np.zeros(len(a))
    for low, high in ((-1, 16), (16, 63)):
        some = np.flatnonzero((longest > low) & (longest <= high))
        if not len(some):
            continue
        x, y = (np.array([own[k] for k in some.tolist()], dtype=f"U{max(1, int(size[some].max()))}").view(np.uint32).reshape(len(some), -1).T.copy() for own, size in ((a, m), (b, n)))
        full = (np.uint64(1) << m[some].astype(np.uint64)) - np.uint64(1)
        row = full.copy()
        for j, other in enumerate(y):
            hit = np.zeros(len(some), np.uint64)
            for i, letter in enumerate(x):
                hit |= (letter == other).astype(np.uint64) << np.uint64(i)
            hit *= (j < n[some]).astype(np.uint64)  # shorter names are filled up; bits beyond the other one are not of the row
            hit &= row
            row = ((row + hit) | (row - hit)) & full
        sizes = (m + n)[some]
        found[some] = np.where(sizes > 0, 2 * (m[some] - np.bitwise_count(row).astype(np.int64)) / np.maximum(sizes, 1), 1.0)
    for k in np.flatnonzero(longest > 63).tolist():
        found[k] = indel(a[k], b[k])
    return found


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indels([x or "" for x in a], [y or "" for y in b]))


#: Ways to leave letters out of a name of which each is a key of its own; beyond them names are found by rare tokens.
KEYS = 64


def token_sort(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(F.lower(text)), r"\s+")), " ")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best indel ratio of the shared words with and without what each side has beside them."""
    x, y = (F.array_distinct(F.split(F.trim(F.lower(t)), r"\s+")) for t in (a, b))
    both = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    left, right = (F.trim(F.concat_ws(" ", both, F.array_join(F.array_sort(F.array_except(p, q)), " "))) for p, q in ((x, y), (y, x)))
    return F.greatest(indel_ratio(both, left), indel_ratio(both, right), indel_ratio(left, right))


def shared_from(threshold: float) -> float:
    """Least length of the longer of two names from which a ratio of ``threshold`` leaves them a pair of letters in common.

    Names of m and n letters are at most ``d = (1 - ratio) * (m + n)`` insertions and deletions apart, and each of these
    takes at most two of the longer one's m - 1 pairs.  Infinite if no length is enough.
    """
    if 1 - 4 * (1 - threshold) <= 0:
        return float("inf")
    fails = [m for m in range(1, int(2 / (1 - 4 * (1 - threshold))) + 2) if m - 1 - 2 * int((1 - threshold) * 2 * m + 1e-9) < 1]
    return max(fails, default=0) + 1


def name_tokens(threshold: float) -> Callable[[Column], Column]:
    """Numbered pairs of letters (``=``) and letters (``-``) of names, with how many of the rarest have to be looked at.

    Of two names whose indel ratio is ``threshold`` or more, the longer one either has ``shared_from`` letters, and they share
    pairs, or both are shorter and share letters: at least ``ratio * (m + n) / 2`` of them.  Whatever the order of all tokens is, if t of them are
    shared, the first ``size - t + 1`` of both names have one in common.  A name has no more tokens than twice its letters.
    """
    least, band = shared_from(threshold), threshold / (2 - threshold)

    def kept(n: int) -> tuple[int, int]:
        """How many pairs and letters of a name of ``n`` letters are looked at, over all lengths of its partner."""
        pairs = letters = 0
        for m in range(math.ceil(n * band - 1e-9), int(n / band + 1e-9) + 1):
            longer = max(m, n)
            if longer >= least:
                shared = longer - 1 - 2 * int((1 - threshold) * (m + n) + 1e-9)
                pairs = max(pairs, n - 1 - max(1, shared) + 1)
            else:
                letters = max(letters, n - max(1, math.ceil(threshold * (m + n) / 2 - 1e-9)) + 1)
        return pairs, letters

    @F.pandas_udf("array<struct<token: string, keep: int>>")
    def tokens(names: pd.Series) -> pd.Series:
        found, sizes = [], {}
        for name in names:
            own = [] if name != "" else [{"token": "-", "keep": 1}]
            if name:
                n = len(name)
                if n not in sizes:
                    sizes[n] = kept(n)
                for mark, keep, parts in zip("=-", sizes[n], ([name[k : k + 2] for k in range(n - 1)], name), strict=True):
                    seen: Counter = Counter()
                    for p in parts if keep > 0 else ():
                        seen[p] += 1
                        own.append({"token": f"{mark}{p}{seen[p]}", "keep": keep})
            found.append(own)
        return pd.Series(found)

    return tokens


def shared_letters(left: list[int], right: list[int], least: float, most: int) -> tuple[list[dict[int, list[int]]], list[list[int]]]:
    """How two names can be found by the letters that they share in order, by their lengths.

    Two names have a ratio of ``least`` or more if and only if so many letters of either, left in order, are the same.  For lengths of
    which either name has at most ``most`` ways to keep so many, both sides get that number; other lengths that can reach
    ``least`` are given as they are.
    """
    parts, rest = [{}, {}], [set(), set()]
    for m in left:
        for n in right:
            need = math.ceil(least * (m + n) / 2 - 1e-9)
            if need > min(m, n):
                continue
            if max(math.comb(m, need), math.comb(n, need)) <= most:
                for side, size in enumerate((m, n)):
                    parts[side].setdefault(size, set()).add(need)
            else:
                rest[0].add(m)
                rest[1].add(n)
    return [{size: sorted(needs) for size, needs in own.items()} for own in parts], [sorted(own) for own in rest]


def letters_kept(needs: dict[int, list[int]]) -> Callable[[Column], Column]:
    """The different strings that are left of a name if so many of its letters are kept in order; none for other lengths."""

    @F.pandas_udf("array<string>")
    def parts(names: pd.Series) -> pd.Series:
        return pd.Series([sorted({"".join(c) for need in needs.get(len(n), ()) for c in combinations(n, need)}) for n in names], dtype=object)

    return parts


def fuzzy_join(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, block: list[str], threshold: float, top: int, order: list[str]
) -> DataFrame:
    """Pairs within equal ``block`` columns whose names have an indel ratio, to four digits, of ``threshold``, which is
    above 0; the best ``top`` of each left row.

    Distinct names are compared, once each, if they are the same but for the few letters that the ratio allows; where that can be too many
    ways (``KEYS``), if they share one of their rarest tokens (see ``name_tokens``; counted over both
    sides) and their lengths allow the ratio: min(length) / max(length) >= r / (2 - r).  Rows come in after that.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold above 0 and of at most 1 is needed, not {threshold}")
    least = max(threshold - 5e-5, threshold / 2)  # what is rounded up to the threshold
    tokens, band = name_tokens(least), least / (2 - least)
    one, two = (rows.select(*block, F.col(name).alias("name")).filter(F.col(name).isNotNull()).distinct() for rows, name in ((left, left_name), (right, right_name)))
    sizes = [rows.agg(F.sort_array(F.collect_set(F.length(name)))).first()[0] for rows, name in ((left, left_name), (right, right_name))]  # lengths, not names
    needs, rest = shared_letters(*sizes, least, KEYS)
    x, y = (rows.select(*block, F.col("name").alias(name), F.explode(letters_kept(own)("name")).alias("part")) for rows, own, name in ((one, needs[0], "__x"), (two, needs[1], "__y")))
    names = x.join(y, [*block, "part"]).select(*block, "__x", "__y")
    if rest[0]:
        one, two = (rows.filter(F.length("name").isin(own)).withColumn("side", F.lit(side)) for side, (rows, own) in enumerate(((one, rest[0]), (two, rest[1]))))
        told = stage(one.unionByName(two).withColumn("t", F.explode(tokens("name"))).select(*block, "name", "side", "t.*"), "tokens")
        seen = told.groupBy("token").agg(F.count("*").alias("seen"))
        rarest = W.partitionBy(*block, "side", "name", F.substring("token", 1, 1)).orderBy("seen", "token")
        keyed = told.join(seen, "token").withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= F.col("keep")).drop("at", "keep", "seen")
        keyed = stage(keyed, "keys")
        a, b = F.length("__x"), F.length("__y")
        x, y = keyed.filter("side = 0").drop("side").withColumnRenamed("name", "__x"), keyed.filter("side = 1").drop("side").withColumnRenamed("name", "__y")
        more = x.join(y, [*block, "token"]).filter(F.least(a, b) >= F.greatest(a, b) * band - 1e-9).select(*block, "__x", "__y")
        names = names.unionByName(more) if needs[0] else more
    names = names.distinct().withColumn("similarity", F.round(indel_ratio(F.col("__x"), F.col("__y")), 4)).filter(F.col("similarity") >= threshold)
    # a right name gives its first `top` rows only, and what is best for a left name is best for all its copies
    then = [c for c in order[1:] if c in right.columns]
    copies = W.partitionBy(*block, right_name).orderBy(*then or [right_name])
    few = right.withColumn("__at", F.row_number().over(copies)).filter(F.col("__at") <= top).drop("__at")
    hits = names.join(few.withColumn("__y", F.col(right_name)), [*block, "__y"]).drop("__y")
    nearest = W.partitionBy(*block, "__x").orderBy(F.desc("similarity"), *then)
    hits = hits.withColumn("__at", F.row_number().over(nearest)).filter(F.col("__at") <= top).drop("__at")
    pairs = left.withColumn("__x", F.col(left_name)).join(hits, [*block, "__x"]).drop("__x")
    best = W.partitionBy(order[0]).orderBy(F.desc("similarity"), *order[1:])
    return pairs.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= top)


def pairs_of_copies(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: list[str], score: Callable[[DataFrame], DataFrame], salts: int = 16) -> DataFrame:
    """Pairs of rows within equal ``block`` columns, ``score``d once for all copies.

    Rows that agree in all columns but their key are copies.  ``score`` gets pairs of distinct rows, may drop pairs and
    add columns, and keeps ``__l`` and ``__r``; the result has both keys beside what it adds.  The number of tasks is fixed, since
    Spark deals by bytes, and few bytes of names make many pairs.
    """
    parts = 4 * left.sparkSession.sparkContext.defaultParallelism

    def told(rows: DataFrame, key: str, mark: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.dropna(subset=block)
        own = [c for c in rows.columns if c != key]
        distinct = stage(rows.select(own).distinct().withColumn(mark, F.monotonically_increasing_id()), "distinct")
        same = [F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`")) for c in own]
        return distinct, stage(rows.alias("x").join(distinct.alias("y"), same).select(F.col(f"x.`{key}`").alias(key), F.col(f"y.{mark}").alias(mark)), "members")

    (one, of_one), (two, of_two) = told(left, left_key, "__l"), told(right, right_key, "__r")
    one = one.withColumn("__salt", F.pmod(F.xxhash64("__l"), F.lit(salts)).cast("int")).repartition(parts, *block, "__salt")
    two = two.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, *block, "__salt")
    pairs = score(one.join(two, [*block, "__salt"]))
    added = [c for c in pairs.columns if c not in {*one.columns, *two.columns}]
    found = stage(pairs.select("__l", "__r", *added), "pairs")
    whole = found.repartition(parts, "__l").join(of_one.repartition(parts, "__l"), "__l").join(of_two, "__r")
    return whole.select(left_key, right_key, *added)


def cascade(rows: DataFrame, targets: DataFrame, key: str, keys: list[tuple[str, Column, Column]], target_id: str) -> DataFrame:
    """``key, stage, target_id``: the first of the named equi-joins that finds a target, its smallest id."""
    found = None
    for rank, (stage, left, right) in enumerate(keys):
        hits = rows.select(F.col(key).alias("__key"), left.alias("__k")).join(targets.select(right.alias("__k"), target_id), "__k")
        hits = hits.groupBy("__key").agg(F.min(target_id).alias(target_id)).select("__key", target_id, F.lit(stage).alias("stage"), F.lit(rank).alias("rank"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("__key").agg(F.min_by(F.struct("stage", target_id), "rank").alias("m"))
    return best.select(F.col("__key").alias(key), F.col("m.stage").alias("stage"), F.col(f"m.{target_id}").alias(target_id))
