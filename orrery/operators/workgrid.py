"""A grid of searches to do: its cells, what attempts made of them, which come next and how far the whole is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(phases: Sequence[tuple[DataFrame, DataFrame | None]], keyword: str = "keyword", state: str = "state") -> DataFrame:
    """``keyword, state, phase, status, results``: every keyword of a phase with each of its states, or with none (null: everywhere).

    A cell of several phases lies in the first of them.  All cells are pending.
    """
    found = None
    for number, (words, states) in enumerate(phases, 1):
        words = words.select(F.col(keyword).alias("keyword")).distinct()
        # the product of two lists of search terms is what a grid is
        rows = words.withColumn("state", F.lit(None).cast("string")) if states is None else words.crossJoin(states.select(F.col(state).cast("string").alias("state")).distinct())
        rows = rows.withColumn("phase", F.lit(number))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("keyword", "state").agg(F.min("phase").alias("phase")).withColumns({"status": F.lit("pending"), "results": F.lit(None).cast("long")})


def attempted(grid: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """The grid after attempts (``keyword, state, at, ok, results``): a cell with a success is completed, and stays so whatever
    fails later; one that failed ``most`` times is failed; one that failed less often is to be tried again (retry).

    Adds ``tries``, ``last_at`` and ``results``, which come from the last success, later rows of the same time being told apart by
    their results.  A null state is a state of its own.  Attempts of no cell are ignored.
    """
    sums = attempts.groupBy("keyword", "state").agg(
        F.count("*").alias("tries"), F.count_if("ok").alias("__ok"), F.max("at").alias("last_at"),
        F.max(F.when(F.col("ok"), F.struct("at", "results"))).alias("__best"),
    )
    a = sums.withColumnsRenamed({"keyword": "__k", "state": "__s"})
    rows = grid.drop("tries", "last_at", "results").join(a, (F.col("keyword") == F.col("__k")) & F.col("state").eqNullSafe(F.col("__s")), "left")
    status = F.when(F.col("__ok") > 0, "completed").when(F.col("tries") >= most, "failed").when(F.col("tries") > 0, "retry").otherwise(F.col("status"))
    return rows.select("keyword", "state", "phase", status.alias("status"), F.coalesce("tries", F.lit(0)).alias("tries"), "last_at", F.col("__best.results").alias("results"))


def upcoming(grid: DataFrame, n: int) -> DataFrame:
    """The ``n`` cells to be searched next: by phase, new ones before those to be tried again, then by keyword and state."""
    order = (F.col("phase"), F.col("status") == "retry", F.col("keyword"), F.col("state").asc_nulls_first())
    return grid.filter(F.col("status").isin("pending", "retry")).orderBy(*order).limit(n)


def progress(grid: DataFrame) -> DataFrame:
    """``phase, cells, completed, failed, open, results, percent`` by phase."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    sums = grid.groupBy("phase").agg(F.count("*").alias("cells"), of("completed").alias("completed"), of("failed").alias("failed"), of("pending", "retry").alias("open"), F.coalesce(F.sum("results"), F.lit(0)).alias("results"))
    return sums.withColumn("percent", F.round(100 * F.col("completed") / F.col("cells"), 2))
