"""Mixing sources to target word counts by entropy balancing.

Rates of documents stay as near to one as they can (in entropy, weighed by words)
while each source gives its target words, no rate is above ``max_rate``, and the
mix keeps the corpus's mean length class (the power of two in a document's
words), so that weighing sources up or down does not make documents longer or
shorter.  The solution is a truncated exponential tilt,
``rate = min(max_rate, exp(lambda_source + mu * (class - mean)))``: the dual is
convex in one ``lambda`` a source and one ``mu`` for all.

Newton works on what documents give in sums: documents are first added up,
map-side, into cells of a source and a length class.  Each iteration is one job
over the sources: a row solves its own ``lambda`` under the present ``mu``, and the
gradient and the Hessian of the dual in ``mu`` (after ``lambda`` is eliminated) are
summed over all sources; only that one row of sums reaches the driver.  A small
ridge keeps ``mu`` finite where the targets leave it no room.

Rates are then rounded into whole copies.  A cell's fractional share goes to the
documents that come first in a hash order; the cut is found from sums over hash
buckets and an ordering of the single bucket that holds it, so that a source
with a third of all rows is never ordered in one task.  What rounding leaves
over or short in a source is then made good among its smallest documents.

Defined results: null text and empty text have size 0 and are never taken; a
null source is a source of its own, after all others; rows with equal id and
size share their hash and are taken alike; an empty table gives an empty table;
very long texts are counted whole; extra columns pass through, but for those
with the names of added columns, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKET_BITS = 10
NEWTON_STEPS, INNER_STEPS = 40, 40
RIDGE = 1e-4  # of all words
ENOUGH = 1e-7  # of all words times classes: gradient at which Newton ends


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``position``, from 0 by code point, null last: ranks in ranges, and how many come before each range."""
    order = F.col("source").asc_nulls_last()
    ranges = stage(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("range").orderBy(order)) - 1
    return ranges.withColumn("rank", rank).join(before, "range").withColumn("position", F.col("rank") + F.col("before")).drop("range", "rank", "before")


def with_targets(sources: DataFrame, total_ratio: float, max_rate: float, weights: tuple[int, ...]) -> DataFrame:
    """Sources with ``target``: shares by weight, capped, the excess dealt again by weight."""
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    known = stage(ranked(sources).withColumn("weight", pick), "sources")
    cap = max_rate * F.col("source_size")
    first = known.agg(F.sum("source_size").alias("mass"), F.sum("weight").alias("weight")).first()
    total = total_ratio * (first["mass"] or 0)
    level, capped = total / (first["weight"] or 1.0), -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        now = known.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, cap)).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
        ).first()
        if now["n"] == capped or not now["open"]:
            break
        capped = now["n"]
        level = (total - (now["held"] or 0.0)) / now["open"]
    return known.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _sum(cells: Column, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda total, c: total + value(c))


def tilt(cells: Column, target: Column, mu: float, max_rate: float, steps: int = INNER_STEPS) -> Column:
    """``lambda`` with ``sum(mass * min(max_rate, exp(lambda + mu * x))) = target`` over cells (x, mass), by Newton on logarithms.

    The start ignores the truncation and is at or below the root.
    """

    def step(at: Column, _: Column) -> Column:
        def both(sums: Column, c: Column) -> Column:
            rate = F.exp(at + mu * c["x"])
            return F.struct(
                (sums["all"] + c["mass"] * F.least(rate, F.lit(max_rate))).alias("all"),
                (sums["free"] + F.when(rate < max_rate, c["mass"] * rate).otherwise(0.0)).alias("free"),
            )

        zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("free"))
        # a slope of nothing (all truncated) means a step too far: go back by one
        move = lambda s: F.when(s["free"] > 0, F.log(target / s["all"]) * s["all"] / s["free"]).otherwise(-1.0)
        return F.aggregate(cells, zero, both, lambda s: at + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), move(s))))

    start = F.log(target / _sum(cells, lambda c: c["mass"] * F.exp(mu * c["x"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def solve_dual(sources: DataFrame, max_rate: float, keep_length: bool = True) -> tuple[DataFrame, float]:
    """Sources ``(source, cells, target, full)`` with ``lambda``, and ``mu``: Newton on the dual, kept within a bracket."""
    total = sources.agg(F.sum(_sum(F.col("cells"), lambda c: c["mass"]))).first()[0] or 0.0
    mu, low, high = 0.0, None, None
    for _ in range(NEWTON_STEPS if total and keep_length else 0):
        free = sources.withColumn("lambda", F.when(~F.col("full"), tilt(F.col("cells"), F.col("target"), mu, max_rate)))
        rate = lambda c: F.when(F.col("full"), F.lit(max_rate)).otherwise(F.least(F.exp(F.col("lambda") + mu * c["x"]), F.lit(max_rate)))
        open_ = lambda c: F.when(~F.col("full") & (rate(c) < max_rate), c["mass"] * rate(c)).otherwise(0.0)
        sums = free.select(
            _sum(F.col("cells"), lambda c: c["mass"] * rate(c) * c["x"]).alias("a"),
            _sum(F.col("cells"), open_).alias("d"),
            _sum(F.col("cells"), lambda c: open_(c) * c["x"]).alias("b"),
            _sum(F.col("cells"), lambda c: open_(c) * c["x"] * c["x"]).alias("c"),
        )
        got = sums.agg(F.sum("a").alias("a"), F.sum(F.col("c") - F.when(F.col("d") > 0, F.col("b") * F.col("b") / F.col("d")).otherwise(0.0)).alias("h")).first()
        gradient, hessian = got["a"] + RIDGE * total * mu, got["h"] + RIDGE * total
        if abs(gradient) <= ENOUGH * total:
            break
        low, high = (mu, high) if gradient < 0 else (low, mu)
        mu -= max(-1.0, min(1.0, gradient / hessian))
        if low is not None and high is not None and not low < mu < high:
            mu = (low + high) / 2
    return sources.withColumn("lambda", F.when(~F.col("full"), tilt(F.col("cells"), F.col("target"), mu, max_rate))), mu


def cut_cells(narrow: DataFrame, sums: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with ``bucket, last``, up to which documents in hash order hold about ``part`` words, and ``extra``, which they hold."""

    def of_cells(frame: DataFrame, *columns: str) -> DataFrame:
        named = frame.select(F.col("source").alias("s"), F.col("class").alias("c"), *columns)
        return named

    def same(frame: DataFrame) -> Column:
        return F.col("s").eqNullSafe(frame["source"]) & (F.col("c") == frame["class"])

    upto = sums.withColumn("upto", F.sum("mass").over(W.partitionBy("source", "class").orderBy("bucket")))
    upto = upto.withColumn("before", F.col("upto") - F.col("mass")).drop("mass")
    cut = upto.join(of_cells(cells, "part"), same(upto)).filter((F.col("before") <= F.col("part")) & (F.col("part") < F.col("upto")))
    cut = cut.groupBy("source", "class").agg(F.min(F.struct("bucket", "before", "part")).alias("cut")).select("source", "class", "cut.*")
    cut = stage(cut, "buckets cut")
    inside = narrow.withColumn("bucket", F.shiftright("h", 64 - BUCKET_BITS))
    at = of_cells(cut, F.col("bucket").alias("b"), (F.col("part") - F.col("before")).alias("need"))
    inside = inside.join(at, same(inside) & (F.col("bucket") == F.col("b"))).groupBy("source", "class", "h")
    inside = inside.agg(F.sum("size").alias("mass"), F.first("need").alias("need"))
    middle = F.sum("mass").over(W.partitionBy("source", "class").orderBy("h")) - F.col("mass") / 2
    taken = inside.withColumn("middle", middle).filter(F.col("middle") <= F.col("need"))
    taken = taken.groupBy("source", "class").agg(F.max("h").alias("last"), F.sum("mass").alias("inside"))
    found = cells.join(of_cells(cut, "bucket", "before"), same(cells), "left").drop("s", "c")
    found = found.join(of_cells(taken, "last", "inside"), same(cells), "left").drop("s", "c")
    extra = F.when(F.col("part") <= 0, 0).when(F.col("bucket").isNull(), F.col("mass")).otherwise(F.col("before") + F.coalesce("inside", F.lit(0)))
    return found.withColumn("extra", extra)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_ratio: float = 1.5,
    max_rate: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    keep_length: bool = True,
) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, rate, copies, taken``."""
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*[c for c in docs.columns if c in added and c not in (id_col, text_col, source_col)])
    key = F.xxhash64(F.col(id_col), F.col("size"))
    sized = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"))
    narrow = sized.select("source", F.xxhash64("id", "size").alias("h"), "size", length_class(F.col("size")).alias("class"))
    narrow = stage(narrow, "sizes")
    bucket = F.shiftright("h", 64 - BUCKET_BITS)
    sums = stage(
        narrow.groupBy("source", "class", bucket.alias("bucket")).agg(F.sum("size").alias("mass")), "buckets"
    )  # at most 2**BUCKET_BITS rows a cell
    cells = stage(sums.groupBy("source", "class").agg(F.sum("mass").alias("mass")), "cells")
    all_ = cells.agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("class")).alias("moment")).first()
    mean = all_["moment"] / all_["mass"] if all_["mass"] else 0.0
    cell = F.struct((F.col("class") - mean).alias("x"), F.col("mass").cast("double").alias("mass"))
    # a source has at most 64 cells
    sources = cells.groupBy("source").agg(F.sum("mass").alias("source_size"), F.array_sort(F.collect_list(cell)).alias("cells"))
    sources = with_targets(sources, total_ratio, max_rate, weights)
    full = (F.col("source_size") == 0) | (F.col("target") >= max_rate * F.col("source_size") * (1 - 1e-12))
    solved, mu = solve_dual(stage(sources.withColumn("full", full), "targets"), max_rate, keep_length)
    solved = solved.select(F.col("source").alias("s"), "source_size", "target", "full", "lambda")
    rate = F.when(F.col("full"), F.lit(max_rate)).otherwise(F.least(F.exp(F.col("lambda") + mu * (F.col("class") - mean)), F.lit(max_rate)))
    cells = cells.join(solved, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    cells = cells.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int"))
    cells = stage(cells.withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("mass")), "rates")

    first = stage(cut_cells(narrow, sums, cells), "cuts")
    # what is over or short in a source goes to its smallest documents that can take it
    rest = first.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("mass") + F.col("extra"))).alias("rest"))
    open_ = first.join(rest.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    open_ = open_.filter(~F.col("full") & (F.col("rate") > 0)).withColumn("part", F.col("extra") + F.col("rest"))
    open_ = open_.filter((F.col("part") >= 0) & (F.col("part") <= F.col("mass")))
    kept = [*cells.columns, "rest"]
    chosen = open_.groupBy("source").agg(F.min_by(F.struct(*[c for c in kept if c != "source"]), "class").alias("m")).select("source", "m.*")
    second = cut_cells(narrow, sums, stage(chosen, "rests")).filter(F.abs(F.col("part") - F.col("extra")) < F.abs("rest"))
    second = second.select(F.col("source").alias("s"), F.col("class").alias("c"), F.struct("part", "bucket", "last").alias("again"))
    plan = first.join(second, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left")
    cut = F.coalesce("again", F.struct("part", "bucket", "last"))
    plan = plan.select(
        F.col("source").alias("__source"), F.col("class").alias("__class"), "source_size", "target", "rate",
        F.col("whole").alias("__whole"), cut["part"].alias("__part"), cut["bucket"].alias("__bucket"), cut["last"].alias("__last"),
    )
    plan = stage(plan, "plan")  # a row a cell
    own = F.shiftright(key, 64 - BUCKET_BITS)
    extra = F.when(F.col("__part") <= 0, 0).when(F.col("__bucket").isNull() | (own < F.col("__bucket")), 1)
    extra = extra.when((own == F.col("__bucket")) & (key <= F.col("__last")), 1).otherwise(0)
    return (
        docs.withColumn("size", word_count(F.col(text_col)))
        .join(plan, F.col(source_col).eqNullSafe(F.col("__source")) & (length_class(F.col("size")) == F.col("__class")))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("__whole") + extra).otherwise(0).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*docs.columns, *added)
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: size, its source's size and target, and words taken; nulls, ties and repeats as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
