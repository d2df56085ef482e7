"""Best-fit-decreasing packing of whole documents into fixed-length sequences.

What best fit decides depends on lengths alone, and there are at most as many
lengths as a sequence has places.  Documents are tokenised once, where they
lie, and counts by length (a table of bounded size) are all that reaches the
driver.  There the planner takes lengths from long to short and asks a segment
tree over remaining capacities for the tightest open bin, in time logarithmic in
the capacity.  Equal documents go into equal bins by runs, so planning does not
grow with the documents.  The plan maps (length, number) to a sequence and a
place in it.  Pieces of a length are numbered in hash ranges of about ``RANGE``
pieces, after those of the ranges before: no task numbers all pieces of a length.

Defined results: null and empty texts have only the end id; a document longer
than a sequence is cut from its end into full pieces, so that the first may be
shorter; repeated rows are packed each; very long texts are tokenised whole;
extra columns do not matter, whatever their names; an empty table gives no
pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.tokens import encoder
from orrery.storage import stage

LENGTH = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
RANGE = 1 << 15
RUN = np.dtype([("size", "i4"), ("rank", "i8"), ("sequence", "i8"), ("each", "i4"), ("offset", "i4")])


class Capacities:
    """Open bins by remaining capacity, under a segment tree that finds the tightest capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]  # (first sequence, how many)

    def add(self, capacity: int, first: int, n: int) -> None:
        self.bins[capacity].append((first, n))
        k = self.leaves + capacity
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        got = self.bins[capacity].pop()
        if not self.bins[capacity]:
            k = self.leaves + capacity
            self.any[k] = 0
            while k > 1 and not self.any[k ^ 1]:
                k >>= 1
                self.any[k] = 0
        return got

    def tightest(self, size: int) -> int | None:
        """Least capacity of an open bin that is ``size`` or more."""
        k = self.leaves + size
        if self.any[k]:
            return size
        while k > 1:
            if not k & 1 and self.any[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.leaves:
            k = 2 * k + (not self.any[2 * k])
        return k - self.leaves


def plan_runs(counts: dict[int, int], length: int) -> np.ndarray:
    """Runs: items of ``size`` from number ``rank`` on go to sequences from ``sequence`` on, ``each`` to one, from ``offset``."""
    open_bins, runs, sequences = Capacities(length), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = open_bins.tightest(size)
            if room is None:
                room = length
                first, n = sequences, -(-left // (length // size))
                sequences += n
            else:
                first, n = open_bins.take(room)
            each = room // size
            need = -(-left // each)
            if n > need:
                open_bins.add(room, first + need, n - need)
                n = need
            placed = min(left, n * each)
            runs.append((size, rank, first, each, length - room))
            full = placed // each
            for capacity, start, many in ((room - each * size, first, full), (room - placed % each * size, first + full, n - full)):
                if many and capacity:
                    open_bins.add(capacity, start, many)
            rank, left = rank + placed, left - placed
    return np.array(runs, RUN)


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None, end_id: int, length: int, with_ids: bool) -> DataFrame:
    """Pieces of every document, each numbered among those of its length in its task."""

    names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path or public_tokenizers.path(TOKENIZER), spaced=True)  # where the executor has it
        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for b in batches:
            for at, ids, sizes in words.encode_parts(b.column("text"), end_id):
                ids, ends = ids.astype("<u4"), np.cumsum(sizes)
                docs, rows = [], []
                for k, (first, n) in enumerate(zip((ends - sizes).tolist(), sizes.tolist(), strict=True), at):
                    edges = [*range(n % length or length, n, length), n] if n > length else [n]
                    start = 0
                    for piece, end in enumerate(edges):
                        own = ids[first + start : first + end].tobytes()
                        docs.append(k)
                        rows.append((piece, start, end - start, zlib.crc32(own), part, int(seen[end - start]), own if with_ids else None))
                        seen[end - start] += 1
                        start = end
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(docs)), *found], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long, ids binary"
    )


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """A row a piece: id, ``piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids`` (little-endian)."""
    pieces = stage(tokenised_pieces(docs, id_col, text_col, path, end_id, length, with_ids), "pieces")
    by_length = stage(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_length.collect()}  # `length` rows at most
    runs = plan_runs(counts, length)
    many = by_length.select("length", (F.floor(F.col("n") / RANGE) + 1).alias("many"))
    dealt = pieces.join(F.broadcast(many), "length")  # `length` rows at most
    dealt = dealt.withColumn("range", F.pmod(F.xxhash64("part", "rank"), F.col("many")))
    sums = stage(dealt.groupBy("length", "range").agg(F.count("*").alias("n")), "ranges")
    before = F.sum("n").over(W.partitionBy("length").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select("length", "range", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("length", "range").orderBy("part", "rank")) - 1
    numbered = dealt.withColumn("inside", inside).join(bases, ["length", "range"]).withColumn("number", F.col("base") + F.col("inside"))
    step = 1 << 44  # more than any count of pieces of one length
    keys = runs["size"].astype(np.int64) * step + runs["rank"]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["number"].to_numpy(np.int64)
            run = runs[np.searchsorted(keys, b["length"].to_numpy(np.int64) * step + rank, "right") - 1]
            at = rank - run["rank"]
            b["sequence_id"] = run["sequence"] + at // run["each"]
            b["offset"] = run["offset"] + at % run["each"] * run["size"].astype(np.int64)
            yield b.drop(columns=["number"])

    columns = [f for f in pieces.schema.names if f not in ("part", "rank")]
    if not with_ids:
        columns.remove("ids")
    placed = numbered.select("number", *columns)
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return placed.mapInPandas(place, f"{kinds}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as pieces in sequences; nulls, empties, ties and repeats as the module says."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
