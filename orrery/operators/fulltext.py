"""A stored full-text index: postings by term in ranges, searched by prefix, by stem and by rank.

A posting is ``(term, key, tf, length)``: how often a text has a term, and how
many terms the text has.  A task counts the terms of a batch of texts and keeps the postings of each
term together, so that a row is a term of a batch, not a term of a text; rows are
written in ranges of the term and sorted by it, so that the files (and row groups) which a prefix needs are told
by their statistics, and a term of every text is spread over several rows.  A
second copy of the postings, by stem, serves stemmed searches.  Texts are read
when the index is built, never by a search.

Null and empty texts have no postings and count as texts for ranks; a query
without a word finds nothing; repeated keys are one text, which a search puts together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.stem import porter, stem
from orrery.storage import drop_staged, stage

K1, B = 1.2, 0.75
#: Bytes of text whose terms a task counts at once.
BATCH = 1 << 24


def query_words(words: str) -> list[str]:
    """Words of a query, what is not a letter or digit taken out; each once."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in words.lower()).split()))


@dataclass(frozen=True)
class Index:
    """The folder of a written index."""

    spark: SparkSession
    where: str

    def postings(self, by: str = "term") -> DataFrame:
        """``term`` (or ``stem``), ``key, tf, length``; a repeated key, or two terms of a stem, may give a text several."""
        return self.spark.read.parquet(f"{self.where}/{by}").select(by, F.inline("postings"))

    def totals(self) -> DataFrame:
        """One row: ``texts`` and ``terms`` of the whole table."""
        return self.spark.read.parquet(f"{self.where}/totals")


def _counted(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """``term, postings, n`` of some lower-cased texts: a row a term with its texts in order."""
    lists = pc.split_pattern_regex(texts, "[^a-z0-9]+")
    found = lists.flatten().dictionary_encode()
    terms, codes = found.dictionary, found.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = ~np.equal(codes, pc.index(terms, pa.scalar("", terms.type)).as_py())  # what lies before, between and after
    codes, text = codes[some], text[some]
    length = np.bincount(text, minlength=len(texts))
    pairs = np.sort(codes.astype(np.int64) * len(texts) + text)
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    tf = np.diff(starts, append=len(pairs))
    code, text = np.divmod(pairs[starts], len(texts))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = pa.array(np.append(first, len(code)), pa.int32())
    postings = pa.StructArray.from_arrays([keys.take(pa.array(text)), pa.array(tf, pa.int64()), pa.array(length[text], pa.int64())], ["key", "tf", "length"])
    n = np.add.reduceat(tf, first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([terms.take(pa.array(code[first])), pa.ListArray.from_arrays(offsets, postings), pa.array(n, pa.int64())], ["term", "postings", "n"])


def _blocks(words: DataFrame) -> DataFrame:
    """``term, postings, n`` of rows ``key, text``: a row a term of about ``BATCH`` bytes of text."""
    kind = words.schema["key"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            found = _counted(table["key"].combine_chunks(), table["text"].combine_chunks())
            for at in range(0, found.num_rows, 4096):
                yield found.slice(at, 4096)

        for b in batches:
            for at in range(0, b.num_rows, 256):  # texts may be long
                held.append(b.slice(at, 256))
                size += held[-1].column("text").nbytes
                if size >= BATCH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return words.mapInArrow(count, f"term string, postings array<struct<key: {kind}, tf: bigint, length: bigint>>, n bigint")


def build_index(rows: DataFrame, key: str, text: Column, where: str, stems: bool = False) -> Index:
    """Write the index of ``text`` under ``where`` and return it."""
    words = rows.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    blocks = stage(_blocks(words.filter("text <> ''")), "blocks")
    ordered = blocks.withColumn("at", F.col("postings")[0]["key"]).repartitionByRange("term", "at").sortWithinPartitions("term", "at")
    ordered.select("term", "postings").write.parquet(f"{where}/term")
    totals = words.agg(F.count_distinct("key").alias("texts")).crossJoin(blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("terms")))  # one row each
    totals.write.parquet(f"{where}/totals")
    if stems:
        by_stem = blocks.select(stem(F.col("term")).alias("stem"), "postings", F.col("postings")[0]["key"].alias("at"))
        by_stem = by_stem.repartitionByRange("stem", "at").sortWithinPartitions("stem", "at")
        by_stem.select("stem", "postings").write.parquet(f"{where}/stem")
    drop_staged(blocks)
    return Index(rows.sparkSession, where)


def search_prefixes(index: Index, words: str) -> DataFrame:
    """``key, hits`` of texts in which each query word begins some term; hits counts the terms that do."""
    prefixes = query_words(words)
    term = F.col("term")
    if not prefixes:
        return index.postings().select("key", F.lit(0).cast("long").alias("hits")).filter("false")
    fits = [term.startswith(p) for p in prefixes]
    some = fits[0]
    for f in fits[1:]:
        some = some | f
    found = index.postings().filter(some)  # pushed down: files whose terms cannot begin so are not read
    parts = [F.sum(F.when(f, F.col("tf")).otherwise(0)).alias(f"h{k}") for k, f in enumerate(fits)]
    sums = found.groupBy("key").agg(*parts)
    for k in range(len(prefixes)):
        sums = sums.filter(F.col(f"h{k}") > 0)
    total = F.lit(0)
    for k in range(len(prefixes)):
        total = total + F.col(f"h{k}")
    return sums.select("key", total.cast("long").alias("hits"))


def search_ranked(index: Index, words: str, top: int, stemmed: bool = False, digits: int = 6) -> DataFrame:
    """``key, score, rank``: the ``top`` texts by BM25 over the query's words (or stems), ties by key.

    Document frequencies come from the postings that the search reads; the inverse frequency is that of the Lucene family,
    ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    by = "stem" if stemmed else "term"
    asked: Sequence[str] = list(dict.fromkeys(porter(w) for w in query_words(words))) if stemmed else query_words(words)
    found = index.postings(by).filter(F.col(by).isin(*asked)).groupBy(by, "key").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    df = found.groupBy(by).agg(F.count("*").alias("df"))  # a row a query word
    idf = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(index.totals())).select(by, idf.alias("idf"), (F.col("terms") / F.col("texts")).alias("mean"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.join(F.broadcast(weights), by).groupBy("key").agg(F.round(F.sum(F.col("idf") * tf), digits).alias("score"))
    best = scored.orderBy(F.desc("score"), "key").limit(top)  # the top rows only leave a task
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "key")).cast("long"))
