"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a text and their beginnings of four to eight
characters, each present or absent, so that neither length nor repetition moves
a score.  Of the labelled rows at most about ``MAX_ROWS`` are used, drawn by a
hash of their id.  Their features are counted by label on the executors, the
``WIDTH`` that differ most between labels are kept, and a sparse logistic model is
fitted to them.

Counterfactuals come from the labelled sentences.  Where one names a group of
people, the name is swapped for another of its kind.  Where a text names none,
its first sentence is taken with a name put in, with the next name of that kind
in its place, and without it.  The model pays for every change of score between
the sides of such a pair.  So a name carries no weight of its own, neither by
itself nor by a beginning that it shares with an insult (``moroccans`` and
``moron``), and a neutral mention of a group stays neutral.

Scores cover every whole text.  Defined results: null and empty texts score as
a text without any known feature; without labelled rows of both kinds all
scores are 0; repeated rows score alike; of labelled rows with one id the least
text is used; rows with a null id are held out and scored; very long texts are
scored whole; extra columns pass through, but for one named as the score, which
is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.linear import fit_logistic, sigmoid
from orrery.storage import stage

MAX_ROWS = 20_000
WIDTH = 4096
MIN_ROWS = 3
REFIT = 3e-4
L1, PAIR_WEIGHT = 0.05, 1.0  # L1 in units of sqrt(log(width) / rows)
#: Names of groups by kind; a name is swapped for the next of its kind.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "foreigners", "locals"),
    ("immigrant", "refugee", "citizen", "foreigner", "local"),
    ("moroccans", "germans", "pathans", "turks", "poles", "americans", "nigerians", "chinese"),
    ("moroccan", "german", "pathan", "turk", "pole", "american", "nigerian", "indian"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "extranjeros", "refugiados"),
)
_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"[^.!?\n]+")


def swaps() -> dict[str, str]:
    return {name: group[(k + 1) % len(group)] for group in GROUPS for k, name in enumerate(group)}


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Words, and their beginnings with a mark."""
    found = set(words)
    found.update([w[:k] + "~" for w in words for k in range(4, min(8, len(w) - 1) + 1)])
    return found


def counterfactuals(text: str | None) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets whose scores should be equal: sentences with swapped names, or with a name put in."""
    other, found = swaps(), []
    sentences = [s for s in _SENTENCES.findall((text or "").lower()) if s.strip()]
    for sentence in sentences:
        words = set(_WORDS.findall(sentence))
        if named := words & other.keys():
            found.append((words, (words - named) | {other[w] for w in named}))
    if not found and sentences:
        words, names = set(_WORDS.findall(sentences[0])), sorted(other)
        name = names[zlib.crc32(sentences[0].encode("utf-8", "surrogatepass")) % len(names)]
        found = [(words | {name}, words | {other[name]}), (words | {name}, words)]
    return found


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``(text, y)`` of at most about ``max_rows`` labelled documents outside the held-out fold."""
    usable = (
        labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("int").alias("y"))
    )
    every = max(1, -(-usable.count() // max_rows))
    sample = usable.filter(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0)
    # the sample is bounded by max_rows, so it may be sent to every task
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("__id"))
    return found.groupBy("__id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def feature_counts(sample: DataFrame) -> DataFrame:
    """``(feature, ones, rows)``: summed in each task, then over tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ones = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                found = features_of(words_of(text))
                rows.update(found)
                if y:
                    ones.update(found)
        for names in itertools.batched(rows, 1 << 16):
            counts = [pa.array([c[f] for f in names], pa.int64()) for c in (ones, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["feature", "ones", "rows"])

    counted = sample.mapInArrow(run, "feature string, ones long, rows long")
    return counted.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("rows").alias("rows"))


def fit(sample: DataFrame, width: int = WIDTH, l1: float = L1, pair_weight: float = PAIR_WEIGHT) -> tuple[dict[str, float], float]:
    """Weights by feature, and bias."""
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    n, ones = total["n"], total["ones"] or 0
    if not 0 < ones < n:
        return {}, -40.0
    rate = F.col("ones") / ones - (F.col("rows") - F.col("ones")) / (n - ones)
    share = F.col("rows") / n
    differs = F.abs(rate) / F.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)) + 1e-9)
    top = (
        feature_counts(sample).filter(F.col("rows") >= MIN_ROWS).select("feature", differs.alias("differs"))
        .orderBy(F.desc("differs"), "feature").limit(width)
    )
    names = [r["feature"] for r in top.collect()]
    names += sorted(features_of(swaps()) - set(names))
    place = {f: k for k, f in enumerate(names)}

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, before, after = [], [], []
            for text in b["text"]:
                own.append([place[f] for f in features_of(words_of(text)) if f in place])
                pairs = [(features_of(a), features_of(c)) for a, c in counterfactuals(text)]
                before.append([[place[f] for f in a - c if f in place] for a, c in pairs])
                after.append([[place[f] for f in c - a if f in place] for a, c in pairs])
            yield pd.DataFrame({"y": b["y"], "own": own, "before": before, "after": after})

    kinds = "y int, own array<int>, before array<array<int>>, after array<array<int>>"
    rows = sample.mapInPandas(encode, kinds).toPandas()  # max_rows rows of at most `width` features
    cols = np.concatenate([np.asarray(x, np.int64) for x in rows["own"]])
    at = np.repeat(np.arange(len(rows)), rows["own"].map(len))
    sides = [(sign, k, c) for k, (was, now) in enumerate(
        p for a, c in zip(rows["before"], rows["after"], strict=True) for p in zip(a, c, strict=True)
    ) for sign, side in ((1.0, was), (-1.0, now)) for c in side]
    pairs = None
    if sides:
        sign, which, col = zip(*sides, strict=True)
        pairs = (np.array(which), np.array(col), np.array(sign))
    target, step = rows["y"].to_numpy(float), l1 * float(np.sqrt(np.log(len(names)) / n))
    unit = np.ones(len(cols))
    weights, _ = fit_logistic(at, cols, unit, target, len(names), step, 1e-5, pairs, pair_weight)
    # the penalty that chooses features also shrinks them: fit those chosen once more without it
    kept = weights[cols] != 0
    weights, bias = fit_logistic(at[kept], cols[kept], unit[kept], target, len(names), 0.0, REFIT, pairs, pair_weight)
    return {f: float(weights[k]) for f, k in place.items() if weights[k]}, bias


class Scorer:
    """Scores texts; keeps what it found out about each word."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        if len(self.seen) > 300_000:
            self.seen.clear()
        found: set[str] = set()
        seen = self.seen
        for w in words_of(text):
            hits = seen.get(w)
            if hits is None:
                hits = seen[w] = tuple(f for f in features_of([w]) if f in self.weights)
            if hits:
                found.update(hits)
        return self.bias + sum(self.weights[f] for f in sorted(found))


def score_texts(docs: DataFrame, text_col: str, weights: dict[str, float], bias: float, out: str = "score") -> DataFrame:
    """All rows with ``out``: probability of the label. A column of that name is replaced."""
    docs = docs.drop(*({out} - {text_col}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for b in batches:
            scores = sigmoid(np.array([scorer.score(t) for t in b.column(text_col).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> tuple[dict[str, float], float]:
    sample = stage(labelled_sample(docs, labels, id_col, text_col, label_col, max_rows), "labelled")
    return fit(sample)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, scored by a model of the other four folds' labels; nulls, empties and repeats as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights, bias = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, "text", weights, bias)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
