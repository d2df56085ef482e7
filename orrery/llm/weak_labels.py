"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on every document.  Documents
collapse into patterns of votes (at most three to the number of labellers, a
table of bounded size), and expectation-maximisation on the pattern counts
estimates how often documents are good and how often each labeller votes each
way on good and on bad ones.  The posterior of its pattern labels a document.
Posterior labels of at most about ``MAX_ROWS`` documents, drawn by a hash of id
and text and each used once, train a linear scorer on hashed words and shape
tokens, which then scores every whole text.  Human labels are never read.

Defined results: null and empty texts get votes like any other and usually
fail; with fewer than two kinds of pattern the posterior is the prior; repeated
rows score alike; a null id takes part; very long texts are read whole; extra
columns pass through, but for those with the names of added columns, which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.linear import fit_logistic, sigmoid
from orrery.llm.textstats import basic_counts
from orrery.workers import per_worker
from orrery.storage import stage

MAX_ROWS = 8_000
BITS = 16
ROUNDS = 100
KEEP_AT = 0.5
_SHAPES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points below 0xFFFF are letters, and which are capitals."""
    chars = [chr(c) for c in range(0x10000)]
    return np.array([c.isalpha() for c in chars]), np.array([c.isupper() for c in chars])


def votes(text: str | None) -> list[int]:
    """+1 good, -1 bad, 0 none, by each labeller."""
    text = text or ""
    n, chars, symbols, dup_lines, repeats = basic_counts(text)
    if not n:
        return [-1, -1, 0, 0, 0, 0, 0, 0]
    lines = text.count("\n") + 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.minimum(codes, 0xFFFF)
    letters, upper = (int(np.count_nonzero(t[codes])) for t in per_worker("letter tables", _letter_tables))
    stops = text.count(".") + text.count("?") + text.count("!")
    bangs = text.count("!!") + text.count("??")

    def vote(value: float, good: float, bad: float) -> int:
        """Good on one side of ``good``, bad on the other side of ``bad``, none between."""
        if good < bad:
            return 1 if value <= good else -1 if value >= bad else 0
        return 1 if value >= good else -1 if value <= bad else 0

    return [
        vote(n, 30, 5),
        vote(letters / max(1, chars), 0.9, 0.75),
        vote(repeats / n, 0.05, 0.3),
        vote(dup_lines / lines, 0.05, 0.3),
        vote(symbols / n, 0.02, 0.15),
        vote(upper / max(1, letters), 0.1, 0.4),
        vote(bangs / n, 0.01, 0.1),
        vote(n / (stops + 1), 40, 120) if n >= 20 else 0,
    ]


LABELLERS = len(votes(""))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, vote rates (class, labeller, vote + 1), and the share of good documents.

    Starts from what any one bad vote says, so that labellers of different faults need not agree; votes are
    taken as independent given the class.
    """
    post = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        rates = (np.einsum("cp,plv->clv", weight, onehot) + 0.5) / (weight.sum(axis=1)[:, None, None] + 1.5)
        share = float((weight[1].sum() + 1) / (counts.sum() + 2))
        logs = np.einsum("plv,clv->pc", onehot, np.log(rates)) + np.log([1 - share, share])
        post = sigmoid(logs[:, 1] - logs[:, 0])
    return post, rates, share


class _Places(dict):
    """Hashed columns of a token and of its shape."""

    def __missing__(self, w: str) -> tuple[int, int]:
        shape = "A" if w.isupper() else "a" if w.islower() else "Aa" if w.isalpha() else "9" if w[0].isdigit() else "." + w[:3]
        if len(self) > 500_000:
            self.clear()
        self[w] = found = tuple(
            zlib.crc32(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in (w.lower(), "\t" + shape)
        )
        return found


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a unit vector over hashed words and word shapes, with damped counts."""
    places = per_worker("hashed tokens", _Places)
    found: Counter[int] = Counter()
    for w, c in Counter(_SHAPES.findall(text or "")).items():
        for k in places[w]:
            found[k] += c
    at = np.fromiter(found, np.int64, len(found))
    value = 1 + np.log(np.fromiter(found.values(), float, len(found)))
    return at, value / max(1e-12, float(np.sqrt(value @ value)))


def judge_weakly(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """All rows with ``votes`` (text, a sign a labeller), ``posterior``, ``score`` and ``kept``."""
    added = ("votes", "posterior", "score", "kept")
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col)])

    def cast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = ["".join("-0+"[v + 1] for v in votes(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.string())], ["votes"])

    every = F.xxhash64(F.col(id_col), F.col(text_col))
    voted = docs.select(F.col(text_col).alias("text")).mapInArrow(cast, "votes string")
    table = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas()  # 3 ** LABELLERS rows at most
    posterior: dict[str, float] = {}
    weights, bias = np.zeros(1 << BITS), -40.0
    if len(table):
        patterns = np.array([["-0+".index(c) - 1 for c in v] for v in table["votes"]])
        post, _, _ = estimate(patterns, table["n"].to_numpy(float))
        posterior = {v: float(p) for v, p in zip(table["votes"], post, strict=True)}
        step = max(1, -(-int(table["n"].sum()) // max_rows))

        def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for b in batches:
                b = b.drop_duplicates("pick")
                b = b[~b["pick"].isin(seen)]
                seen.update(b["pick"])
                rows = [hashed_features(t) for t in b["text"]]
                label = [posterior["".join("-0+"[v + 1] for v in votes(t))] for t in b["text"]]
                yield pd.DataFrame({"pick": b["pick"].to_numpy(), "y": label, "at": [r[0] for r in rows], "value": [r[1] for r in rows]})

        picked = docs.filter(F.pmod(every, F.lit(step)) == 0).select(F.col(text_col).alias("text"), every.alias("pick"))
        encoded = picked.mapInPandas(encode, "pick long, y double, at array<int>, value array<float>")
        sample = encoded.dropDuplicates(["pick"]).orderBy("pick").toPandas()  # about max_rows rows
        cols = np.concatenate([np.asarray(x, np.int64) for x in sample["at"]] or [np.zeros(0, np.int64)])
        values = np.concatenate([np.asarray(x, float) for x in sample["value"]] or [np.zeros(0)])
        rows = np.repeat(np.arange(len(sample)), sample["at"].map(len).to_numpy(int))
        weights, bias = fit_logistic(rows, cols, values, sample["y"].to_numpy(float), 1 << BITS, 0.0, 1e-5)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs, scores = [], []
            for t in b.column(text_col).to_pylist():
                signs.append("".join("-0+"[v + 1] for v in votes(t)))
                at, value = hashed_features(t)
                scores.append(float(weights[at] @ value) + bias)
            prob = sigmoid(np.array(scores, float))
            more = [pa.array(signs, pa.string()), pa.array([posterior[s] for s in signs], pa.float64()), pa.array(prob), pa.array(prob >= KEEP_AT)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(added, kinds, strict=True)]])
    return docs.mapInArrow(score, schema)


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: votes, posterior, score and verdict; nulls, empties, ties and repeats as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_weakly(docs).select("doc_id", "votes", "posterior", "score", "kept")
