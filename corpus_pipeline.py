"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Toxicity drops documents that the classifier rejects; SimHash keeps one
document of each group of near copies; secret scans replace what they find in
the texts; mixing repeats or drops documents to meet the sources' targets; the
last stage packs what is left into sequences and returns a row a piece.

In every stage a null text counts as an empty one (and stays null where it is
kept), rows with a null in another column are rows like any others, repeated
rows are judged alike, texts of any length are read whole, columns beside those
of ``documents`` are dropped, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.mixing import mix_sources
from orrery.llm.packing import pack_documents
from orrery.llm.secrets import redacted, scan_secrets
from orrery.llm.simhash import keep_one
from orrery.llm.toxicity import score_texts, train
from orrery.storage import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_AT = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``REJECT_AT``; the model is trained on the labelled ones among them.

    Empty texts score as texts without a known feature; without labels of both kinds all stay.
    """
    weights, bias = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs.select(*COLUMNS), "text", weights, bias).filter(F.col("score") < REJECT_AT).select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, of equal ids any one.

    Empty texts are copies of each other; rows of one id with different texts are different documents.
    """
    return keep_one(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; other texts stay as they are."""
    found = scan_secrets(docs.select(*COLUMNS))
    text = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are never taken."""
    mixed = mix_sources(docs.select(*COLUMNS)).filter(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences; an empty text is a piece of its end id."""
    return pack_documents(docs.select(*COLUMNS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("simhash", simhash), ("secrets", secrets), ("mixing", mixing), ("packing", packing)
]

#: Fitted models, components of a near-duplicate graph and tokenisers have no SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
