"""Quality rules by tokenizer fertility, beside plain counts.

A public vocabulary tells ordinary text from noise: words that it knows give
long pieces, noise falls apart into short pieces or bytes and uses pieces
unevenly.  Each whole text gets its characters a token, its share of
byte-fallback tokens, and the entropy of its tokens as a share of what that many
tokens could have.  All three move with the language, and the entropy also with
the length of a text, so rejection bands come from the documents of one language
and one length class (half a power of two of tokens) that pass the plain rules:
``REACH`` times the distance between median and quartile beyond the median.  A
class of fewer than ``MIN_BAND`` documents takes the band of its whole language.
Quantiles come from mergeable sketches, so a third of all rows in one language
is no larger group than any other.

Defined results: null and empty texts have no words and fail; a null language
is a language of its own; documents that all agree have a band of some least
width; very long texts are measured whole; repeated rows are judged alike; extra
columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.textstats import basic_counts
from orrery.llm.tokens import piece_encoder
from orrery.storage import stage

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_BAND = 40
#: By measure: quartile distances that the band reaches below and above the median, and its least half width.
REACH = {"chars_per_token": (6.0, 6.0, 0.05), "byte_share": (None, 6.0, 0.02), "evenness": (5.0, 5.0, 0.02)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fertility(ids: np.ndarray, is_byte: np.ndarray, chars: int) -> tuple[float, float, float]:
    """Characters a token, share of byte-fallback tokens, entropy over its most."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    ordered = np.sort(ids)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    share = np.diff(edges) / len(ids)
    entropy = float(-(share * np.log2(share)).sum())
    return chars / len(ids), float(is_byte[ids].mean()), entropy / max(1.0, float(np.log2(len(ids))))


def with_measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, path: str | None) -> DataFrame:
    names = ["id", "lang", *COUNTS, "n_tokens", *REACH]
    kinds = [pa.int64()] * (len(COUNTS) + 1) + [pa.float64()] * len(REACH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_encoder(path or public_tokenizers.path(VOCABULARY))  # where the executor has it
        for b in batches:
            for at, ids, sizes in words.encode_parts(b.column("text")):
                own, rows, start = b.slice(at, len(sizes)), [], 0
                for text, n in zip(own.column("text"), sizes.tolist(), strict=True):
                    counts = basic_counts(text.as_py())
                    rows.append((*counts, n, *fertility(ids[start : start + n], words.is_byte, counts[1])))
                    start += n
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("lang"), *found], names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang string, " + ", ".join(
        [f"{c} long" for c in (*COUNTS, "n_tokens")] + [f"{m} double" for m in REACH]
    )
    narrow = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def length_class() -> Column:
    return F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def _limits(measured: DataFrame, *keys: str) -> DataFrame:
    marks = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in REACH]
    quartiles = measured.filter(~F.col("base_failed")).groupBy(*keys).agg(F.count("*").alias("n"), *marks)
    sides = []
    for m, (below, above, least) in REACH.items():
        q1, mid, q3 = (F.col(m)[k] for k in range(3))
        low = mid - F.greatest((mid - q1) * below, F.lit(least)) if below else F.lit(None).cast("double")
        high = mid + F.greatest((q3 - mid) * above, F.lit(least)) if above else F.lit(None).cast("double")
        sides.append(F.struct(low.alias("low"), high.alias("high")).alias(m))
    return quartiles.select(*[F.col(k).alias(f"__{k}") for k in keys], F.when(F.col("n") >= (MIN_BAND if len(keys) > 1 else 0), F.struct(*sides)).alias(f"__{keys[-1]}_band"))


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None
) -> DataFrame:
    """A row a document: id, counts, measures, ``base_failed, kept`` and ``failed``: the measures outside their bands."""
    measured = with_measures(docs, id_col, text_col, lang_col, path).withColumn("base_failed", base_failed())
    measured = stage(measured.withColumn("class", length_class()), "measures")
    whole, fine = stage(_limits(measured, "lang"), "bands"), stage(_limits(measured, "lang", "class"), "bands")
    joined = measured.join(fine, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("class") == F.col("__class")), "left").drop("__lang")
    joined = joined.join(whole, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    band = F.coalesce("__class_band", "__lang_band")
    out = [F.when((F.col(m) < band[m]["low"]) | (F.col(m) > band[m]["high"]), F.lit(m)) for m in REACH]
    return joined.withColumn("failed", F.array_join(F.array_compact(F.array(*out)), ",")).select(
        F.col("id").alias(id_col), *COUNTS, "n_tokens", *REACH, "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed"
    )


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: base counts and verdicts; nulls, empties, ties and repeats as the module says."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
