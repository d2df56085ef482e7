"""Token ids written as independently coded blocks, and read back.

Documents are ordered by id over range partitions and tokenised there; each
task cuts its documents into blocks of about ``BLOCK_IDS`` ids, whole documents
only, and codes each block on its own (see idcodec).  Blocks lie as rows of a
written table: ``part`` and ``block`` give the order, ``payload`` is the block.
Reading decodes each block where it lies; a block's place among all ids follows
from the sums of the ``n_ids`` column, which is read without the payloads.

Defined results: null and empty texts have only the end id; a null id sorts
first and is read back as null; repeated rows are written each; extra columns
do not matter; an empty table gives no blocks; a damaged block is an error.
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

from orrery.llm.idcodec import BLOCK_IDS, pack_block, unpack_block
from orrery.llm.tokens import encoder
from orrery.storage import table_path

TOKENIZER = "word_bpe_49k.json"
VOCAB = 49_408
END_ID = 1
BLOCKS = "part int, block int, n_docs int, n_ids long, payload binary"
SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def write_ids(
    docs: DataFrame,
    where: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    vocab: int = VOCAB,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write all documents' ids to the folder ``where`` in ascending order of ``id_col``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path or public_tokenizers.path(TOKENIZER), spaced=False)  # where the executor has it
        part, block = TaskContext.get().partitionId(), 0
        names, lengths, ids = [], np.zeros(0, np.int64), np.zeros(0, np.int32)

        def flush(docs: int) -> pa.RecordBatch:
            """The first ``docs`` waiting documents as a block."""
            nonlocal names, lengths, ids, block
            n = int(lengths[:docs].sum())
            payload = pack_block(names[:docs], lengths[:docs], ids[:n], vocab)
            row = [[part], [block], [docs], [n], [payload]]
            names, lengths, ids, block = names[docs:], lengths[docs:], ids[n:], block + 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)

        for b in batches:
            for at, more, size in words.encode_parts(b.column("text"), end_id):
                names = names + b.column("id").slice(at, len(size)).to_pylist()
                lengths, ids = np.concatenate([lengths, size]), np.concatenate([ids, more])
                while len(ids) >= block_ids:
                    yield flush(int(np.searchsorted(np.cumsum(lengths), block_ids)) + 1)
        if names:
            yield flush(len(names))

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id")
    )
    ordered.mapInArrow(run, BLOCKS).write.parquet(where)


def read_ids(spark: SparkSession, where: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document in the folder."""
    blocks = spark.read.schema(BLOCKS).parquet(where)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, block, payload in zip(b["part"], b["block"], b["payload"], strict=True):
                names, lengths, tokens = unpack_block(bytes(payload))
                raw = tokens.astype("<u4")
                ends = np.cumsum(lengths)
                cuts = [raw[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame(
                    {
                        "part": np.int32(part),
                        "block": np.int32(block),
                        "doc_id": pd.array(names, "Int64"),
                        "inside": ends - lengths,
                        "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(c.tobytes()) for c in cuts],
                        "ids": [c.astype(np.int64) for c in cuts] if with_ids else None,
                    }
                )

    kinds = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<long>"
    found = blocks.select("part", "block", "payload").mapInPandas(run, kinds)
    sizes = blocks.select("part", "block", "n_ids")
    inner = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a file
    outer = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("within")).join(parts, "part")
    starts = starts.select("part", "block", (F.col("before") + F.col("within")).alias("base"))
    columns = ["doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return found.join(starts, ["part", "block"]).select(*columns)


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, written as blocks of ids and read back; nulls, empties, ties and repeats as the module says."""
    where = table_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), where)
    return read_ids(spark, where)
