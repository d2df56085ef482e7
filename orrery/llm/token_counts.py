"""Token counts of whole texts; huge ones as overlapping chunks that are spliced where both encodings provably agree.

A text of at most ``CHUNK`` characters is one chunk and is counted where it
lies.  A longer one is cut into chunks that overlap the next one by ``OVERLAP``
characters; chunks are dealt over all tasks, so a huge document is not one
task's work, and each is encoded with the offsets of its tokens.  A seam is
spliced at the first position of the overlap that is

* proven: no token of the vocabulary can cross it whatever lies on its sides
  (``stable_positions`` says why), so what is left of it does not depend on what
  is right of it, and
* common: in both encodings no token crosses it.

Texts with a seam that has no such position are cut anew with overlaps and
chunks ``WIDEN`` times as long, until a chunk holds the whole text.  What a chunk
sends to the splice is a count and the few positions of its overlaps.

Counts are those of the library's plain call without added special tokens: the
string of a special token in a text is that token where the library does so.

Defined results: null and empty texts have no bytes and no tokens; very long
texts are read whole; a text without any proven position is encoded in one
piece; repeated rows (and equal ids) are counted each; a null id stays; extra
columns do not matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm.tokens import SPACE, WordEncoder, encoder
from orrery.storage import stage
from orrery.workers import per_worker

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK, OVERLAP, WIDEN = 1 << 15, 512, 16
BEFORE_SPACE = f"(?<=[^{SPACE}])(?= )"
#: Byte-level splitters have no piece of text that goes on from a visible character to white space, or between an ASCII
#: letter and an ASCII digit.
BYTE_LEVEL = f"(?<=[^{SPACE}])(?=[ \\t-\\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


class Counter:
    """Counts and token spans under one public tokenizer: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, path: str):
        self.words: WordEncoder | None = None
        if path.endswith(".model"):
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pattern, names = BEFORE_SPACE, [self.model.id_to_piece(i).replace("▁", " ") for i in range(self.model.vocab_size())]
        else:
            self.model = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as file:
                kind = json.load(file)
            byte_level = (kind["pre_tokenizer"] or {}).get("type") == "ByteLevel" and kind["normalizer"] is None
            self.words = encoder(path, spaced=byte_level)
            pattern, names = BYTE_LEVEL if byte_level else BEFORE_SPACE, [t["content"] for t in kind["added_tokens"]]
            if any(t["lstrip"] or t["rstrip"] for t in kind["added_tokens"]):
                raise ValueError("added tokens that take white space in leave no position proven")
        self.stable = re.compile(pattern)
        if any(self.stable.search(name) for name in names):
            raise ValueError("a token crosses the positions that are held for stable")

    def count(self, texts: pa.Array) -> np.ndarray:
        if self.words is None:
            return np.array([len(self.model.encode(t or "")) for t in texts.to_pylist()], np.int64)
        found = np.zeros(len(texts), np.int64)
        for at, _, size in self.words.encode_parts(texts):
            found[at : at + len(size)] = size
        return found

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last."""
        if self.words is None:
            offsets = self.model.encode(text, return_type="offset_mapping")["offsets"]
        else:
            offsets = self.model.encode(text, add_special_tokens=False).offsets
        both = np.array(offsets, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def stable_positions(self, text: str, start: int, end: int) -> list[int]:
        """Places after ``start`` and before ``end`` that no token crosses.

        The splitter never joins the two characters around such a place, merges stay inside what it cuts, and no token
        that is found in the text before it is split holds such a place (checked when the tokenizer is loaded).
        """
        return [m.start() for m in self.stable.finditer(text, start + 1, end)]


def counter(path: str | None) -> Counter:
    path = path or public_tokenizers.path(TOKENIZER)  # where the executor has it
    return per_worker(f"counter {path}", lambda: Counter(path))


def cut_chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of the chunks; each but the last goes on for ``overlap`` characters into the next."""
    starts = range(0, max(1, len(text) - overlap), chunk)
    ends = [s + chunk + overlap for s in starts[:-1]] + [len(text)]
    return [(s, text[s:e]) for s, e in zip(starts, ends, strict=True)]


def seam_counts(own: Counter, text: str, spans: tuple[np.ndarray, np.ndarray], start: int, at: int, overlap: int) -> bytes:
    """Of the overlap from ``at`` on: pairs of a stable place in the whole text and how many tokens of ``text`` lie before it."""
    places = np.array(own.stable_positions(text, at, min(at + overlap, len(text))), np.int64)
    before = np.searchsorted(spans[0], places, "left")
    whole = (before == 0) | (np.concatenate([[0], np.maximum.accumulate(spans[1])])[before] <= places)
    return np.stack([places + start, before], axis=1)[whole].astype("<i8").tobytes()


def spliced(chunks: list[tuple[int, bytes, bytes]]) -> int | None:
    """Tokens of a text from (tokens, head, tail) of its chunks in order; None if a seam has no common place."""
    total, skipped = 0, 0
    for (tokens, _, tail), (_, head, _) in pairwise(chunks):
        left, right = (dict(np.frombuffer(x, "<i8").reshape(-1, 2).tolist()) for x in (tail, head))
        common = min(left.keys() & right.keys(), default=None)
        if common is None:
            return None
        total += left[common] - skipped
        skipped = right[common]
    return total + chunks[-1][0] - skipped


def _spliced_counts(huge: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """``(key, n_tokens)`` of texts cut into chunks; null where a seam has no common place."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                parts = cut_chunks(text.as_py(), chunk, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    columns = [[key] * len(some), range(at, at + len(some)), [s for s, _ in some], [t for _, t in some], [len(parts)] * len(some)]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "chunk", "start", "text", "many"])

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                spans = own.spans(r.text)
                head = seam_counts(own, r.text, spans, r.start, 0, overlap) if r.chunk else b""
                tail = seam_counts(own, r.text, spans, r.start, chunk, overlap) if r.chunk < r.many - 1 else b""
                rows.append((r.key, r.chunk, len(spans[0]), head, tail))
            yield pd.DataFrame(rows, columns=["key", "chunk", "n", "head", "tail"])

    def splice(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        n = spliced(list(zip(part["n"], part["head"], part["tail"], strict=True)))
        return pd.DataFrame({"key": [part["key"].iloc[0]], "n_tokens": pd.array([n], "Int64")})

    chunks = huge.select("key", "text").mapInArrow(cut, "key long, chunk int, start long, text string, many int")
    found = chunks.repartition("key", "chunk").mapInPandas(encode, "key long, chunk int, n long, head binary, tail binary")
    return found.groupBy("key").applyInPandas(splice, "key long, n_tokens long")


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """A row a document: its id, ``n_bytes, n_tokens, over_limit``."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap has to be at most as long as a chunk")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            texts = b.column("text")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), n_bytes, pa.array(own.count(texts))], ["id", "n_bytes", "n_tokens"])

    one = F.length("text") <= chunk
    counts = rows.filter(one).mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")
    huge = stage(rows.filter(~one).select(F.monotonically_increasing_id().alias("key"), "id", F.octet_length("text").cast("long").alias("n_bytes"), "text"), "huge")
    while not huge.isEmpty():
        found = stage(_spliced_counts(huge, path, chunk, overlap), "spliced")
        done = found.filter("n_tokens is not null")
        counts = counts.unionByName(huge.select("key", "id", "n_bytes").join(done, "key").drop("key"))
        huge = huge.join(found.filter("n_tokens is null"), "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` counted whole.

    Null and empty texts: no bytes, no tokens; very long ones are chunks, spliced; ties play no part; repeated rows are
    counted each; further columns are not read; an empty table gives no rows.
    """
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
