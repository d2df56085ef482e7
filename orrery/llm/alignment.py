"""Tokens of two public tokenizers aligned by bytes, each distinct text once.

Texts are shuffled by their whole text, and copies are counted before they
leave their task; each distinct text is tokenised by both tokenizers and aligned
once.  Both cut every text before a space, tab or line end that follows a visible
character (checked against the second one's vocabulary when it is loaded), so a
text is a row of segments, tokens of both end where a segment ends, and a
segment is aligned once a worker.

A *block* is a row of about ``BLOCK`` bytes of distinct texts: the segments of
each, and the id pairs that the block's segments link with their counts, in which
a text counts as often as it has copies.  Pair counts are sums over blocks; a
block asks for each of its pairs once, whatever its texts repeat, and its texts'
measures are sums over their segments.  Measures join the documents by the
SHA-256 of their text.

Defined results: null and empty texts, and those whose tokens do not give the
bytes of the text with a space before it back (U+2581 reads as a space), have no
tokens: zeros and an empty ``groups_sha256``.  Special tokens' strings are plain
text.  Ties for the highest count are all best; repeated rows get a row and a
count each; very long texts and segments are read whole; null ids stay; extra
columns do not matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm.tokens import LETTERS, MARKS, SPACE, WordEncoder
from orrery.storage import stage
from orrery.workers import per_worker

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK = 1 << 22
#: Segments a worker keeps, and the longest one kept.
KEEP, KEEP_CHARS = 400_000, 64
#: A pair of ids as one number.
SHIFT = 20
OTHER_SPACE = SPACE.replace("\\t-\\r ", "\\x0b-\\r")  # white space before which no text is cut
SEGMENTS = f"[{SPACE}]*[^{SPACE}]+(?:[{OTHER_SPACE}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+"
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

_TEXT = pa.struct([("digest", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("sha", pa.string()), ("segments", pa.int64())])
_BLOCK = pa.schema(
    [("block", pa.int64()), ("texts", pa.list_(_TEXT)), ("codes", pa.binary()), ("sizes", pa.binary()), ("linked", pa.binary()),
     ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))]
)
BLOCKS = (
    "block long, texts array<struct<digest: binary, n_a: long, n_b: long, n_groups: long, sha: string, segments: long>>, "
    "codes binary, sizes binary, linked binary, pairs array<long>, weights array<long>"
)
MEASURED = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Segments of texts and what both tokenizers make of each."""

    def __init__(self, first: str, second: str):
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        names = {c: b for b, c in WordEncoder._byte_names().items()}
        self.a_bytes = {i: bytes(names[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if names.keys() >= set(t)}
        self.b_bytes = [self._bytes_of(i) for i in range(self.b.vocab_size())]
        if any(re.search(rb"[^\s][ \t\n]", p) for p in self.b_bytes):
            raise ValueError("pieces of the second tokenizer go on past a white space")
        self.head = self.b.encode("x")
        self.cut = re.compile(SEGMENTS).findall
        self.plain = re.compile(f"( ?[{LETTERS}]+)([{MARKS}]*)").fullmatch
        self.names = {b: c for c, b in names.items()}
        self.marks: dict[str, list[int]] = {}
        self._reset()

    def _bytes_of(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the bytes differ
        self.n: list[tuple[int, int, int]] = []
        self.pairs: list[tuple[int, ...]] = []

    def _first_ids(self, segment: str) -> list[int]:
        """Ids of the byte-level tokenizer; it cuts letters and the marks after them apart, and so does this."""
        found = self.plain(segment)
        if found is None:
            return self.a.encode(segment, add_special_tokens=False).ids
        core, mark = found.groups()
        if not core.isascii():
            core = core.encode().decode("latin-1")
        ids = [t.id for t in self.a.model.tokenize(core.translate(self.names))]
        if mark:
            if mark not in self.marks:
                self.marks[mark] = self.a.encode(mark, add_special_tokens=False).ids
            ids += self.marks[mark]
        return ids

    def align(self, segment: str, a: list[int], b: list[int]) -> tuple[str | None, tuple[int, int, int], tuple[int, ...]]:
        """Groups as text, how many tokens of both and groups, and the linked pairs (last tokens of each group)."""
        raw = segment.encode()
        left, right = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(left) != raw or b"".join(right) != raw:
            return None, (0, 0, 0), ()
        groups, pairs, i, j, p, q, ahead = [], [], 0, 0, 0, 0, 0  # ahead: bytes by which the first tokens lead
        while p < len(a) or q < len(b):
            if ahead <= 0:
                ahead += len(left[p])
                p += 1
            else:
                ahead -= len(right[q])
                q += 1
            if not ahead:
                groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
                pairs.append((a[p - 1] << SHIFT) + b[q - 1])
                i, j = p, q
        return ";".join(groups), (len(a), len(b), len(groups)), tuple(pairs)

    def places(self, text: str) -> list[int]:
        """The entries of a text's segments, the text with a space before it; new ones are tokenised together."""
        segments = self.cut(" " + text)
        fresh = list(dict.fromkeys(s for s in segments if s not in self.index))
        if fresh:
            known, ids = {}, self.b.encode(["x" + s for s in fresh], num_threads=1)  # after a letter no blank is put before it
            for s, b in zip(fresh, ids, strict=True):
                (self.index if len(s) <= KEEP_CHARS else known)[s] = len(self.groups)
                for kept, new in zip((self.groups, self.n, self.pairs), self.align(s, self._first_ids(s), b[len(self.head) :]), strict=True):
                    kept.append(new)
            if known:
                return [self.index[s] if s in self.index else known[s] for s in segments]
        return list(map(self.index.__getitem__, segments))


def aligner(first: str | None, second: str | None) -> Aligner:
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)  # where the executor has them
    return per_worker(f"aligner {first} {second}", lambda: Aligner(first, second))


def _block(own: Aligner, block: int, texts: list[tuple], places: list[np.ndarray]) -> pa.RecordBatch:
    """A block's row: its texts, and its own dictionary of segments and of pairs."""
    used, codes = np.unique(np.concatenate(places), return_inverse=True)
    linked = [own.pairs[k] for k in used.tolist()]
    sizes = np.fromiter(map(len, linked), np.int32, len(linked))
    pairs, at = np.unique(np.fromiter(chain.from_iterable(linked), np.int64, int(sizes.sum())), return_inverse=True)
    copies = np.repeat([t[-1] for t in texts], [len(p) for p in places]).astype(np.int64)
    n = np.array([own.n[k] for k in used.tolist()], np.int64)[codes]  # tokens of both and groups, of every segment
    n = np.add.reduceat(n, np.cumsum([0, *map(len, places[:-1])]), axis=0).tolist()  # a text has a segment or more
    often = np.bincount(codes, copies, len(used)).astype(np.int64)  # exact: sums far below 2 ** 53
    weights = np.bincount(at, np.repeat(often, sizes), len(pairs)).astype(np.int64)
    rows = [dict(zip(_TEXT.names, (digest, *own_n, sha, len(p)), strict=True)) for (digest, sha, _), own_n, p in zip(texts, n, places, strict=True)]
    packed = [codes.astype("<i4").tobytes(), sizes.astype("<i4").tobytes(), at.astype("<i4").tobytes()]
    values = [block, rows, *packed, pairs, weights]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def aligned_blocks(distinct: DataFrame, first: str | None, second: str | None, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of rows ``(text, digest, copies)``; texts without tokens are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(first, second), TaskContext.get().partitionId() << 32
        texts, places, held = [], [], 0
        for b in batches:
            for text, digest, copies in zip(b.column("text"), b.column("digest").to_pylist(), b.column("copies").to_pylist(), strict=True):
                text = text.as_py()
                at = own.places(text)
                fragments = [own.groups[k] for k in at]
                if None not in fragments:
                    texts.append((digest, hashlib.sha256(";".join(fragments).encode()).hexdigest(), copies))
                    places.append(np.array(at, np.int64))
                    held += len(text)
                if held >= block_bytes or len(own.groups) > KEEP:
                    if texts:
                        yield _block(own, block, texts, places)
                    block, texts, places, held = block + 1, [], [], 0
                    if len(own.groups) > KEEP:
                        own._reset()
        if texts:
            yield _block(own, block, texts, places)

    return distinct.mapInArrow(run, BLOCKS)


def _measure(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Measures of one block's texts from the counts of its pairs."""
    schema = pa.schema([(f.name, f.type) for f in _TEXT][:4] + [("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
    if not blocks.num_rows:
        return schema.empty_table()
    row = blocks.slice(0, 1)
    texts = row.column("texts").combine_chunks().flatten()
    codes, sizes, linked = (np.frombuffer(row.column(c)[0].as_py(), "<i4") for c in ("codes", "sizes", "linked"))
    asked, n, best = (answers.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
    order = np.argsort(asked)  # the block's own pairs are sorted too, and each has one answer
    sums = np.stack([n[order], best[order].astype(np.int64)], axis=1)[linked]
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(sums, axis=0)])
    ends = np.cumsum(sizes)
    by_segment = sums[ends] - sums[ends - sizes]
    ends = np.cumsum(pc.struct_field(texts, "segments").to_numpy(zero_copy_only=False))
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(by_segment[codes], axis=0)])
    by_text = np.diff(sums[np.concatenate([[0], ends])], axis=0)
    own = [pc.struct_field(texts, c) for c in ("digest", "n_a", "n_b", "n_groups")]
    return pa.Table.from_arrays([*own, own[3], pa.array(by_text[:, 1]), pa.array(by_text[:, 0]), pc.struct_field(texts, "sha")], schema=schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of an id pair in the whole corpus, and whether no pair of its second id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    counts = stage(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("n")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("second", second).join(F.broadcast(most), "second")  # a row an id of the vocabulary
    return counts.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None, block_bytes: int = BLOCK
) -> DataFrame:
    """A row a document: its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    text = F.col(text_col)
    digest = F.unhex(F.sha2(F.col("text"), 256))
    distinct = docs.filter(text.isNotNull() & (text != "")).groupBy(text.alias("text")).agg(F.count("*").alias("copies"))
    blocks = stage(aligned_blocks(distinct.withColumn("digest", digest), first, second, block_bytes), "blocks")
    asked = blocks.select(F.col("block").alias("asker"), F.explode("pairs").alias("pair")).join(pair_counts(blocks), "pair")
    own = blocks.select("block", "texts", "codes", "sizes", "linked")
    measured = own.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(_measure, MEASURED)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # texts of many copies: the join's large partitions are split at run time, the side of measures has one row a text
    found = rows.join(stage(measured, "measures"), "digest", "left")
    return found.select(
        F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` under the byte-level and the piece tokenizer.

    Null, empty and unlike texts: zeros; very long ones are read whole; tied counts are all best; repeated rows count and
    get a row each; further columns are not read; an empty table gives no rows.
    """
    found = align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
