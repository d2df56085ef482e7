"""Phrase collocations by set-oriented mining over sorted occurrence relations.

``R1`` holds every word occurrence, ``Rk`` every occurrence of a phrase of k words
that may still be frequent, both sorted by piece and position.  A level is mined
as relations:

* group and count: each block of a relation counts its own phrases, and Spark adds
  these up per language;
* semi-join: occurrences of phrases that are not frequent go.  Where the frequent
  ones are few enough for a bitmap of ``BITS`` bits over their hashes, tasks keep
  that and look phrases up where blocks lie; beyond that size, each block asks in a
  join, once for each phrase it holds;
* merge-join: two neighbours of ``Rk`` in one piece, at adjacent positions, make
  an occurrence of ``Rk+1``.  Both halves of it are frequent, or it could not be.

A relation is a written table with a row a *block*: pieces of one language with
about ``BLOCK`` words (its last one in a task, or one of many languages, has fewer).  Words lie one after the other by piece and position, with
a free place between pieces, so that adjacent places are adjacent positions of one
piece; a block keeps the steps from place to place, the phrase at each, and the
distinct phrases.  Blocks are cut between pieces, also inside of long texts.

Places and phrases of a block are packed and compressed.  Semi-joins know phrases by hashes of language and phrase: a collision would only
keep occurrences that the exact counts leave out later.  Scores are integers of up
to 38 digits.

Defined results: null and empty texts have no words; a null lang counts as
``und``; repeated rows count each; a text is read whole, however long; a piece is
never cut; ties of cuts go to the shortest first part, equal ranks can't be, since
phrases differ; extra columns do not matter, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orrery.storage import drop_staged, stage

LEAST, WORDS, TOP = 10, 3, 2000
BLOCK, SLICE = 1 << 18, 1 << 20  # words, bytes
#: Full blocks that a task may hold as blocks of many languages.
HELD = 4
#: Blocks of a row group, so that readers and writers hold a few at once.
GROUP = 8
#: Bits of the bitmap that stands for the frequent phrases (8 MB), and how many bits each has to have at least.
BITS, BITS_EACH = 1 << 26, 8
SALTS = 16
ENDS = b".,;:!?\n\v\f\r"
#: Lower-case letters, and one character for all that end a piece.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"." * len(ENDS))
END = re.compile(rb"[.,;:!?\n-\r]")

RELATION = "block long, lang string, steps binary, codes binary, phrases array<string>, counts array<long>"
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("lang", pa.string()), ("steps", pa.binary()), ("codes", pa.binary()), ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers, compressed; the first byte is their width."""
    width = 1 if (most := values.max(initial=0)) < 1 << 8 else 2 if most < 1 << 16 else 4
    raw = values.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[9:], int.from_bytes(packed[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{packed[0]}").astype(np.int32)


def _row(block: int, lang: str, places: np.ndarray, codes: np.ndarray, phrases: pa.Array) -> list[pa.Array]:
    counts = np.bincount(codes, minlength=len(phrases)).astype(np.int64)
    values = [block, lang, _packed(np.diff(places, prepend=0)), _packed(codes)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), v) for v in (phrases, pa.array(counts))]
    return [*[pa.array([v], f.type) for v, f in zip(values, _SCHEMA, strict=False)], *lists]


class _Open:
    """The block of a language that is being filled."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, raw: bytes) -> None:
        spaced = raw.replace(b".", b" . ")  # an end is a token, which is no word and keeps its place
        self.parts.append(spaced)
        self.n += spaced.count(b" ") + 1

    def row(self, block: int, lang: str) -> list[pa.Array]:
        whole = pa.array([b" . ".join(self.parts)], pa.binary()).cast(pa.string())
        tokens = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
        codes, names = tokens.indices.to_numpy(), tokens.dictionary
        is_word = ~np.isin(names.to_numpy(zero_copy_only=False), ["", "."])  # nothing lies before a first blank
        places = np.flatnonzero(is_word[codes])
        number = np.cumsum(is_word, dtype=np.int32) - 1
        return _row(block, lang, places, number[codes[places]], names.filter(pa.array(is_word)))


def _slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts that end between pieces."""
    at = 0
    while at < len(raw):
        end = END.search(raw, at + size)
        to = end.end() if end else len(raw)
        yield raw[at:to]
        at = to


def word_occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK) -> DataFrame:
    """``R1``: blocks of word occurrences, by language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        filling: dict[str, _Open] = defaultdict(_Open)
        held = 0

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            for lang in langs:
                one = filling.pop(lang)
                held -= one.n
                yield pa.RecordBatch.from_arrays(one.row(block, lang), schema=_SCHEMA)
                block += 1
            pa.default_memory_pool().release_unused()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                for raw in _slices(text.as_py().encode().translate(PLAIN), SLICE):
                    one = filling[lang]
                    before = one.n
                    one.add(raw)
                    held += one.n - before
                    if one.n >= block_words:
                        yield from flush([lang])
                    elif held >= HELD * block_words:  # of many languages
                        yield from flush(list(filling))
        yield from flush(list(filling))

    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    return rows.mapInArrow(run, RELATION)


def phrase_counts(relation: DataFrame) -> DataFrame:
    """``(lang, phrase, n)`` of a relation: blocks have counted before."""
    each = relation.select("lang", "counts", F.posexplode("phrases").alias("at", "phrase"))
    return each.groupBy("lang", "phrase").agg(F.sum(F.expr("counts[at]")).alias("n"))


def frequent_codes(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(asker, code)``: the semi-join of the phrases that blocks hold with the frequent ones."""
    asked = relation.select("block", "lang", F.posexplode("phrases").alias("code", "phrase"))
    asked = asked.select(F.col("block").alias("asker"), "code", F.xxhash64("lang", "phrase").alias("key"))
    return asked.join(frequent.select(F.xxhash64("lang", "phrase").alias("key")), "key", "left_semi").select("asker", "code")


def frequent_bits(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit each for the frequent phrases' hashes: at most ``bits`` / 32768 rows of 4 KB reach the driver."""
    at = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(bits - 1)) + 1  # places count from 1
    parts = frequent.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("part"))
    found = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        found[(r.bucket - 1) * 4096 :][:4096] = np.frombuffer(r.part, np.uint8)
    return found


def _in_bits(found: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
    """Which phrases may be frequent; those that are, are never left out."""
    seed = xxh64_intdigest(lang, 42)
    keys = np.fromiter((xxh64_intdigest(p, seed) for p in phrases.to_pylist()), np.uint64, len(phrases)) & np.uint64(len(found) * 8 - 1)
    return (found[keys >> np.uint64(3)] >> (keys & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _extend(block: int, lang: str, steps: bytes, codes: bytes, phrases: pa.Array, stays: np.ndarray, last: bool) -> pa.RecordBatch | None:
    """The occurrences of a block made one word longer: merge-join of its frequent occurrences at adjacent places.

    Of the ``last`` level only the counts are kept.
    """
    places, codes = np.cumsum(_unpacked(steps), dtype=np.int32), _unpacked(codes)
    kept = np.flatnonzero(stays[codes])
    places, codes = places[kept], codes[kept]
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    if not len(at):
        return None
    longer, pairs = pd.factorize(codes[at].astype(np.int64) * len(phrases) + codes[at + 1])  # in any order: no sort
    first, second = pairs // len(phrases), pairs % len(phrases)
    parts = pc.split_pattern(phrases, " ", max_splits=1, reverse=True)
    ends = parts.offsets.to_numpy()[1:] - 1  # the last word of each phrase
    first, second = phrases.take(pa.array(first)), parts.values.take(pa.array(ends[second]))
    row = _row(block, lang, places[at], longer, pc.binary_join_element_wise(first, second, " "))
    if last:
        row[2:4] = [pa.nulls(1, pa.binary())] * 2
    return pa.RecordBatch.from_arrays(row, schema=_SCHEMA)


def longer_occurrences(relation: DataFrame, frequent: DataFrame, last: bool, bits: int = BITS) -> DataFrame:
    """``Rk+1`` from ``Rk`` and the (written) frequent phrases of k words."""
    relation = relation.drop("counts")
    if frequent.count() * BITS_EACH <= bits:
        found = relation.sparkSession.sparkContext.broadcast(frequent_bits(frequent, bits))

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    block, lang, steps, codes = (b.column(c)[k].as_py() for c in ("block", "lang", "steps", "codes"))
                    phrases = b.column("phrases")[k].values
                    row = _extend(block, lang, steps, codes, phrases, _in_bits(found.value, lang, phrases), last)
                    if row is not None:
                        yield row

        return relation.mapInArrow(look, RELATION)

    def join(own: pa.Table, alive: pa.Table) -> pa.Table:
        if not own.num_rows or not alive.num_rows:
            return _SCHEMA.empty_table()
        block, lang, steps, codes = (own.column(c)[0].as_py() for c in ("block", "lang", "steps", "codes"))
        phrases = own.column("phrases").combine_chunks().flatten()
        stays = np.zeros(len(phrases), bool)
        stays[alive.column("code").to_numpy()] = True
        row = _extend(block, lang, steps, codes, phrases, stays, last)
        return _SCHEMA.empty_table() if row is None else pa.Table.from_batches([row])

    alive = frequent_codes(relation, frequent)
    return relation.groupBy("block").cogroup(alive.groupBy("asker")).applyInArrow(join, RELATION)


def mine_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST, block_words: int = BLOCK, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, n)`` of phrases of 1 to ``words`` words that occur ``least`` times, and ``(lang, n)`` of all words."""
    relation = stage(word_occurrences(docs, text_col, lang_col, block_words), "occurrences", GROUP)
    counts = stage(phrase_counts(relation), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    found = level = stage(counts.filter(F.col("n") >= least).withColumn("size", F.lit(1)), "phrases")
    for size in range(2, words + 1):
        before, relation = relation, stage(longer_occurrences(relation, level, size == words, bits), "occurrences", GROUP)
        drop_staged(before)
        level = stage(phrase_counts(relation).filter(F.col("n") >= least).withColumn("size", F.lit(size)), "phrases")
        found = found.unionByName(level)
    return found.select("lang", "phrase", "size", "n"), totals


def _part(phrase: str, first: str, last: str) -> F.Column:
    return F.expr(f"array_join(slice(split({phrase}, ' '), {first}, {last} - {first} + 1), ' ')")


def score_phrases(found: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, l, r, score)`` of phrases of two words or more, at their lowest cut."""
    longer = found.filter("size > 1").withColumnRenamed("n", "a")
    cuts = longer.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumn("left", _part("phrase", "1", "k")).withColumn("right", _part("phrase", "k + 1", "size"))
    for side, name in (("left", "l"), ("right", "r")):  # parts of a frequent phrase are frequent
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns({f"__{c}": v for c, v in wide.items()})
    score = F.expr("(CAST(1000000 AS DECIMAL(38,0)) * __a * __a) div (__l * __r)")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")).select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def drop_contained(scored: DataFrame, percent: int = 50) -> DataFrame:
    """Without phrases that lie in a longer one with ``percent`` of their count or more."""
    parts = scored.filter("size > 2").withColumn("k", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size - k + 1)")))
    inside = parts.select("lang", _part("phrase", "at", "at + k - 1").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(inside, ["lang", "phrase"], "left")
    return kept.filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST, top: int = TOP, block_words: int = BLOCK, bits: int = BITS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    found, totals = mine_phrases(docs, text_col, lang_col, words, least, block_words, bits)
    kept = drop_contained(stage(score_phrases(found), "scored"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # no task ranks a whole language
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all ``documents``, by language.

    Null and empty texts have no words, a null lang is ``und``; very long texts are read whole; ties as the module says;
    repeated rows count each; further columns are not read; an empty table gives no rows.
    """
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    f1 AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(ws) AS phrase FROM w) GROUP BY lang, phrase),
    f2 AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS phrase FROM w) GROUP BY lang, phrase HAVING count(*) >= 10),
    f3 AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS phrase FROM w WHERE len(ws) > 2) GROUP BY lang, phrase HAVING count(*) >= 10),
    f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3),
    c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f2 UNION ALL SELECT lang, phrase, n, string_split(phrase, ' ') FROM f3),
    cut AS (SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM c),
    s AS (SELECT cut.*, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score FROM cut
      JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
    low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE len(ws) = 3) GROUP BY lang, part),
    kept AS (SELECT low.* FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.part = low.phrase WHERE most IS NULL OR 100 * most < 50 * a),
    total AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score::BIGINT AS score
    FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= 2000"""
