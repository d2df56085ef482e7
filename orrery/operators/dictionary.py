"""Names of a table in texts: an Aho-Corasick automaton over words, or a join where the table is too large for one.

Names and texts are cut into words of lower-case letters and digits, so a match
begins and ends at word bounds and a name of several words matches across any
marks between them.  The automaton goes once over the words of a text, however
many names there are.  It is built from the table, shipped to the tasks once and
bounded: names above ``MOST_NAMES`` words in all are joined to the texts by their
first word instead, and what joins is compared word by word.

Results: ``key, start, words, name_id`` with the first word's place from 1 and how
many words matched.  With ``longest`` the leftmost match wins, then the longest, and
matches do not overlap; else every match is given.  Names without a word never
match; of equal names each id is given; null texts have no matches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.storage import stage

MOST_NAMES = 2_000_000


class Automaton:
    """States are prefixes of names; each knows the next states, where to go on a mismatch, and the names that end in it."""

    def __init__(self, names: Iterable[tuple[Any, list[str]]]):
        self.next: list[dict[str, int]] = [{}]
        self.names: list[list[Any]] = [[]]
        self.depth = [0]
        for name_id, words in names:
            at = 0
            for w in words:
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.names.append([])
                    self.depth.append(self.depth[at] + 1)
                at = self.next[at][w]
            if at:
                self.names[at].append(name_id)
        self.back = [0] * len(self.next)
        self.ends = [-1] * len(self.next)  # the longest proper suffix in which a name ends
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for w, to in self.next[at].items():
                todo.append(to)
                self.back[to] = self._step(self.back[at], w)
            back = self.back[at]
            self.ends[at] = back if self.names[back] else self.ends[back]

    def _step(self, at: int, word: str) -> int:
        while at and word not in self.next[at]:
            at = self.back[at]
        return self.next[at].get(word, 0)

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, Any]]:
        """(start from 1, words, name) of every match, by where it ends."""
        at = 0
        for end, w in enumerate(words, 1):
            at = self._step(at, w)
            hit = at
            while hit > 0:
                n = self.depth[hit]
                for name in self.names[hit]:
                    yield end - n + 1, n, name
                hit = self.ends[hit]


def leftmost_longest(matches: Iterable[tuple[int, int, Any]]) -> list[tuple[int, int, Any]]:
    """Matches that do not overlap: the leftmost first, the longest of those; equal spans all stay."""
    kept: list[tuple[int, int, Any]] = []
    end, span = 0, None
    for m in sorted(matches, key=lambda m: (m[0], -m[1], str(m[2]))):
        if m[0] > end or m[:2] == span:
            kept.append(m)
            end, span = m[0] + m[1] - 1, m[:2]
    return kept


def find_names(rows: DataFrame, key: str, text: Column, names: DataFrame, name_id: str, name: str, longest: bool = True, most: int = MOST_NAMES) -> DataFrame:
    """``key, start, words, name_id`` of the names found in the texts."""
    spark = rows.sparkSession
    listed = names.select(F.col(name_id).alias("name_id"), tokens(F.col(name)).alias("parts")).filter(F.size("parts") > 0).distinct()
    listed = stage(listed, "names")
    kinds = rows.schema[key].dataType.simpleString(), listed.schema["name_id"].dataType.simpleString()
    kind = f"key {kinds[0]}, start int, words int, name_id {kinds[1]}"
    texts = rows.select(F.col(key).alias("key"), tokens(text).alias("w")).filter(F.size("w") > 0)
    if (listed.agg(F.sum(F.size("parts"))).first()[0] or 0) <= most:
        table = spark.sparkContext.broadcast([(r.name_id, r.parts) for r in listed.collect()])  # `most` words at most

        def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Automaton(table.value)
            for b in batches:
                found = []
                for k, words in zip(b["key"], b["w"], strict=True):
                    hits = own.matches(list(words))
                    found += [(k, *m) for m in (leftmost_longest(hits) if longest else hits)]
                yield pd.DataFrame(found, columns=["key", "start", "words", "name_id"])

        return texts.mapInPandas(scan, kind).withColumnRenamed("key", key)
    heads = listed.withColumn("head", F.element_at("parts", 1))
    # equal keys are different rows: each row has a number of its own
    numbered = stage(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    words = numbered.select("row", F.posexplode("w").alias("at", "head"))
    first = words.join(heads, "head").select("row", (F.col("at") + 1).alias("start"), "parts", "name_id")
    near = first.join(numbered, "row").filter(F.slice("w", F.col("start"), F.size("parts")) == F.col("parts"))
    found = near.select("row", "key", "start", F.size("parts").alias("words"), "name_id")
    if not longest:
        return found.select(F.col("key").alias(key), "start", "words", "name_id")
    spans = found.withColumn("best", F.max("words").over(W.partitionBy("row", "start"))).filter("words = best")

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        kept = leftmost_longest(part[["start", "words", "name_id"]].itertuples(index=False, name=None))
        out = pd.DataFrame(kept, columns=["start", "words", "name_id"])
        out.insert(0, "key", part["key"].iloc[0])
        return out

    return spans.drop("best").groupBy("row").applyInPandas(greedy, kind).withColumnRenamed("key", key)
