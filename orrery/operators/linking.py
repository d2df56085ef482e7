"""Names found in other names: containment, word overlap and first links, on real keys in place of all pairs.

Names are compared as distinct texts.  What copies a name has is the caller's to join: pairs of distinct texts grow with the
texts, pairs of rows with the square of a popular one's copies.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.similarity import fuzzy_join
from orrery.sources.tables import spread
from orrery.storage import stage

_WORD = re.compile(r"[^ \t-\r]+")  # what lies between white space of Java's patterns


def plain_words(name: Column) -> Column:
    """Letters and digits of the lower-cased name, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def contained_names(needles: DataFrame, names: DataFrame, needle: str, name: str) -> DataFrame:
    """``needle, name``: pairs of distinct texts where the needle's words lie in the name, whole and in a row.

    A needle is looked up by that of its words which fewest names have; one that has a word of no name has no key and no
    pair.  Null and empty texts are in nothing and hold nothing.
    """
    found = names.select(F.col(name).alias("__name"), plain_words(F.col(name)).alias("__hay")).filter("__hay != ''").distinct()
    words = stage(found.withColumn("__word", F.explode(F.array_distinct(F.split("__hay", " ")))), "words")
    asked = needles.select(F.col(needle).alias("__needle"), plain_words(F.col(needle)).alias("__text")).filter("__text != ''").distinct()
    asked = asked.withColumn("__parts", F.array_distinct(F.split("__text", " ")))
    seen = words.groupBy("__word").agg(F.count("*").alias("__seen"))
    keys = asked.select("__needle", "__text", F.size("__parts").alias("__size"), F.explode("__parts").alias("__word")).join(seen, "__word")
    keys = keys.groupBy("__needle", "__text", "__size").agg(F.min(F.struct("__seen", "__word")).alias("__key"), F.count("*").alias("__known"))
    keys = keys.filter("__known = __size").select("__needle", "__text", F.col("__key.__word").alias("__word"))
    space = F.lit(" ")
    inside = F.concat(space, "__hay", space).contains(F.concat(space, "__text", space))
    return keys.join(words, "__word").filter(inside).select(F.col("__needle").alias(needle), F.col("__name").alias(name))


def shared_parts(rows: DataFrame, text: str, stop: Sequence[str], inner: DataFrame, inner_text: str) -> DataFrame:
    """The other columns of ``rows`` with ``part, common``: parts of a text that an inner text can be, with words in common.

    A part is as long as some inner text; ``common`` is how many of its distinct words, not in ``stop``, are words of the whole
    text, one at least.  All words of a part but its first and last are whole words of the text.
    """
    padded = F.col(inner_text).rlike(r"^\s|\s$")
    about = inner.agg(F.sort_array(F.collect_set(F.length(inner_text))).alias("lengths"), F.max(F.size(F.split(inner_text, r"\s+"))).alias("words"), F.max(padded).alias("padded")).first()
    lengths, most, padded, stopped = list(about.lengths), about.words or 0, bool(about.padded), frozenset(stop)
    kept = [c for c in rows.columns if c != text]

    def parts(whole: str) -> Iterator[tuple[str, int]]:
        spans = [m.span() for m in _WORD.finditer(whole)]
        words, starts, ends = [whole[a:b] for a, b in spans], [a for a, _ in spans], [b for _, b in spans]
        own = set(words) - stopped
        known = [0, *accumulate(w in own for w in words)]
        for s in range(ends[-1] if own else 0):
            i = bisect_right(ends, s)  # the first word of the part, whole or its end
            if s < starts[i] and not padded:
                continue
            first = whole[max(s, starts[i]) : ends[i]]
            for e in (s + n for n in lengths):
                j = bisect_left(starts, e) - 1  # the last one
                if e > len(whole) or j - i >= most:
                    break
                if j < i or (e > ends[j] and not padded):
                    continue
                last = whole[max(s, starts[j]) : min(e, ends[j])]
                if last in own or (j > i and (first in own or known[j] > known[i + 1])):
                    yield whole[s:e], len(own & {last, *words[i + 1 : j], *([first] if j > i else [])})

    def some(b: pa.RecordBatch) -> Iterator[tuple[int, str, int]]:
        for k, whole in enumerate(b.column(text).to_pylist()):
            for part, common in parts(whole):
                yield k, part, common

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = some(b)
            while held := list(islice(found, 1 << 14)):
                at, part, common = zip(*held, strict=True)
                columns = [b.column(c).take(pa.array(at, pa.int32())) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.string()), pa.array(common, pa.int32())], [*kept, "part", "common"])

    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("part", T.StringType()), T.StructField("common", T.IntegerType())])
    return spread(rows.select(*kept, text)).mapInArrow(run, schema)


def overlap_matches(
    targets: DataFrame, register: DataFrame, target: str, name: str, key: str, active: Column, stop: Sequence[str], least: float = 0.4
) -> DataFrame:
    """``target, key, score``: the best entry of a register for each distinct target text.

    An entry needs a word in common that is not in ``stop``.  Its score is the share of the target's words in common, 0.5
    more if one text lies in the other, 0.1 more if it is ``active``; it has to reach ``least``, which is above 0.1.  Of equal
    scores the smallest key counts.  Lower case; null texts and texts without a word match nothing.

    Targets and entries do not meet in pairs, since a word or two are in many of both.  The best of the entries that have a
    word, or two words, is the active one and the other one of the smallest key; an entry that shares more is found by what
    it shares.  Where one text lies in the other, the parts of the outer one (``shared_parts``) are looked up by equality.
    Only entries that share three words or more with a target meet it, by one of the rare ones: in each of two texts that
    share c words, at least c - 1 words are as common as the rarest shared one or more.
    """
    if least <= 0.1:
        raise ValueError(f"a score above 0.1 is needed, not {least}")
    stopped = F.array(*[F.lit(w) for w in stop]).cast("array<string>")

    def told(text: Column) -> Column:
        """Words of lower-cased texts; none for an empty text."""
        return F.filter(F.array_distinct(F.split(F.trim(text), r"\s+")), lambda w: w != "")

    def own(words: str) -> Column:
        return F.array_sort(F.array_except(words, stopped))

    entries = register.select(key, F.lower(name).alias("__name"), F.coalesce(active, F.lit(False)).alias("__active")).groupBy("__name", "__active").agg(F.min(key).alias(key))
    entries = stage(entries.withColumn("__own", own(told(F.col("__name")))).filter(F.size("__own") > 0), "register")
    texts = stage(targets.select(target).filter(F.col(target).isNotNull()).distinct().withColumn("__low", F.lower(target)), "texts")
    asked = texts.select("__low").distinct().withColumn("__words", told(F.col("__low")))
    asked = stage(asked.select("__low", F.size("__words").alias("__n"), own("__words").alias("__own")).filter(F.size("__own") > 0), "targets")

    def best(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "__active").agg(F.min(key).alias(key))

    def pairs(rows: DataFrame, *ids: str) -> DataFrame:
        one = rows.select(*ids, "__own", F.explode("__own").alias("__a"))
        return one.select(*ids, "__a", F.explode(F.expr("filter(__own, w -> w > __a)")).alias("__b"))

    def rare(rows: DataFrame, words: DataFrame, need: Column, *ids: str) -> DataFrame:
        """Rows and their rarest words of ``words``, but for ``need - 1`` of them."""
        each = rows.select(*ids, "__own", need.alias("__need"), F.explode("__own").alias("__word")).join(words, "__word")
        all_ = W.partitionBy(*ids)
        each = each.withColumns({"__at": F.row_number().over(all_.orderBy("__seen", "__word")), "__all": F.count("*").over(all_)})
        return each.filter("__at <= __all - __need + 1").select(*ids, "__own", "__word")

    plain, inside = F.lit(False).alias("__inside"), F.lit(True).alias("__inside")
    each = entries.select("__active", key, F.explode("__own").alias("__a"))
    found = asked.select("__low", "__n", F.explode("__own").alias("__a")).join(best(each, "__a"), "__a").select("__low", "__n", F.lit(1).alias("__common"), plain, "__active", key)
    two = pairs(asked, "__low", "__n").join(best(pairs(entries, "__active", key), "__a", "__b"), ["__a", "__b"])
    found = found.unionByName(two.select("__low", "__n", F.lit(2).alias("__common"), plain, "__active", key))

    need = F.greatest(F.lit(3), F.ceil((least - 0.1) * F.col("__n") - 1e-9))
    more = asked.filter(F.size("__own") > 2)
    words = more.select(F.explode("__own").alias("__word")).distinct()
    seen = entries.select(F.explode("__own").alias("__word")).join(words, "__word", "left_semi").groupBy("__word").agg(F.count("*").alias("__seen"))
    seen = stage(seen, "seen")  # a word of no entry is no key
    left = rare(more, seen, need, "__low", "__n").withColumnRenamed("__own", "__theirs")
    right = rare(entries.filter(F.size("__own") > 2), seen, F.lit(3), "__name", "__active", key)
    met = left.join(right, "__word").withColumn("__common", F.size(F.array_intersect("__own", "__theirs"))).filter("__common > 2")
    found = found.unionByName(met.select("__low", "__n", "__common", plain, "__active", key))

    outer = shared_parts(entries.select("__active", key, "__name"), "__name", stop, asked, "__low")
    outer = best(outer, "part", "common").withColumnRenamed("part", "__low")
    found = found.unionByName(outer.join(asked.select("__low", "__n"), "__low").select("__low", "__n", F.col("common").alias("__common"), inside, "__active", key))
    outer = shared_parts(asked.select("__n", F.col("__low").alias("__whole"), "__low"), "__whole", stop, entries, "__name").withColumnRenamed("part", "__name")
    found = found.unionByName(outer.join(entries.select("__name", "__active", key), "__name").select("__low", "__n", F.col("common").alias("__common"), inside, "__active", key))

    bonus = F.when(F.col("__inside"), 0.5).otherwise(0.0) + F.when(F.col("__active"), 0.1).otherwise(0.0)
    scored = found.withColumn("score", F.round(F.col("__common") / F.col("__n") + bonus, 4)).filter(F.col("score") >= least)
    top = scored.groupBy("__low").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))).alias("b"))
    return texts.join(top, "__low").select(target, F.col("b.k").alias(key), (-F.col("b.s")).alias("score"))


def first_links(people: DataFrame, firms: DataFrame, person: str, firm: str, sure: str, linked: DataFrame, least: float = 0.95, least_sure: float = 0.5) -> DataFrame:
    """``person, firm, similarity``: links of people that have none yet and are ``least_sure`` or more to the firm of the nearest name.

    Names are distinct texts, compared in lower case; the ratio has to be ``least`` or more, and of equal ones the first name
    counts.  Who is in ``linked`` keeps the link there, so a second run over its result adds nothing.
    """
    open_ = people.filter(F.col(sure) >= least_sure).groupBy(F.lower(person).alias(person)).agg(F.max(sure).alias(sure)).join(linked.select(person), person, "left_anti")
    names = firms.select(F.lower(firm).alias(firm)).distinct()
    return fuzzy_join(open_, names, person, firm, [], least, 1, [person, firm]).select(person, firm, "similarity")
