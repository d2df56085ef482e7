"""Secret scans with column expressions only: patterns, then sliding-window entropy.

Three anchored patterns give base spans.  The method adds spans of candidate
strings (runs of token characters) in which some window of ``WINDOW`` characters
has a Shannon entropy above the threshold of the candidate's character class.
The entropy of a window follows from the one before it: one count goes up, one
goes down, and only those two terms of ``sum(c * log2(c))`` change.  Counts lie
five bits each in a few long integers, so a candidate costs one step of fixed
size a character, whatever its length and the window.  Allow-listed candidates,
hot ranges with a placeholder, and candidates that a base span covers add
nothing.  Patterns repeat single characters only, never groups, so that no
length of text makes the pattern engine recurse or go back.

Everything is computed row by row; nothing is shuffled.  Defined results: null
text counts as empty; an empty text has no spans; positions are code points,
end exclusive; very long texts and candidates are scanned whole; repeated rows
give repeated results; extra columns pass through, but for those named ``base``
and ``spans``, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base scan, the group that is measured, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
WINDOW = 20
#: Character classes, the first that fits a whole candidate counts: least bits a character in some window.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 2.9),
    ("one case", r"^[0-9a-z]+$|^[0-9A-Z]+$", 3.4),
    ("letters", r"^[A-Za-z]+$", 3.9),
    ("alnum", r"^[0-9A-Za-z]+$", 3.7),
    ("base64", r"^", 3.8),
)
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Letters of one case, or no letters; words and short numbers that only separators join.
PLAIN = r"^[a-z/_=+-]+$|^[A-Z/_=+-]+$|^[0-9/_=+-]+$"
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"
JOINED = r"[/_=+-]"
#: What marks a hot range as an example.
PLACEHOLDER = r"(?i)(^|[/_+-])(example|placeholder|dummy|changeme|sample)([/_+=-]|$)|x{8}|0123456789|abcdefghij"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
WORD = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"
BLOCK = 512


def _gather(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(at, item)`` yields beside the next ``at`` (from 0), without nulls, as an array of ``kind``.

    An aggregate copies its state at each step, so a long array of items is gathered in blocks.
    """
    none = F.array().cast(kind)

    def go(done: Column, item: Column) -> Column:
        at, new = step(done["at"], item)
        return F.struct(at.alias("at"), F.when(new.isNotNull(), F.array_append(done["found"], new)).otherwise(done["found"]).alias("found"))

    def gathered(listed: Column) -> Column:
        def block(done: Column, k: Column) -> Column:
            start = F.struct(done["at"].alias("at"), none.alias("found"))
            return F.aggregate(
                F.slice(listed, k * BLOCK + 1, F.lit(BLOCK)), start, go,
                lambda d: F.struct(d["at"].alias("at"), F.concat(done["found"], d["found"]).alias("found")),
            )

        blocks = F.sequence(F.lit(0), F.floor((F.size(listed) - 1) / BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), none.alias("found"))
        return F.when(F.size(listed) > 0, F.aggregate(blocks, start, block, lambda done: done["found"])).otherwise(none)

    return F.get(F.transform(F.array(items), gathered), F.lit(0))  # a name for the items, so that they are computed once


def _span(start: Column, rank: int, end: Column, kind: str, text: Column | None = None) -> Column:
    more = [] if text is None else [text.alias("text")]
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), *more)


def _found(text: Column, pattern: str, measured: int, least: int, rank: int, kind: str, with_text: bool = False) -> Column:
    """Spans of a pattern's matches, left to right, of which the measured group is long enough.

    The pieces between matches and the matches themselves alternate, so their
    lengths add up to positions.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(measured)), F.length).alias("measured"),
    )
    parts = F.filter(parts, lambda p: p["match"].isNotNull())

    def place(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        end = start + F.length(p["match"])
        return end, F.when(p["measured"] >= least, _span(start, rank, end, kind, p["match"] if with_text else None))

    return _gather(parts, WORD if with_text else SPAN, place)


FIRST, BITS, SLOTS = ord("+"), 5, 12  # candidates' characters lie from + to z: seven longs of twelve counts
LONGS = -(-(ord("z") - FIRST + 1) // SLOTS)


def hot_range(text: Column, bits: Column, window: int = WINDOW) -> Column:
    """First start and last end of the windows of ``text`` with at least ``bits`` bits a character; null if none has.

    ``text`` holds characters from ``+`` to ``z`` only; a window is of at most 31.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    slots = F.transform(
        F.split(text, ""),
        lambda c: F.struct(
            F.floor((F.ascii(c) - FIRST) / SLOTS).cast("int").alias("long"), ((F.ascii(c) - FIRST) % SLOTS * BITS).alias("shift")
        ),
    )
    none = F.struct(F.lit(-1).alias("long"), F.lit(0).alias("shift"))
    gone = F.slice(F.concat(F.array_repeat(none, window), slots), F.lit(1), F.length(text))
    steps = F.zip_with(slots, gone, lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    begin = F.struct(
        F.array(*[F.lit(0).cast("long")] * LONGS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        (window * (math.log2(window) - bits) + 1e-9).alias("most"),  # in the state, so that it is computed once
    )

    def shifted(name: str, value: Column, by: Column) -> Column:
        return F.call_function(name, value, by)

    def slide(state: Column, step: Column) -> Column:
        new, old = step["new"], step["old"]

        def count(c: Column) -> Column:
            return shifted("shiftrightunsigned", F.get(state["counts"], c["long"]), c["shift"]).bitwiseAND(31).cast("int")

        def unit(k: Column, c: Column) -> Column:
            return F.when(k == c["long"], shifted("shiftleft", F.lit(1).cast("long"), c["shift"])).otherwise(F.lit(0).cast("long"))

        up, down, leaves = count(new), count(old), old["long"] >= 0
        gain = F.get(terms, up + 1) - F.get(terms, up) + F.when(leaves, F.get(terms, down - 1) - F.get(terms, down)).otherwise(0.0)
        moved = (new["long"] != old["long"]) | (new["shift"] != old["shift"])
        total = state["sum"] + F.when(moved, gain).otherwise(0.0)
        hot = (state["at"] >= window - 1) & (total <= state["most"])
        return F.struct(
            F.transform(state["counts"], lambda v, k: v + unit(k, new) - unit(k, old)).alias("counts"),
            total.alias("sum"),
            (state["at"] + 1).alias("at"),
            F.when(hot, F.coalesce(state["first"], state["at"] - (window - 1))).otherwise(state["first"]).alias("first"),
            F.when(hot, state["at"] + 1).otherwise(state["last"]).alias("last"),
            state["most"].alias("most"),
        )

    return F.aggregate(steps, begin, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns by start, then kind as listed."""
    hints = (text.rlike(BASE[0][1]), text.contains("AKIA"), text.rlike(BASE[2][1]))
    found = [
        F.when(hint, _found(text, pattern, group, least, rank, kind)).otherwise(F.array().cast(SPAN))
        for rank, (hint, (kind, pattern, group, least)) in enumerate(zip(hints, BASE, strict=True))
    ]
    return F.array_sort(F.concat(*found))


def _uncovered(found: Column, base: Column) -> Column:
    """Spans of ``found`` that no single span of ``base`` covers, by one pass in order of start."""
    base = F.transform(base, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")], F.lit("").alias("text")))

    def go(end: Column, s: Column) -> tuple[Column, Column]:
        mine = s["rank"] == len(BASE)
        return F.when(mine, end).otherwise(F.greatest(end, s["end"])), F.when(mine & (s["end"] > end), s)

    return _gather(F.array_sort(F.concat(base, found)), WORD, go)


def allowed(word: Column) -> Column:
    """Candidates that are no secrets by their form: letters of one case, numbers, UUIDs, joined words and dates."""
    return word.rlike(PLAIN) | (word.rlike(JOINED) & ~word.rlike(MIXED)) | word.rlike(UUID)


def candidates(text: Column) -> Column:
    """Spans of candidate strings, with their texts."""
    found = _found(text, CANDIDATE, 0, WINDOW, len(BASE), "entropy", with_text=True)
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(WORD))


def entropy_spans(found: Column, base: Column) -> Column:
    """Spans of candidates with a window of high entropy, beyond what ``base`` covers."""
    rank = len(BASE)
    words = F.filter(found, lambda s: ~allowed(s["text"]))
    words = F.when((F.size(words) > 0) & (F.size(base) > 0), _uncovered(words, base)).otherwise(words)

    def threshold(w: Column) -> Column:
        bits = F.when(w.rlike(CLASSES[0][1]), F.lit(CLASSES[0][2]))
        for _, pattern, least in CLASSES[1:]:
            bits = bits.when(w.rlike(pattern), F.lit(least))
        return bits

    spans = F.transform(
        words, lambda w: F.struct(w["start"].alias("start"), w["text"].alias("text"), hot_range(w["text"], threshold(w["text"])).alias("hot"))
    )
    spans = F.filter(
        spans,
        lambda s: s["hot"]["first"].isNotNull()
        & ~F.substring(s["text"], s["hot"]["first"] + 1, s["hot"]["last"] - s["hot"]["first"]).rlike(PLACEHOLDER),
    )
    return F.transform(
        spans, lambda s: _span(s["start"] + s["hot"]["first"], rank, s["start"] + s["hot"]["last"], "entropy")
    )


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with ``base`` and ``spans``: arrays of (start, rank, end, kind). Columns of these names are replaced."""
    docs = docs.drop(*({"base", "spans"} - {text_col}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # columns of their own, so that each is computed once
    found = docs.withColumn("__base", base_spans(text)).withColumn("__found", candidates(text))
    spans = F.array_sort(F.concat("__base", entropy_spans(F.col("__found"), F.col("__base"))))
    return found.select(*docs.columns, F.col("__base").alias("base"), spans.alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or union of overlapping spans, replaced by ``mark``."""

    def cut(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece)

    pieces = _gather(spans, "array<string>", cut)
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: counts and digest of base spans, and all spans; nulls, empties and repeats as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind, *_ in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
