"""URL filters: listed host and path rules, and association rules mined by FP-growth.

URLs that a listed rule judges are the labels.  Their tokens (host labels, path
segments, suffixes, query keys, scheme) and the label form the transactions of
Spark's FP-growth; rules whose consequent is the label are pruned by support,
confidence, lift, length, and against shorter rules that are as sure.  The
others are kept in an inverted index under their rarest token, and a URL that
no listed rule fits is judged by the surest rule that its tokens contain.
URLs are matched as distinct token sets, so that a host with a third of all
rows is matched once.

Defined results: a null url, or one without ``://``, has empty host and path;
a URL that no listed and no mined rule fits is allowed, as are all when nothing
is labelled; equally sure rules are told apart by support, then by their tokens;
very long URLs are read whole, and what they share is mined by counting sets of
up to three tokens where FP-growth would name 2 ** n; repeated rows give repeated results; extra columns
pass through, but for those with the names of added columns, which are replaced;
an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.storage import stage

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 0.02, 5, 0.8, 1.0, 3
#: Tokens of a row up to which FP-growth may name all sets.
LONGEST = 12


def _after_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens; runs of digits become ``#`` so that page numbers don't hide what is shared."""

    def named(mark: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.regexp_replace(w, "[0-9]+", "#")))

    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    words = F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/")
    parts = F.concat(
        named("h:", labels),
        named("w:", F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda w: ~F.array_contains(labels, w))),
        named("p:", words),
        named("x:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        named("q:", keys),
        named("s:", F.array(F.substring_index(url, "://", 1))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def _token_classes(labelled: DataFrame, least: int) -> DataFrame:
    """``(token, rep, verdict, n, total)`` of tokens seen ``least`` times with a verdict, at their most frequent one.

    Tokens that lie in the very same rows have the same rules: they are mined once, as ``rep``, the smallest of them.
    """
    rows = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("m"))  # equal transactions once
    row = F.sum(F.xxhash64("tokens", "verdict").cast("decimal(38,0)")), F.sum(F.xxhash64("verdict", "tokens").cast("decimal(38,0)"))
    seen = rows.select("tokens", "verdict", "m", F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.sum("m").alias("n"), *[c.alias(f"s{k}") for k, c in enumerate(row)])
    by_token = seen.groupBy("token").agg(F.sum("n").alias("total"), F.max(F.struct("n", "verdict")).alias("most"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    often = by_token.filter(F.col("most.n") >= least).select("token", "total", "most.n", "most.verdict", "s0", "s1")
    reps = often.groupBy("s0", "s1", "total").agg(F.min("token").alias("rep"))
    return often.join(reps, ["s0", "s1", "total"]).select("token", "rep", "verdict", "n", "total")


def _counted_sets(rows: DataFrame, n: int, least: int, share: DataFrame) -> DataFrame:
    """``(tokens, verdict, confidence, support)`` by counting sets of one token, two and so on: for long transactions.

    A set grows only while it is seen ``least`` times with a verdict and does not already tell it for sure.
    """
    rows = stage(rows.groupBy("items", "verdict").agg(F.count("*").alias("m")).withColumn("row", F.monotonically_increasing_id()), "transactions")
    grown, found = rows.select("row", "items", "verdict", "m", F.explode("items").alias("t")).withColumn("tokens", F.array("t")), None
    for size in range(1, MAX_TOKENS + 1):
        counts = grown.groupBy("tokens", "verdict").agg(F.sum("m").alias("n"))
        total = counts.groupBy("tokens").agg(F.sum("n").alias("total"))
        sets = stage(counts.join(total, "tokens").filter(F.col("n") >= least), "sets")
        found = sets if found is None else found.unionByName(sets)
        if size < MAX_TOKENS:
            alive = sets.groupBy("tokens").agg(F.max(F.col("n") / F.col("total")).alias("sure")).filter("sure < 1").select("tokens")
            last = F.element_at("tokens", -1)
            grown = grown.join(alive, "tokens", "left_semi").withColumn("t", F.explode(F.filter("items", lambda x: x > last)))
            grown = grown.withColumn("tokens", F.array_append("tokens", F.col("t")))
    found = found.join(F.broadcast(share), "verdict")  # a row a verdict
    sure = F.col("n") / F.col("total")
    rules = found.withColumn("confidence", sure).filter((sure >= MIN_CONFIDENCE) & (sure / F.col("share") > MIN_LIFT))
    return rules.select("tokens", "verdict", "confidence", (F.col("n") / n).alias("support"))


def _grown_sets(rows: DataFrame, support: float) -> DataFrame:
    """The same by Spark's FP-growth over items and label."""
    items = rows.select(F.array_append("items", F.concat(F.lit("="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=MIN_CONFIDENCE).fit(items)
    return model.associationRules.filter(
        F.element_at("consequent", 1).startswith("=")
        & (F.size("antecedent") <= MAX_TOKENS)
        & ~F.exists("antecedent", lambda t: t.startswith("="))
        & (F.col("lift") > MIN_LIFT)
    ).select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 100).alias("verdict"), "confidence", "support")


def mine_rules(labelled: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Rules ``(tokens, verdict, confidence, support)`` from rows ``(tokens, verdict)``.

    Only tokens that can be part of a longer rule are mined together: frequent ones that do not tell a verdict for sure by
    themselves (a longer rule would be no surer), one for all that lie in the same rows.  FP-growth names sets of every
    length, 2 ** n for n tokens in common; where more than ``longest`` tokens of a row are left, sets of up to
    ``MAX_TOKENS`` are counted length by length instead, with the same result.
    """
    labelled = stage(labelled.select("tokens", "verdict"), "labelled")
    n = labelled.count()
    support = min(1.0, max(MIN_SUPPORT, MIN_ROWS / max(n, 1)))
    least = ceil(support * n)
    share = labelled.groupBy("verdict").agg((F.count("*") / n).alias("share"))
    classes = stage(_token_classes(labelled, least), "classes")
    alone = classes.filter("n = total").join(F.broadcast(share), "verdict").filter(1 / F.col("share") > MIN_LIFT)  # a row a verdict
    alone = alone.select(F.array("token").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / n).alias("support"))
    open_reps = classes.filter("n < total AND token = rep").select("token")
    numbered = labelled.withColumn("row", F.monotonically_increasing_id())
    kept = numbered.select("row", F.explode("tokens").alias("token")).join(open_reps, "token").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("items"))
    rows = stage(numbered.select("row", "verdict").join(kept, "row", "left").select("verdict", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "items")
    most = rows.agg(F.max(F.size("items"))).first()[0] or 0
    rules = _grown_sets(rows, support) if most <= longest else _counted_sets(rows, n, least, share)
    rules = stage(rules.withColumns({c: F.round(c, 9) for c in ("confidence", "support")}), "rules")
    shorter = (
        rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("out"))
        .select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("out")).alias("part"))
        .join(rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure")), ["part", "verdict"])
        .filter(F.col("sure") >= F.col("confidence"))
        .select("tokens", "verdict")
        .distinct()
    )
    rules = rules.join(shorter, ["tokens", "verdict"], "left_anti")
    members = classes.filter("n < total").select(F.col("rep"), F.col("token").alias("member"))
    rules = rules.withColumn("todo", F.col("tokens")).withColumn("tokens", F.array().cast("array<string>"))
    done = rules.filter("false").drop("todo")
    for _ in range(MAX_TOKENS):  # every token of a class in its place
        rules = rules.withColumn("rep", F.element_at("todo", 1)).withColumn("todo", F.slice("todo", 2, MAX_TOKENS)).join(members, "rep")
        rules = rules.withColumn("tokens", F.array_append("tokens", F.col("member"))).drop("rep", "member")
        done = done.unionByName(rules.filter(F.size("todo") == 0).drop("todo"))
        rules = rules.filter(F.size("todo") > 0)
    done = done.withColumn("tokens", F.array_sort("tokens")).select("tokens", "verdict", "confidence", "support")
    return done.unionByName(alone.withColumn("support", F.round("support", 9)))


def rule_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(token, rules)``: each rule under the rarest of its tokens."""
    seen = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    keyed = rules.withColumn("token", F.explode("tokens")).join(seen, "token")
    rarest = keyed.groupBy("tokens", "verdict").agg(
        F.min(F.struct("count", "token"))["token"].alias("token"),
        F.first("confidence").alias("confidence"),
        F.first("support").alias("support"),
    )
    return rarest.groupBy("token").agg(F.collect_list(F.struct("confidence", "support", "tokens", "verdict")).alias("rules"))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """All rows with ``host, path, rule, verdict, mined`` (the tokens of the mined rule that decided)."""
    added = ["host", "path", "rule", "verdict", "mined"]
    pages = pages.drop(*[c for c in pages.columns if c in added and c != url_col])
    url = F.col(url_col)
    judged = (
        pages.withColumn("host", F.coalesce(url_host(url), F.lit("")))
        .withColumn("path", F.coalesce(url_path(url), F.lit("")))
        .withColumn("__rule", listed_rule(F.col("host"), F.col("path"), rules))
        .withColumn("__tokens", url_tokens(F.coalesce(url, F.lit("")), F.col("host"), F.col("path")))
        .withColumn("__key", F.array_join("__tokens", " "))
    )
    tokens = stage(judged.select(F.col("__tokens").alias("tokens"), F.col("__key").alias("key"), "__rule.verdict"), "tokens")
    labelled = tokens.filter(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    if labelled.isEmpty():
        found = F.struct("__rule.rule", F.coalesce("__rule.verdict", F.lit("allow")).alias("verdict"))
        return judged.select(*pages.columns, "host", "path", found["rule"].alias("rule"), found["verdict"].alias("verdict"),
                             F.lit(None).cast("array<string>").alias("mined"))
    index = rule_index(stage(mine_rules(labelled), "mined"), labelled)
    open_sets = tokens.filter(F.col("verdict").isNull()).groupBy("key").agg(F.first("tokens").alias("tokens"))
    best = (
        open_sets.select("key", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .withColumn("fit", F.filter("rules", lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0))
        .groupBy("key")
        .agg(F.max(F.array_max("fit")).alias("best"))
        .filter(F.col("best").isNotNull())
        .select(F.col("key").alias("__key"), F.col("best.tokens").alias("mined"), F.col("best.verdict").alias("__mined"))
    )
    return (
        judged.join(stage(best, "verdicts"), "__key", "left")
        .withColumn("mined", F.when(F.col("__rule").isNull(), F.col("mined")))
        .withColumn("rule", F.col("__rule.rule"))
        .withColumn("verdict", F.coalesce("__rule.verdict", "__mined", F.lit("allow")))
        .select(*pages.columns, *added)
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``: host, path, listed rule and verdict; nulls, ties and repeats as the module says."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"))
