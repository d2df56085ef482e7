"""SimHash near-duplicates by vantage-point trees over fingerprints.

Equal fingerprints collapse first, so copies cost one row.  Fingerprints that
differ in at most ``radius`` of 64 bits differ in at most one bit of one of
``radius // 2 + 1`` words, so there is one tree a word, with radius one.  A
vantage-point tree splits the distinct fingerprints into shards by the Hamming
distance of that word: inside a ball around the vantage point, or outside.  A
fingerprint lives in one shard of each tree and is also sent, as a visitor, to every shard inside a ball that it lies outside of by no
more than the radius; by the triangle inequality no other shard can hold a
neighbour.  A shard searches its residents by rings around further vantage
points, again pruned by the triangle inequality, and compares what is left on
all 64 bits.  It returns a spanning forest of its links, not the links, so a
group of near copies costs one row a member.

One tree over whole fingerprints sends far more visitors: the distances of
unrelated fingerprints to a vantage point lie within 32 +- 4, so most are near
any ball's edge at radius 4.

Sixty-four bits of shingles cannot tell a similarity of 0.8: such pairs differ
in ten bits, give or take three.  Where a similarity is asked for, the trees
search fingerprints of the sets of words, which change far less than shingles
do, within ``WORD_RADIUS`` bits; a pair is a candidate if its ``SIGNATURE * 64``-bit
SimHashes of shingles are no further apart than that similarity makes them.  Of
the candidates a shard returns a minimum spanning forest by signature distance,
which joins at every distance by signature what all pairs join; its edges are
then checked exactly, on the shingles of the two texts.

That search is quick but loses pairs: word sets may differ more than the radius,
and a forest's edge that fails the check may stand in place of one that holds.
So a prefix join follows, which loses none.  Two sets of the similarity share one
of their first ``n - ceil(similarity * n) + 1`` shingles in any common order; the
order is rare before frequent (counted on a sample, which changes no result).
Pairs that share such a shingle, are not in one component yet, and may still
reach the similarity by their sizes, some parities of their sets and the
shingle's places in both prefixes are candidates too.  Of all candidates those are checked on their texts that the
other parities leave open.  Links are then all pairs of the similarity,
up to what connects them; links by radius alone are exact as well.

The trees themselves are built on the driver from a bounded sample of fingerprints
(``SAMPLE`` a shard, at most ``2 ** MAX_DEPTH`` shards a tree); the sample only shapes
the shards and changes no result.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle; rows with equal texts share
a component; a null id takes part in links but never names a component unless
no member has an id; extra columns pass through; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.graph import connected_components
from orrery.storage import stage

SHARD = 8192
SAMPLE = 64
MAX_DEPTH = 12
WORD_RADIUS = 9
SIGNATURE = 4
SLACK = 2.0  # standard deviations of a signature's distance
COUNTED = 20_000  # documents on which the frequency of shingles is counted
FREQUENT = 1 << 16  # shingles at most whose frequency orders prefixes
BUCKET = 1 << 18  # prefix rows of a group
ODD = 1024  # parities of a set
PAIRS = 512  # pairs that a group checks
WIDE = 64  # rows that share a shingle, beyond which the largest component's are not paired with each other
SEED = 42
BLOCK = 1 << 21
CHUNK = 1 << 15


def word_list(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[k : k + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter than a shingle."""
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64) if parts else np.zeros(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size)
    starts, ends = (ends - size)[: len(parts) - words + 1], ends[words - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    found = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), CHUNK):
        cut = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True)
        found[k : k + CHUNK] = [digest(line[a:b], SEED) for a, b in cut]
    return found


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the word shingles of a text; zero without words."""
    return majority(shingle_hashes(word_list(text), words))


def word_fingerprint(parts: list[bytes]) -> int:
    """64-bit SimHash of the set of words."""
    return majority(np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(parts)], np.uint64))


def signature(hashes: np.ndarray) -> list[int]:
    """SimHashes of the set of shingles under ``SIGNATURE`` mixings of their hashes."""
    found = []
    hashes = np.unique(hashes)
    for k in range(SIGNATURE):
        h = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        found.append(majority(h ^ (h >> np.uint64(31))))
    return found


def signature_limit(similarity: float) -> int:
    """Bits by which signatures of sets of this Jaccard similarity differ, and ``SLACK`` deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * SIGNATURE
    return round(bits * share + SLACK * (bits * share * (1 - share)) ** 0.5)


SIGNS = [f"s{k}" for k in range(SIGNATURE)]


def set_node(hashes: np.ndarray) -> int:
    """Name of a set of shingles, as a signed integer; zero for the empty set."""
    return int(np.array(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED), np.uint64).view(np.int64)) if len(hashes) else 0


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(id, text_hash, node, fp)`` for every row; the node is the fingerprint."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fp"] = np.array([fingerprint(t, words) for t in b.pop("text")], np.int64)
            b["node"] = b["fp"]
            yield b

    return _narrow(docs, id_col, text_col).mapInPandas(run, f"{_row_kind(docs, id_col)}, fp long, node long")


def with_sets(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(id, text_hash, node)`` for every row; the node names its set of shingles.

    The first row of a node in a task also has the fingerprint ``fp`` of its set of words, and the signature, the size
    ``n``, the ``parities`` and the prefix of its set of shingles, in the order of ``common`` (see ``frequent_shingles``).
    """
    often, counts = common
    names = ["fp", *SIGNS, "n"]

    def describe(parts: list[bytes], hashes: np.ndarray) -> tuple:
        seen = np.zeros(len(hashes), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
            seen = np.where(often[at] == hashes, counts[at], 0)
        size = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
        prefix = hashes[np.lexsort((hashes, seen))[:size]].view(np.int64)
        return word_fingerprint(parts), *signature(hashes), len(hashes), parities(hashes), prefix

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            nodes, rows = [], []
            for text in b.column("text").to_pylist():
                parts = word_list(text)
                hashes = np.unique(shingle_hashes(parts, words))
                nodes.append(set_node(hashes))
                rows.append((None,) * (len(names) + 2) if nodes[-1] in known else describe(parts, hashes))
                known.add(nodes[-1])
            *numbers, odd, prefix = zip(*rows, strict=True) if rows else [()] * (len(names) + 2)
            found = [pa.array(c, pa.int64()) for c in (nodes, *numbers)] + [pa.array(c, pa.list_(pa.int64())) for c in (odd, prefix)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), *found], ["id", "text_hash", "node", *names, "odd", "prefix"])

    kinds = ", ".join(f"{c} long" for c in ("node", *names)) + ", odd array<long>, prefix array<long>"
    return _narrow(docs, id_col, text_col).mapInArrow(run, f"{_row_kind(docs, id_col)}, {kinds}")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _row_kind(docs: DataFrame, id_col: str) -> str:
    return f"id {docs.schema[id_col].dataType.simpleString()}, text_hash long"


class Tree:
    """Balls in heap order: node k has children 2k+1 (inside) and 2k+2 (outside); the leaves are shards."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = 1):
        self.depth, self.radius = depth, radius
        self.center = np.zeros(2**depth - 1, np.uint64)
        self.reach = np.full(2**depth - 1, 8, np.int64)
        draw = np.random.default_rng(SEED)
        own = {0: sample}
        for k in range(2**depth - 1):
            points = own.pop(k)
            if len(points):
                trial = draw.choice(points, min(8, len(points)), replace=False)
                far = [np.bitwise_count(points ^ v) for v in trial]
                best = int(np.argmax([d.std() for d in far]))
                self.center[k], self.reach[k] = trial[best], int(np.median(far[best]))
            inside = np.bitwise_count(points ^ self.center[k]) <= self.reach[k]
            own[2 * k + 1], own[2 * k + 2] = points[inside], points[~inside]

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, residents, visitors) as positions in ``fps``."""
        first = 2**self.depth - 1
        work = [(0, np.arange(len(fps)), np.arange(0))]
        while work:
            k, live, come = work.pop()
            if k >= first:
                if len(live) or len(come):
                    yield k - first, live, come
                continue
            a, b = (np.bitwise_count(fps[x] ^ self.center[k]).astype(np.int64) for x in (live, come))
            near, mu = self.radius, self.reach[k]
            out = a > mu
            work.append((2 * k + 1, live[~out], np.concatenate([come[b <= mu + near], live[out & (a <= mu + near)]])))
            work.append((2 * k + 2, live[out], come[b >= mu + 1 - near]))


class Forest:
    """Disjoint sets over positions, united by arrays of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                return r
            r = nxt

    def spanning(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Unite pairs from light to heavy; which of them were needed."""
        used = []
        for level in np.unique(weight):
            left = np.flatnonzero(weight == level)
            while True:
                a, b = self.root(x[left]), self.root(y[left])
                open_ = a != b
                if not open_.any():
                    break
                left, a, b = left[open_], a[open_], b[open_]
                high, first = np.unique(np.maximum(a, b), return_index=True)  # each root is hung once, under a smaller one
                self.up[high] = np.minimum(a, b)[first]
                used.append(left[first])
        return np.concatenate(used) if used else np.zeros(0, np.int64)

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root(x), self.root(y)
            open_ = a != b
            if not open_.any():
                return
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def word_of(fps: np.ndarray, k: int, words: int) -> np.ndarray:
    """The k-th of ``words`` words of the fingerprints."""
    low, high = 64 * k // words, 64 * (k + 1) // words
    return (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


class Shard:
    """Fingerprints of a shard, the word its tree is about, and the links found."""

    def __init__(self, fps: np.ndarray, words: np.ndarray, signs: np.ndarray | None, radius: int, limit: int):
        self.fps, self.words, self.signs, self.radius, self.limit = fps, words, signs, radius, limit
        self.found = Forest(len(fps))
        self.edges = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def search(self, live: np.ndarray, other: np.ndarray, levels: int = 5) -> None:
        """Unite every resident in ``live`` with its neighbours in ``other`` (positions) whose words are near too."""
        if levels and len(live) > 32 and len(live) * len(other) > BLOCK // 16:
            center = self.words[live[len(live) // 2]]
            a = np.bitwise_count(self.words[live] ^ center)
            b = np.bitwise_count(self.words[other] ^ center).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, other = b[order], other[order]
            for ring in np.unique(a):
                lo, hi = np.searchsorted(b, (int(ring) - 1, int(ring) + 2))
                if hi > lo:
                    self.search(live[a == ring], other[lo:hi], levels - 1)
            return
        step = max(1, BLOCK // max(1, len(other)))
        right = self.fps[other]
        for k in range(0, len(live), step):
            x, y = np.nonzero(np.bitwise_count(self.fps[live[k : k + step], None] ^ right[None, :]) <= self.radius)
            x, y = live[k + x], other[y]
            for part in range(0, len(x), BLOCK):
                self.link(x[part : part + BLOCK], y[part : part + BLOCK])

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = x != y
        x, y = x[apart], y[apart]
        if self.signs is None:
            self.found.unite(x, y)
            return
        far = np.bitwise_count(self.signs[x] ^ self.signs[y]).sum(axis=1, dtype=np.int64)
        near = far <= self.limit
        if near.any():
            self.fresh.append((x[near], y[near], far[near]))
            if sum(len(f[0]) for f in self.fresh) > BLOCK:
                self._span()

    def _span(self) -> None:
        """Keep the minimum spanning forest of the edges so far."""
        x, y, far = (np.concatenate(c) for c in zip(self.edges, *self.fresh, strict=True))
        used = Forest(len(self.fps)).spanning(x, y, far)
        self.edges, self.fresh = (x[used], y[used], far[used]), []

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges (positions) of a spanning forest of the links."""
        if self.signs is not None:
            self._span()
            return self.edges[0], self.edges[1]
        every = np.arange(len(self.fps))
        top = self.found.root(every)
        return every[top != every], top[top != every]


def fingerprint_links(rows: DataFrame, radius: int, limit: int | None = None) -> DataFrame:
    """Spanning edges ``(a, b)`` over the nodes of rows ``(node, fp, signature if there is a limit)``.

    Nodes are connected as all pairs within ``radius``, and within ``limit`` by signature, connect them.
    """
    n = rows.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD)))))
    every = max(1, n // (SAMPLE << depth))
    drawn = rows.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toPandas()["fp"] if depth else []
    sample = np.sort(np.array(drawn, np.int64)).view(np.uint64)
    words = radius // 2 + 1
    trees = [Tree(word_of(sample, k, words), depth) for k in range(words)]
    names = ["node", "fp", *(SIGNS if limit is not None else [])]

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["fp"].to_numpy(np.int64).view(np.uint64)
            for k, tree in enumerate(trees):
                for shard, live, come in tree.route(word_of(keys, k, words)):
                    sent = b.iloc[np.concatenate([live, come])].copy()
                    sent.insert(0, "shard", np.int32((k << depth) + shard))
                    sent["home"] = np.arange(len(sent)) < len(live)
                    yield sent

    def link(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["fp"].to_numpy(np.int64).view(np.uint64)
        own = word_of(keys, int(group["shard"].iloc[0]) >> depth, words)
        signs = group[SIGNS].to_numpy(np.int64).view(np.uint64) if limit is not None else None
        shard = Shard(keys, own, signs, radius, limit or 0)
        home = group["home"].to_numpy(bool)
        live, come = np.flatnonzero(home), np.flatnonzero(~home)
        shard.search(live, live)
        shard.search(live, come)
        a, b = shard.forest()
        nodes = group["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    kinds = "shard int, " + ", ".join(f"{c} long" for c in names) + ", home boolean"
    return rows.select(*names).mapInPandas(route, kinds).groupBy("shard").applyInPandas(link, "a long, b long")


def texts_sets(texts: pd.Series, words: int, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Node and sorted set of shingles of the texts whose node is not in ``seen`` yet."""
    for text in texts:
        hashes = np.unique(shingle_hashes(word_list(text), words))
        node = set_node(hashes)
        if node not in seen:
            seen.add(node)
            yield node, hashes


def possible(links: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Distinct links whose sets may have the similarity by their sizes and parities."""
    links = stage(links.distinct(), "candidates")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = marks.filter("n IS NOT NULL").join(ends, "node", "left_semi").select("node", "n", "odd")
    sets = stage(sets.dropDuplicates(["node"]), "parities")
    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in ("a", "b"))
    bits = F.aggregate(F.zip_with("oa", "ob", lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda t, v: t + F.bit_count(v))
    size = F.col("na") + F.col("nb")
    shared = F.ceil(similarity / (1 + similarity) * size - 1e-9)  # members that the similarity needs in common
    fits = (F.least("na", "nb") >= shared) & (bits <= size - 2 * shared)
    return links.join(left, "a").join(right, "b").filter(fits).select("a", "b")


def check_links(
    links: DataFrame, each: DataFrame, marks: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float
) -> DataFrame:
    """The links whose texts' sets of shingles have at least this Jaccard similarity.

    Links that sizes and parities leave open are dealt into groups of about ``PAIRS`` by their first node, those of a
    node with many links into several; a group gets the texts of its nodes, which are shorter than their sets.
    """
    links = stage(possible(links, marks, similarity), "possible")
    degree = links.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("many"))
    deal = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("many")))
    links = stage(links.join(degree, "a").select("a", "b", F.pmod(deal, F.lit(links.count() // PAIRS + 1)).alias("bucket")), "dealt")
    ends = links.select("bucket", F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(ends.join(each.select("node", "least", "text_hash"), "node"), "wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    same = F.col("id").eqNullSafe(F.col("least")) & (F.xxhash64("text") == F.col("text_hash"))
    texts = texts.join(wanted, same).select("bucket", "text")

    def check(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        sets = dict(texts_sets(texts["text"], words, set()))
        kept = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            # 1e-9: a product such as 0.7 * 10 may lie above the whole number that it stands for
            kept.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pairs.loc[np.array(kept, bool), ["a", "b"]]

    return texts.groupBy("bucket").cogroup(links.groupBy("bucket")).applyInPandas(check, "a long, b long")


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts in a sample, sorted, and in how many."""
    every = max(1, texts.count() // COUNTED)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, hashes in texts_sets(b["text"], words, set()):
                yield pd.DataFrame({"shingle": hashes.view(np.int64)})

    drawn = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = drawn.mapInPandas(run, "shingle long").groupBy("shingle").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toPandas()
    keys, n = found["shingle"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bit k of ``ODD`` tells whether an odd number of hashes end in k; two sets differ in at least as many members as in these bits."""
    odd = np.bincount((hashes & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_pairs(group: pd.DataFrame, similarity: float) -> np.ndarray:
    """Pairs of nodes that share a key, lie in different components and may have the similarity."""
    group = group.drop_duplicates(["key", "node"]).sort_values(["key", "component"], kind="stable")
    key, node, part, n, pos = (group[c].to_numpy() for c in ("key", "node", "component", "n", "pos"))
    words = [group[c].to_numpy(np.int64).view(np.uint64) for c in ("even", "odd")]  # bits of signed integers are counted without the sign
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    mixed = part[starts] != part[ends - 1]
    starts, ends = starts[mixed], ends[mixed]
    found = [np.zeros((0, 2), np.int64)]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        for k in range(0, len(x), BLOCK):
            a, b = x[k : k + BLOCK], y[k : k + BLOCK]
            size = n[a] + n[b]
            least = np.ceil(similarity / (1 + similarity) * size - 1e-9)  # shared shingles that the similarity needs
            ok = (part[a] != part[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least)
            a, b = a[ok], b[ok]
            bits = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)
            ok = bits <= size[ok] - 2 * least[ok]
            a, b = node[a[ok]], node[b[ok]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))

    wide = ends - starts > WIDE
    for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
        _, first, count = np.unique(part[lo:hi], return_index=True, return_counts=True)
        big = int(np.argmax(count))
        every = np.arange(lo, hi)
        rest = np.r_[every[: first[big]], every[first[big] + count[big] :]]
        step = max(1, BLOCK // len(every))
        for k in range(0, len(rest), step):
            some = rest[k : k + step]
            keep(np.repeat(some, len(every)), np.tile(every, len(some)))
    starts, ends = starts[~wide], ends[~wide]
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]) if len(starts) else np.zeros(0, np.int64)
    last = np.repeat(ends, ends - starts)
    for gap in range(1, WIDE):
        ok = rows + gap < last
        rows, last = rows[ok], last[ok]
        if not len(rows):
            break
        keep(rows, rows + gap)
    return np.unique(np.concatenate(found), axis=0)


def prefix_candidates(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: every pair of nodes of at least the similarity that ``groups`` do not join, and some others.

    Prefixes are dealt by key once.  Most keys are in one component only, and go no further than their task.
    """
    def folded(first: int) -> Column:
        """Parities of every second word as one word: still at most as many differ as members do."""
        words = [F.get("odd", F.lit(k)) for k in range(first, ODD // 64, 2)]
        return reduce(lambda x, y: x.bitwiseXOR(y), words)

    prefixes = sets.filter("prefix IS NOT NULL").select("node", "n", "prefix", folded(0).alias("even"), folded(1).alias("odd"))
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    named = prefixes.join(groups, "node", "left")
    rows = named.select("node", "component", "n", "even", "odd", F.posexplode("prefix").alias("pos", "key"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(total // BUCKET + 1)).cast("int")).repartition("bucket")
    # the component travels only where it is not the node itself; buckets keep whole keys, so the window moves nothing
    rows, own = rows.withColumn("component", F.coalesce("component", "node")), W.partitionBy("bucket", "key")
    rows = rows.withColumns({"low": F.min("component").over(own), "high": F.max("component").over(own)}).filter("low <> high")

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(prefix_pairs(group, similarity), columns=["a", "b"])

    return rows.select("bucket", "key", "node", "component", "n", "pos", "even", "odd").groupBy("bucket").applyInPandas(pairs, "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """``(id, text_hash, node)`` for every row, and ``(node, fp, root)`` for every node, both written."""
    if similarity is None:
        marks = stage(with_fingerprints(docs, id_col, text_col, words), "fingerprints")
        each = stage(marks.groupBy("node", "fp").agg(F.min("id").alias("least")), "distinct")
        links = fingerprint_links(each, radius)
    else:
        common = frequent_shingles(docs.select(F.col(text_col).alias("text")), words)
        marks = stage(with_sets(docs, id_col, text_col, words, similarity, common), "sets")
        row = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash")
        each = marks.groupBy("node").agg(*[F.max(c).alias(c) for c in ("fp", *SIGNS)], F.min(row).alias("row"))
        each = stage(each.select("node", "fp", *SIGNS, F.col("row.id").alias("least"), "row.text_hash"), "distinct")
        links = fingerprint_links(each, radius, signature_limit(similarity))
        links = check_links(links, each, marks, docs, id_col, text_col, words, similarity)
        known = stage(connected_components(links, "a", "b"), "known")
        more = check_links(prefix_candidates(marks, known, similarity), each, marks, docs, id_col, text_col, words, similarity)
        links = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    groups = connected_components(links, "a", "b")
    roots = each.join(groups, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("root"), "least")
    return marks.select("id", "text_hash", "node"), stage(roots, "roots")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    similarity: float | None = None,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row; the component is named by its smallest id.

    With a ``similarity``, pairs link by the Jaccard similarity of their sets of shingles of ``words`` words, and
    ``radius`` is that of the fingerprints of their sets of words.
    """
    marks, roots = grouped(docs, id_col, text_col, words, radius, similarity)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stage(roots.join(least, "root").select("node", "fp", "component_id"), "components")
    return marks.join(names, "node").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, one a component: that of its smallest id, and among rows of that id the least hash of the text.

    Rows of one id with texts of different components all stay; a row without an id stays only where no row of its
    component has an id. Of rows with equal id and text any one stays.
    """
    marks, roots = grouped(docs, id_col, text_col, words, WORD_RADIUS, similarity)
    rows = marks.groupBy("id", "text_hash", "node").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash", "n")
    keep = rows.join(roots.select("node", "root"), "node").groupBy("root").agg(F.min(order).alias("m"))
    keep = stage(keep.select(F.col("m.id").alias("__id"), F.col("m.text_hash").alias("__hash"), F.col("m.n").alias("__n")), "kept")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    one = docs.join(keep.filter("__n = 1"), same, "left_semi")
    several = docs.join(keep.filter("__n > 1"), same).dropDuplicates(["__id", "__hash"])
    return one.unionByName(several.select(*docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: fingerprint and component of every row; nulls, empties, ties and repeats as the module says."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
