"""Blocks of token ids under an adaptive context-mixing range coder.

A block codes its ids in lanes: contiguous runs of ``STEPS`` ids that advance
together, one id a lane and step, so that numpy codes a column of lanes at
once.  All lanes of a block share one model, which learns from each column
after it is coded; the decoder repeats this.  Nothing is shared by blocks.

The model mixes three predictions of the next id: order 2 and order 1 (the id
that last followed the same two ids, or one id, with a confidence) and order 0
(counts of ids, turned into frequencies at geometric intervals).  The first two
get the share of the range that their confidence has earned so far in this
block; order 0 gets the rest, and is never left without.  The shares of order 2
and order 1 lie before that of order 0, so an id is found without a search; an
id that both could code takes the first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

STEPS = 256
BLOCK_IDS = 1 << 21
MAGIC = b"OIB2"
HEAD = "<4sIIQII"
HEAD_SIZE = struct.calcsize(HEAD)
TOTAL_BITS, MIX_BITS = 20, 8
TOTAL, MIX = 1 << TOTAL_BITS, 1 << MIX_BITS
RANGE_BITS = TOTAL_BITS + MIX_BITS
TABLE_BITS = 18
CONFIDENCE = 8
COUNT_EVERY = 4  # steps between counts of how the predictions do
U = np.uint64
WORD = U(32)
FLOOR = U(1 << 32)
#: Confidence after a miss (first half) and after a hit.
NEXT_CONFIDENCE = np.array([*(max(c - 1, 0) for c in range(CONFIDENCE)), *(min(c + 1, CONFIDENCE - 1) for c in range(CONFIDENCE))], np.int32)


class Model:
    """Order-0 to order-2 statistics of one block."""

    def __init__(self, vocab: int, decoding: bool = False):
        self.decoding = decoding
        if not 0 < vocab <= TOTAL // 2:
            raise ValueError(f"vocabulary of {vocab} ids")
        self.vocab = vocab
        self.counts = np.zeros(vocab, np.int64)
        self.fresh: list[np.ndarray] = []
        self.steps = 0
        self.due = 1
        self.after1 = np.zeros(vocab + 1, np.int32)  # id that followed and 1, times CONFIDENCE, and the confidence
        self.after2 = np.zeros(1 << TABLE_BITS, np.int32)
        self.hits = np.full((2, CONFIDENCE), 0.5)
        self.tries = np.full((2, CONFIDENCE), 2.0)
        self.share = (self.hits / self.tries * (MIX - 2)).astype(np.int32)
        self._refresh()

    def _refresh(self) -> None:
        """Frequencies of order 0 from the counts so far, each id at least 1."""
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.vocab)
            self.fresh.clear()
        spare = TOTAL - self.vocab
        seen = int(self.counts.sum())
        freq = 1 + (self.counts * spare // seen if seen else np.full(self.vocab, spare // self.vocab))
        freq[0] += TOTAL - freq.sum()
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.int32)
        self.freq = freq.astype(np.int32)
        self.of = np.repeat(np.arange(self.vocab, dtype=np.int32), freq) if self.decoding else None

    def predict(self, a: np.ndarray, b: np.ndarray) -> None:
        """Set the lanes' predictions and shares. a, b: ids two and one back."""
        self.slot = ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << TABLE_BITS) - 1)
        self.b = b
        e2, e1 = self.after2.take(self.slot), self.after1.take(b)
        self.p2, self.p1 = (e2 >> 3) - 1, (e1 >> 3) - 1
        self.c2, self.c1 = e2 & 7, e1 & 7
        m2 = self.share[0].take(self.c2) * (self.p2 >= 0)
        self.ask1 = (self.p1 >= 0) & (self.p1 != self.p2)
        m1 = ((MIX - m2) * self.share[1].take(self.c1) >> MIX_BITS) * self.ask1
        self.m0 = MIX - m2 - m1
        self.w2 = m2 << TOTAL_BITS
        self.w1 = m1 << TOTAL_BITS
        self.w = self.w2 + self.w1

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids ``s``."""
        self.hit2 = (self.p2 == s) & (self.w2 > 0)
        self.hit1 = (self.p1 == s) & (self.w1 > 0)
        start = np.where(self.hit2, 0, np.where(self.hit1, self.w2, self.w + self.m0 * self.cum.take(s)))
        width = np.where(self.hit2, self.w2, np.where(self.hit1, self.w1, self.m0 * self.freq.take(s)))
        return start, width

    def symbol(self, x: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold ``x``."""
        plain = self.of.take(np.maximum(x - self.w, 0) // self.m0)
        return np.where(x < self.w2, self.p2, np.where(x < self.w, self.p1, plain)).astype(np.int64)

    def learn(self, s: np.ndarray) -> None:
        s32 = s.astype(np.int32) + 1
        hit2, hit1 = self.p2 == s, self.p1 == s
        if self.steps % COUNT_EVERY == 0:
            ask = ((self.p2 >= 0, hit2), (self.ask1 & ~hit2, hit1))  # order 1 is asked where order 2 has failed
            for k, (c, (ok, hit)) in enumerate(zip((self.c2, self.c1), ask, strict=True)):
                self.tries[k] += np.bincount(c[ok], minlength=CONFIDENCE)
                self.hits[k] += np.bincount(c[ok & hit], minlength=CONFIDENCE)
            self.share = (self.hits / self.tries * (MIX - 2)).astype(np.int32)
        tables = ((self.after2, self.slot, self.p2, self.c2, hit2), (self.after1, self.b, self.p1, self.c1, hit1))
        for after, at, p, c, hit in tables:
            sure = NEXT_CONFIDENCE.take(c + (hit.view(np.int8) << 3))
            after[at] = np.where(hit | (c > 0), p + 1, s32) << 3 | sure  # of lanes with one context the last counts
        self.fresh.append(s)
        self.steps += 1
        if self.steps == self.due:
            self._refresh()
            self.due += max(1, self.due // 3)


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose upper word is settled, or whose span is so short that it has to be."""
    return np.flatnonzero(((low ^ (low + span)) < FLOOR) | (span < FLOOR))


def _shifted(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and span after their upper word is gone; a short span is cut where that word would change."""
    cut = (low ^ (low + span)) >= FLOOR
    span = np.where(cut, (~low + U(1)) & (FLOOR - U(1)), span)
    return low << WORD, span << WORD


def encode_ids(ids: np.ndarray, vocab: int) -> bytes:
    """Lanes' word counts, then their words."""
    n = len(ids)
    lanes = -(-n // STEPS)
    if not n:
        return b""
    grid = np.zeros(lanes * STEPS, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    last = n - (lanes - 1) * STEPS
    model = Model(vocab)
    low, span = np.zeros(lanes, U), np.full(lanes, U(2**64 - 1), U)
    a = b = np.full(lanes, vocab, np.int64)
    out_lane, out_word = [], []
    for t in range(STEPS if lanes > 1 else last):
        k = lanes if t < last else lanes - 1
        s = grid[t, :k]
        model.predict(a[:k], b[:k])
        start, width = model.interval(s)
        unit = span[:k] >> U(RANGE_BITS)
        low[:k] += start.astype(U) * unit
        span[:k] = width.astype(U) * unit
        live = _settled(low[:k], span[:k])
        while len(live):
            lo = low[live]
            out_lane.append(live)
            out_word.append((lo >> WORD).astype(np.uint32))
            low[live], span[live] = _shifted(lo, span[live])
            live = live[_settled(low[live], span[live])]
        model.learn(s)
        a, b = b, np.concatenate([s, b[k:]])
    out_lane.append(np.arange(lanes))
    out_word.append(((low + FLOOR - U(1)) >> WORD).astype(np.uint32))  # the span is at least FLOOR: one word ends a lane
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane.astype(np.uint16 if lanes < 1 << 16 else np.int64), kind="stable")
    return np.bincount(lane, minlength=lanes).astype("<u2").tobytes() + word[order].astype("<u4").tobytes()


def decode_ids(data: bytes, n: int, vocab: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    lanes = -(-n // STEPS)
    size = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u4", offset=2 * lanes).astype(np.uint64), np.zeros(2, np.uint64)])
    ends = np.cumsum(size)
    at = ends - size

    def take(live: np.ndarray) -> np.ndarray:
        got = np.where(at[live] < ends[live], words[np.minimum(at[live], len(words) - 1)], U(0))
        at[live] += 1
        return got

    every = np.arange(lanes)
    code = np.zeros(lanes, U)
    for _ in range(2):
        code = code << WORD | take(every)
    last = n - (lanes - 1) * STEPS
    grid = np.zeros((STEPS, lanes), np.int64)
    model = Model(vocab, decoding=True)
    low, span = np.zeros(lanes, U), np.full(lanes, U(2**64 - 1), U)
    a = b = np.full(lanes, vocab, np.int64)
    for t in range(STEPS if lanes > 1 else last):
        k = lanes if t < last else lanes - 1
        model.predict(a[:k], b[:k])
        unit = span[:k] >> U(RANGE_BITS)
        x = np.minimum((code[:k] - low[:k]) // unit, U((1 << RANGE_BITS) - 1)).astype(np.int32)
        s = model.symbol(x)
        start, width = model.interval(s)
        low[:k] += start.astype(U) * unit
        span[:k] = width.astype(U) * unit
        live = _settled(low[:k], span[:k])
        while len(live):
            low[live], span[live] = _shifted(low[live], span[live])
            code[live] = code[live] << WORD | take(live)
            live = live[_settled(low[live], span[live])]
        model.learn(s)
        grid[t, :k] = s
        a, b = b, np.concatenate([s, b[k:]])
    return grid.T.reshape(-1)[:n]


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocab: int) -> bytes:
    """One self-contained block: header, documents' ids and lengths, coded token ids; a checksum of it all."""
    known = np.array([d is not None for d in doc_ids], bool)
    index = np.packbits(known).tobytes()
    index += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
    index = zlib.compress(index, 1)
    body = index + encode_ids(ids, vocab)
    check = zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(index))
    return struct.pack(HEAD, MAGIC, vocab, len(doc_ids), len(ids), len(index), check) + body


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their lengths, and all token ids. A damaged block is an error."""
    magic, vocab, docs, n, size, check = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    packed = block[HEAD_SIZE : HEAD_SIZE + size]
    index = zlib.decompress(packed)
    bits = -(-docs // 8)
    known = np.unpackbits(np.frombuffer(index, np.uint8, bits), count=docs).astype(bool)
    ids = np.frombuffer(index, "<i8", docs, bits)
    lengths = np.frombuffer(index, "<u4", docs, bits + 8 * docs).astype(np.int64)
    tokens = decode_ids(block[HEAD_SIZE + size :], n, vocab)
    if zlib.crc32(tokens.astype("<u4").tobytes(), zlib.crc32(packed)) != check:
        raise ValueError("checksum of a block of token ids differs")
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths, tokens
