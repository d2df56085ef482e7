"""Token ids of whole texts by a public tokenizer, with a cache of encoded words.

Both tokenizers cut a text at white space before they merge symbols, so the ids
of a text are the ids of its words in order.  Words repeat far more than texts
do: Arrow cuts a batch of texts and names its distinct words, each of these is
encoded once a worker by the tokenizers library, and the texts become one
gather over the ids of their words.

The ids are those of the library's plain call, so the string of a special token
in a text becomes that token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from tokenizers import Tokenizer

from orrery.workers import per_worker

# White space as Unicode defines it; Python's \s also takes four control characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words a worker keeps; all are dropped when there are more.
KEEP = 600_000
SPACE_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # the same, as Arrow writes it
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"  # of ASCII, but the apostrophe, with which contractions begin
#: Bytes of text that are cut into words at once.
CHUNK = 1 << 22


class _Index(dict):
    """Positions of words; a new word gets the next one and waits to be encoded."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Ids of texts under the tokenizer in ``path``; ``spaced`` if a word's leading white space is part of its ids.

    With ``spaced`` a word is kept without the single space that leads it, and a word that no space leads with a space
    before it.  A word of plain letters and marks after them is kept in two parts, as the tokenizer cuts it there too.
    """

    keep = KEEP

    def __init__(self, path: str, spaced: bool):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.spaced = spaced
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.blank = re.compile(f"[{SPACE}]").match
        self.parts = f"^(?P<core>[{LETTERS}]+)(?P<mark>[{MARKS}]*)$"
        self.plain = re.compile(f" ?[{LETTERS}]+").fullmatch
        self.bytes = self._byte_names()
        self.lead = self.bytes[ord(" ")]
        self.newline = self.whole.encode("\n", add_special_tokens=False).ids
        self._reset()

    @staticmethod
    def _byte_names() -> dict[int, str]:
        """The printable character by which byte-level vocabularies name each byte, as a table for translate()."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in shown}
        return names | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in names)}

    def _reset(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int32)
        self.count = np.zeros(1 << 14, np.int32)
        self.used = self.known = 0

    def _encode(self, word: str) -> list[int]:
        """Ids of a word as it is kept; one of plain letters is one piece for the model, no normaliser or splitter needed."""
        if self.spaced:
            word = word[1:] if word[:1] == " " else " " + word
        if self.plain(word) is None:
            return self.whole.encode(word, add_special_tokens=False).ids
        lead, named = ("", word) if word[0] != " " else (self.lead, word[1:])
        if not self.spaced:
            named = named.lower()
        if not named.isascii():  # letters of ASCII name themselves
            named = named.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(lead + named)]

    def _learn(self) -> None:
        fresh = self.index.fresh
        if not fresh:
            return
        while self.known + len(fresh) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        ids = list(map(self._encode, fresh))
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        more = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(more)] = more
        self.start[self.known : self.known + len(ids)] = self.used + np.cumsum(size) - size
        self.count[self.known : self.known + len(ids)] = size
        self.used += len(more)
        self.known += len(ids)
        fresh.clear()

    def _look(self, words: list[str]) -> np.ndarray:
        """Positions of words in the cache; words that it lacks are encoded."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        self._learn()
        return at

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *[ids for _, ids, _ in self.encode_parts(pa.array([text], pa.string()))]])

    def encode_parts(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts of about ``CHUNK`` bytes: first row, ids of its texts in a row, and how many each text has.

        ``end_id``, if given, follows each text's own ids.
        """
        texts = pc.fill_null(texts, "")
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(texts):
            begin = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
            ids, size = self._encode_some(texts.slice(at, to - at))
            if end_id is not None:
                ids, size = np.insert(ids, np.cumsum(size), end_id), size + 1
            yield at, ids, size
            at = to

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.keep:
            self._reset()
        lines, n_lines = self._lines(texts)
        lists = pc.split_pattern(lines, " ") if self.spaced else pc.ascii_split_whitespace(lines)
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()  # each distinct word is looked at once
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cores, marks = self._cut(coded.dictionary)
        core_at, mark_at = self._look(cores.to_pylist()), self._look_coded(marks)
        if not self.spaced:
            ids, size = _gathered(*_joined(self.flat, self.start, self.count, core_at, mark_at), codes)
            return ids, _summed(size, n_words)
        starts = np.cumsum(n_words) - n_words
        heads, which = np.unique(codes[starts], return_inverse=True)  # words that no space leads
        head_at = self._look([" " + w for w in cores.take(pa.array(heads)).to_pylist()])
        codes = codes.copy()
        codes[starts] = len(core_at) + which
        loose = self._loose(coded.dictionary, codes, heads, starts, n_lines)
        table = _joined(self.flat, self.start, self.count, np.concatenate([core_at, head_at]), np.concatenate([mark_at, mark_at[heads]]))
        ids, size = _gathered(*table, codes)
        size = _summed(size, n_words)
        last = np.cumsum(n_lines) - 1
        inner = np.ones(len(size), bool)
        inner[last] = False
        ids = np.insert(ids, np.repeat(np.cumsum(size)[inner], len(self.newline)), self.newline * int(inner.sum()))
        size = _summed(size + inner * len(self.newline), n_lines)
        return self._with_loose(texts, loose, ids, size) if len(loose) else (ids, size)

    def _lines(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts cut at line ends where these are pieces of their own, and how many lines each text has."""
        if not self.spaced:
            return texts, np.ones(len(texts), np.int64)
        lists = pc.split_pattern(texts, "\n")
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def _cut(self, names: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without and with the marks after them; a word that is not plain stays whole."""
        found = pc.extract_regex(names, self.parts)
        core, mark = pc.struct_field(found, "core"), pc.struct_field(found, "mark")
        core = core if self.spaced else pc.utf8_lower(core)
        return pc.if_else(found.is_valid(), core, names), pc.if_else(found.is_valid(), mark, "")

    def _look_coded(self, marks: pa.Array) -> np.ndarray:
        coded = marks.dictionary_encode()
        lead = " " if self.spaced else ""
        return self._look([lead + m for m in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]

    def _loose(self, names: pa.Array, codes: np.ndarray, heads: np.ndarray, starts: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Texts with runs of white space: an empty word, one that ends in white space, or a line that starts with it."""
        ends_so = pc.match_substring_regex(names, f"^$|[{SPACE_RE2}]$").to_numpy(zero_copy_only=False)
        starts_so = pc.match_substring_regex(names.take(pa.array(heads)), f"^$|^[{SPACE_RE2}]|[{SPACE_RE2}]$").to_numpy(zero_copy_only=False)
        by_line = np.logical_or.reduceat(np.concatenate([ends_so, starts_so])[codes], starts)
        return np.flatnonzero(np.logical_or.reduceat(by_line, np.cumsum(n_lines) - n_lines))

    def _with_loose(self, texts: pa.Array, loose: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of ``loose`` texts put in their places, cut by the pattern."""
        ends = np.cumsum(size)
        parts, done = [], 0
        for k in loose.tolist():
            at = self._look([w[1:] if w[0] == " " != w[1:2] else " " + w for w in self.pieces(texts[k].as_py())])
            own, _ = _gathered(self.flat, self.start, self.count, at)
            parts += [ids[done : ends[k] - size[k]], own]
            done = ends[k]
            size[k] = len(own)
        return np.concatenate([*parts, ids[done:]]), size


def _gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``at`` of a table of runs, in a row, and their lengths."""
    size = count.take(at)
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat((start.take(at) - (ends - size)).astype(np.int32), size)
    where += np.arange(total, dtype=np.int32)
    return flat.take(where), size


def _joined(
    flat: np.ndarray, start: np.ndarray, count: np.ndarray, first: np.ndarray, second: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table whose entries are two entries each, one after the other."""
    ids, size = _gathered(flat, start, count, np.stack([first, second], axis=1).ravel())
    size = size.reshape(-1, 2).sum(axis=1, dtype=np.int32)
    return ids, (np.cumsum(size) - size).astype(np.int32), size


def _summed(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over runs of ``n`` values."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])])


class PieceEncoder(WordEncoder):
    """Ids of the words of texts under a sentencepiece model; white space between words is not counted."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spaced = False
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self._reset()

    def _encode(self, word: str) -> list[int]:
        return self.model.encode(word)

    def _cut(self, names: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Pieces may cross from letters to marks: words stay whole."""
        return names, pa.array([""] * len(names), pa.string())


def piece_encoder(path: str) -> PieceEncoder:
    return per_worker(f"pieces {path}", lambda: PieceEncoder(path))


def encoder(path: str, spaced: bool) -> WordEncoder:
    """This worker's encoder for the tokenizer in ``path``."""
    return per_worker(f"encoder {path} {spaced}", lambda: WordEncoder(path, spaced))
