"""Counts over one whole text, shared by the quality operators."""

from __future__ import annotations

import numpy as np

# White space between words, and the characters counted as symbols.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_windows(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many places lie in windows of ``width`` ids that occur twice or more, the first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * _MULTIPLIER + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0  # equal windows have equal hashes
    name, span = ids.astype(np.int64), 1
    while span < width:  # exact names of windows of 2, 4 and 8 ids
        pairs = name[: len(name) - span] * (int(name.max()) + 1) + name[span:]
        _, name = np.unique(pairs, return_inverse=True)
        span *= 2
    counts = np.bincount(name)
    starts = np.flatnonzero(counts[name] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def basic_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null counts as no text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits bytes at the six ASCII white-space characters only
    chars = len(text) - sum(map(text.count, SPACES)) if words else 0
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                repeats += 1
            seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    # a word can only repeat a window if words repeat at all
    repeat_words = repeated_windows(ids) if len(words) - len(index) >= WINDOW else 0
    return len(words), chars, symbols, repeats, repeat_words
