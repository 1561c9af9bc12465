"""Word sequences as numbers, and alignments of two of them."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"\w+")


def local(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int, int, int]:
    """Smith-Waterman: score, item and text span [start, end) of the best local alignment, matched words.

    Words that are 0 match nothing. Among equals the first end in the item, then in the text, wins.
    """
    n, m = len(item), len(text)
    score = np.zeros((n + 1, m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -gap
    for i in range(1, n + 1):
        step = np.where((text == item[i - 1]) & (text != 0), match, mismatch)
        best = np.maximum(score[i - 1] + gap, 0)
        np.maximum(best[1:], score[i - 1, :-1] + step, out=best[1:])
        score[i] = np.maximum.accumulate(best + slope) - slope  # gaps along the text
    at = int(score.argmax())
    i, j = divmod(at, m + 1)
    top, end_i, end_j, hits = int(score[i, j]), i, j, 0
    while score[i, j] > 0:
        same = item[i - 1] == text[j - 1] and text[j - 1] != 0
        if i and j and score[i, j] == score[i - 1, j - 1] + (match if same else mismatch):
            i, j, hits = i - 1, j - 1, hits + same
        elif i and score[i, j] == score[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return top, i, end_i, j, end_j, int(hits)


def banded(item: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Aligns all of item with text where text position - item position stays within band of the diagonal.

    Returns matched words and the text span [start, end) from first to last match. A match counts
    one, gaps and mismatches nothing, so matches are the longest common subsequence in the band.
    """
    n, width = len(item), 2 * band + 1
    best = np.zeros((n + 1, width + 1), np.int32)  # column c of row i: text up to i + diagonal - band + c, exclusive
    padded = np.zeros(n + width + 1, text.dtype)
    low = diagonal - band
    a, b = max(0, low), min(len(text), low + n + width)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i in range(1, n + 1):
        hit = (padded[i - 1 : i - 1 + width] == item[i - 1]) & (item[i - 1] != 0)
        row = best[i]
        row[:width] = np.maximum(best[i - 1, :width] + hit, best[i - 1, 1 : width + 1])
        row[width] = row[width - 1]
        np.maximum.accumulate(row, out=row)
    total, c = int(best[n, width - 1]), width - 1
    i, first, last = n, 0, 0
    while i and best[i, c] > 0:
        while c and best[i, c - 1] == best[i, c]:
            c -= 1
        at = i - 1 + low + c
        if c < width and padded[i - 1 + c] == item[i - 1] and item[i - 1] != 0 and best[i, c] == best[i - 1, c] + 1:
            last = last or at + 1
            first = at
            i -= 1
        elif best[i - 1, min(c + 1, width)] == best[i, c]:
            i, c = i - 1, min(c + 1, width)
        else:
            i -= 1
    return total, first, last


def words_of(text: str) -> list[str]:
    """The words, each in lower case by itself: so many and where they stand in the text, whatever lower case does to lengths."""
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def spans_of(text: str) -> list[tuple[int, int]]:
    """Where the words begin and end."""
    return [m.span() for m in WORD.finditer(text)]


class Vocabulary:
    """Numbers, from 1, for the words of a few known texts; any other word is 0."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def learn(self, text: str) -> np.ndarray:
        return np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int64)

    def read(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)


def grams(words: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and numbers of all n-grams whose words are all known. base: over the largest number."""
    if len(words) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    count = len(words) - n + 1
    known = np.ones(count, bool)
    for i in range(n):
        known &= words[i : i + count] != 0
    at = np.flatnonzero(known)
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out * np.uint64(base) + words[at + i].astype(np.uint64)
    return at, out
