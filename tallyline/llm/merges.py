"""Byte-pair merges of one piece, lowest rank first and leftmost among equals."""

from __future__ import annotations

import heapq
from collections.abc import Callable


#: Longer pieces go through a queue, in O(n log n); for short ones a scan is quicker. Both give the same.
SHORT = 64
_NEVER = 1 << 62


def merged(symbols: list, rank: Callable[[object, int], int]) -> list:
    """Merges neighbours until none can be: rank(a + b, never) is the rank at which a and b merge, or never."""
    return scanned(symbols, rank) if len(symbols) <= SHORT else queued(symbols, rank)


def scanned(symbols: list, rank: Callable[[object, int], int]) -> list:
    symbols = list(symbols)
    ranks = [rank(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
    while ranks:
        lowest = min(ranks)
        if lowest == _NEVER:
            break
        i = ranks.index(lowest)
        whole = symbols[i] = symbols[i] + symbols.pop(i + 1)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank(whole + symbols[i + 1], _NEVER)
        if i:
            ranks[i - 1] = rank(symbols[i - 1] + whole, _NEVER)
    return symbols


def queued(symbols: list, rank: Callable[[object, int], int]) -> list:
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def consider(i: int, j: int) -> None:
        if (r := rank(symbols[i] + symbols[j], _NEVER)) != _NEVER:
            heapq.heappush(queue, (r, i, symbols[i], symbols[j]))

    for i in range(n - 1):
        consider(i, i + 1)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            consider(i, k)
        if before[i] >= 0:
            consider(before[i], i)
    return [s for s in symbols if s is not None]
