"""Text similarity for the crosswalk, scored a block of items at a time.

The scores follow the published definitions of the Indel ratio family: ``ratio`` is
the share of characters that survive an insert/delete edit, ``token_sort_ratio`` and
``token_set_ratio`` compare sorted or unique words, ``WRatio`` weighs them with their
best-window (partial) forms when lengths differ much. Spark hands each call a few keys
and one block of contract items; the longest common subsequences of a key with all
items of the block are found together, bit-parallel in 64-bit words.
"""

from __future__ import annotations

import numpy as np

# The published weights of WRatio.
TOKEN_WEIGHT = 0.95
PARTIAL_WEIGHT = 0.9
LONG_PARTIAL_WEIGHT = 0.6
PARTIAL_FROM = 1.5
LONG_FROM = 8.0

SCORERS = ("WRatio", "token_sort_ratio", "token_set_ratio", "ratio")
_WORD = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings of any length."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def share(common, total):
    """Similarity 0-100 from a common length and the summed lengths."""
    return 100.0 * (1.0 - (total - 2.0 * common) / total)


def pair_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return share(lcs_length(a, b), total) if total else 100.0


class Block:
    """Strings as one matrix of character numbers (0 pads), ready to compare with a key."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        width = int(self.size.max(initial=0))
        self.letter = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(texts))))}
        self.ids = np.zeros((len(texts), width), dtype=np.int32)
        for r, t in enumerate(texts):
            self.ids[r, : len(t)] = [self.letter[ch] for ch in t]
        # Positions of every letter in every text, as bits; long texts go one by one.
        self.masks = np.zeros((len(texts), len(self.letter) + 1), dtype=np.uint64)
        for r, t in enumerate(texts):
            if len(t) <= _WORD:
                for i, ch in enumerate(t):
                    self.masks[r, self.letter[ch]] |= np.uint64(1 << i)

    def key_masks(self, key: str) -> np.ndarray:
        out = np.zeros(len(self.letter) + 1, dtype=np.uint64)
        for i, ch in enumerate(key):
            at = self.letter.get(ch)
            if at:
                out[at] |= np.uint64(1 << i)
        return out

    def common(self, key: str) -> np.ndarray:
        """Common subsequence length of the key with every text."""
        if len(key) > _WORD:
            return np.array([lcs_length(key, t) for t in self.texts], dtype=np.int64)
        masks = self.key_masks(key)
        return _advance((masks[self.ids[:, j]] for j in range(self.ids.shape[1])), len(self.texts))

    def ratio(self, key: str) -> np.ndarray:
        total = self.size + len(key)
        return np.where(total == 0, 100.0, share(self.common(key), np.maximum(total, 1)))

    def partial(self, key: str, rows: np.ndarray) -> np.ndarray:
        """Best ratio of the shorter string with any window of the longer one."""
        out = np.zeros(len(self.texts))
        for r in rows[(self.size[rows] > _WORD) | (len(key) > _WORD)]:
            out[r] = _slow_partial(key, self.texts[r])
        quick = rows[(self.size[rows] <= _WORD) & (len(key) <= _WORD)]
        wide = quick[self.size[quick] >= len(key)]
        if len(wide) and key:
            owner, start, stop = _windows(self.size[wide], np.full(len(wide), len(key)))
            masks = self.key_masks(key)
            texts = wide[owner]
            steps = (masks[_char_at(self.ids, texts, start, stop, j)] for j in range(len(key)))
            self._keep_best(out, texts, _advance(steps, len(texts)), len(key), stop - start)
        narrow = quick[(self.size[quick] <= len(key)) & (self.size[quick] > 0)]
        if len(narrow):
            owner, start, stop = _windows(np.full(len(narrow), len(key)), self.size[narrow])
            texts = narrow[owner]
            ids = np.array([[self.letter.get(ch, 0) for ch in key]], dtype=np.int32)
            zero = np.zeros(len(texts), dtype=np.int64)
            steps = (self.masks[texts, _char_at(ids, zero, start, stop, j)] for j in range(int(self.size[narrow].max())))
            self._keep_best(out, texts, _advance(steps, len(texts)), self.size[texts], stop - start)
        return out

    @staticmethod
    def _keep_best(out, texts, common, short, window):
        np.maximum.at(out, texts, share(common, short + window))


def _advance(steps, n: int) -> np.ndarray:
    """Run the bit-parallel recurrence over the given character masks."""
    state = np.full(n, _ALL)
    for mask in steps:
        hit = state & mask
        state = (state + hit) | (state - hit)
    return np.bitwise_count(~state).astype(np.int64)


def _windows(long: np.ndarray, short: np.ndarray):
    """All windows of each long text that can match a short one best: every full-size
    window and the shorter ones at both ends."""
    owner, start, stop = [], [], []
    for i, (n, m) in enumerate(zip(long.tolist(), short.tolist())):
        lo = np.arange(-(m - 1), n)
        owner.append(np.full(len(lo), i))
        start.append(np.maximum(lo, 0))
        stop.append(np.minimum(lo + m, n))
    return np.concatenate(owner), np.concatenate(start), np.concatenate(stop)


def _char_at(ids, rows, start, stop, j):
    at = start + j
    return np.where(at < stop, ids[rows, np.minimum(at, ids.shape[1] - 1)], 0)


def _slow_partial(a: str, b: str) -> float:
    best = 0.0
    for short, long in ((a, b), (b, a)):
        if not short or len(short) > len(long):
            continue
        for lo in range(-(len(short) - 1), len(long)):
            best = max(best, pair_ratio(short, long[max(lo, 0) : lo + len(short)]))
    return best


class Items:
    """One column of a contract block with the word forms the scorers need."""

    def __init__(self, texts: list[str]):
        words = [t.split() for t in texts]
        self.sets = [set(w) for w in words]
        self.repeats = np.array([len(w) != len(s) for w, s in zip(words, self.sets)], dtype=bool)
        self.plain = Block(texts)
        self.sorted = Block([" ".join(sorted(w)) for w in words])
        self.unique = Block([" ".join(sorted(s)) for s in self.sets])

    def score(self, key: str, scorer: str) -> np.ndarray:
        if scorer == "ratio":
            return self.plain.ratio(key)
        words = key.split()
        if scorer == "WRatio":
            return self._weighted(key, words)
        if scorer == "token_set_ratio":
            return self._token_set(set(words))
        return self.sorted.ratio(" ".join(sorted(words)))

    def _token_set(self, words: set[str]) -> np.ndarray:
        """Best of: the rests of both sides, and each side against the shared words."""
        if not words:
            return np.zeros(len(self.sets))
        scores = self.unique.ratio(" ".join(sorted(words)))
        for r, other in enumerate(self.sets):
            shared = words & other
            if not other:
                scores[r] = 0.0
            elif shared:
                mine, theirs = sorted(words - other), sorted(other - words)
                if not mine or not theirs:
                    scores[r] = 100.0
                    continue
                a, b, base = " ".join(mine), " ".join(theirs), len(" ".join(shared))
                common = lcs_length(a, b)
                left, right = base + 1 + len(a), base + 1 + len(b)
                scores[r] = max(
                    100.0 - 100.0 * (len(a) + len(b) - 2 * common) / (left + right),
                    100.0 - 100.0 * (1 + len(a)) / (base + left),
                    100.0 - 100.0 * (1 + len(b)) / (base + right),
                )
        return scores

    def _partial_token(self, words: list[str], rows: np.ndarray) -> np.ndarray:
        """A shared word is a full partial match; else the best window of sorted words."""
        unique = set(words)
        out = np.zeros(len(self.sets))
        meets = np.array([not unique.isdisjoint(self.sets[r]) for r in rows], dtype=bool)
        out[rows[meets]] = 100.0
        apart = rows[~meets]
        out[apart] = self.sorted.partial(" ".join(sorted(words)), apart)[apart]
        again = apart[self.repeats[apart] | (len(unique) != len(words))]
        out[again] = np.maximum(out[again], self.unique.partial(" ".join(sorted(unique)), again)[again])
        return out

    def _weighted(self, key: str, words: list[str]) -> np.ndarray:
        size = self.plain.size
        out = np.zeros(len(size))
        if not key:
            return out
        filled = size > 0
        longer, shorter = np.maximum(size, len(key)), np.minimum(size, len(key))
        spread = longer / np.maximum(shorter, 1)
        out = self.plain.ratio(key)
        token = np.maximum(self.sorted.ratio(" ".join(sorted(words))), self._token_set(set(words)))
        near = spread < PARTIAL_FROM
        out = np.where(near, np.maximum(out, TOKEN_WEIGHT * token), out)
        far = np.flatnonzero(filled & ~near)
        if len(far):
            scale = np.where(spread[far] > LONG_FROM, LONG_PARTIAL_WEIGHT, PARTIAL_WEIGHT)
            window = self.plain.partial(key, far)[far] * scale
            worded = self._partial_token(words, far)[far] * TOKEN_WEIGHT * scale
            out[far] = np.maximum(out[far], np.maximum(window, worded))
        return np.where(filled, out, 0.0)


def best_in_block(keys: list[str], codes: list[str], descriptions: list[str], scorer: str, keep: int):
    """Per key the best items of the block: (position, score, scored on code?) in rank
    order, the earlier item first among equals."""
    scorer = scorer if scorer in SCORERS else "token_sort_ratio"
    by_code, by_desc = Items(codes), Items(descriptions)
    for key in keys:
        on_code, on_desc = by_code.score(key, scorer), by_desc.score(key, scorer)
        code_wins = on_code >= on_desc
        score = np.where(code_wins, on_code, on_desc)
        top = np.argsort(-score, kind="stable")[:keep]
        yield [(int(i), float(score[i]), bool(code_wins[i])) for i in top]
