"""The pieces that byte-level tokenizers merge within, as their libraries split them."""

from __future__ import annotations

import functools
import unicodedata

import regex


@functools.lru_cache(1)
def _odd() -> dict[int, str]:
    """Characters that the regex module knows from a newer Unicode version than the tokenizers library, mapped to a sign.

    Only code points on which Python's own tables and the regex module differ are asked of the library.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    level, word = ByteLevel(add_prefix_space=False), regex.compile(r"[\p{L}\p{N}]")
    doubtful = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c))[0] in "LN") != bool(word.match(chr(c)))]
    apart = [c for c in doubtful if len(level.pre_tokenize_str("a" + chr(c))) > 1 and len(level.pre_tokenize_str("1" + chr(c))) > 1]
    return dict.fromkeys(apart, "§")


class Splitter:
    """Splits a text into the matches of a pattern; joined again they are the text."""

    def __init__(self, pattern: str):
        self.pattern, self.odd = pattern, _odd()
        self._all = regex.compile(pattern)

    def __reduce__(self):
        return _restored, (self.pattern, self.odd)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.keys().isdisjoint(map(ord, set(text))):
            return self._all.findall(text)
        return [text[m.start() : m.end()] for m in self._all.finditer(text.translate(self.odd))]

    def spans(self, text: str, start: int = 0):
        """(start, end) of the pieces from a piece boundary on, one at a time."""
        shadow = text if text.isascii() else text.translate(self.odd)
        for m in self._all.finditer(shadow, start):
            yield m.span()


def _restored(pattern: str, odd: dict[int, str]) -> Splitter:
    out = Splitter.__new__(Splitter)
    out.pattern, out.odd, out._all = pattern, odd, regex.compile(pattern)
    return out


class Bounded(dict):
    """Remembers results of a function: the last `limit` new ones and those asked for again since; results never depend on it."""

    def __init__(self, function, limit: int = 200_000):
        super().__init__()
        self.function, self.limit, self.older = function, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.function(key)
        self[key] = out
        return out
