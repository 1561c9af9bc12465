"""Fill-in-middle by a wavelet matrix over character classes.

A text's UTF-8 bytes have one of five classes: inside a code point, or the start of one that
begins nothing more, a word, a line, or both. A wavelet matrix over the classes of a batch of
texts answers how often a class occurs before a place (rank). Ranks of the classes that begin a
unit add up to a count of unit boundaries, and bisection on that count finds the n-th boundary:
so both cuts of all texts of a batch are found together, without splitting any text into units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes that begin a unit.
UNITS = {"char": (1, 2, 3, 4), "word": (2, 4), "line": (3, 4)}
_LEVELS = 3
MARKS = ("<P>", "<S>", "<M>")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that follow each other; starts: where those that are not empty begin.

    A word begins at a character that is no ASCII white space after one that is, a line after a
    line feed; a text's first character begins both, so that units cover the whole text.
    """
    before = np.empty_like(data)
    before[:1], before[1:] = 10, data[:-1]
    out = (1 + (_WHITE[before] & ~_WHITE[data]) + 2 * (before == 10)).astype(np.uint8)
    out[data & 0xC0 == 0x80] = 0
    out[starts] = 4
    return out


class WaveletMatrix:
    """Ranks over a sequence of small numbers: a bit map for each level, zeros sorted before ones from level to level."""

    def __init__(self, codes: np.ndarray, levels: int = _LEVELS):
        self.size, self.levels = len(codes), []
        for level in reversed(range(levels)):
            bits = codes >> level & 1 == 1
            words = np.zeros(len(codes) // 64 + 1, np.uint64)
            words.view(np.uint8)[: -(-len(codes) // 8)] = np.packbits(bits, bitorder="little")
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.levels.append((words, ones, len(codes) - int(np.count_nonzero(bits))))
            codes = np.concatenate([codes[~bits], codes[bits]])

    def rank(self, code: int, ends: np.ndarray) -> np.ndarray:
        """How often code occurs before each end."""
        low, high = np.zeros_like(ends), ends
        for level, (words, ones, zeros) in enumerate(self.levels):
            low, high = (self._step(words, ones, zeros, code >> (len(self.levels) - 1 - level) & 1, at) for at in (low, high))
        return high - low

    @staticmethod
    def _step(words: np.ndarray, ones: np.ndarray, zeros: int, bit: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        before = ones[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))
        return zeros + before if bit else at - before


class Boundaries:
    """Where the units of texts that follow each other begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.matrix = WaveletMatrix(classes(data, offsets[:-1][offsets[:-1] < offsets[1:]]))
        # fewer ranks: those of the classes that begin no unit, if these are fewer
        self.counted = UNITS[unit]
        self.others = tuple(c for c in range(5) if c not in self.counted)

    def before(self, ends: np.ndarray) -> np.ndarray:
        """Boundaries before each place."""
        ranks = self.matrix.rank
        if len(self.others) < len(self.counted):
            return ends - sum(ranks(c, ends) for c in self.others)
        return sum(ranks(c, ends) for c in self.counted)

    def after_units(self, low: np.ndarray, high: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The place in low..high at which so many units have ended: the boundary after them, or the end."""
        wanted, low, high = self.before(low) + units, low.copy(), high.copy()
        # the first place with more boundaries before it than wanted lies right after the boundary asked for
        while (open_ := low < high).any():
            middle = low + high >> 1
            over = self.before(middle + 1) > wanted
            high = np.where(open_ & over, middle, high)
            low = np.where(open_ & ~over, middle + 1, low)
        return low


def cuts(unit: str):
    """A function of text and two draws: units of the text, bytes before both cuts, units before both cuts."""

    @F.arrow_udf("struct<n:long,first:long,second:long,first_units:long,second_units:long>")
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            data, offsets = flat(texts)
            bounds = Boundaries(data, offsets, unit)
            start, end = offsets[:-1], offsets[1:]
            n = bounds.before(end) - bounds.before(start)
            a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for x in (one, two))
            a, b = np.minimum(a, b), np.maximum(a, b)
            first, second = (bounds.after_units(start, end, x) - start for x in (a, b))
            yield pa.StructArray.from_arrays(list(map(pa.array, (n, first, second, a, b))), ["n", "first", "second", "first_units", "second_units"])

    return found


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts after each other, and where each begins and the last ends. Null is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    joined = pc.fill_null(texts, "").cast(pa.large_binary())
    held = joined.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    first = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset] if len(joined) else 0
    return data[first : first + offsets[-1]], offsets


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers under 2**32 for a key, from the hash of seed and key. A null key is a key like any other."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, share: int = 90, suffix_first: int = 20, put: str = "fim") -> DataFrame:
    """Adds a struct (n, form, prefix_units, middle_units, output): the text cut in three and put in another order.

    Two draws by the key place the cuts after so many of the text's n units (code points, words
    or lines). `share` per cent of the texts are transformed, `suffix_first` per cent of these
    with the suffix first (spm), the others prefix first (psm). A text that is empty or null or
    holds a mark stays as it is (form plain, no cuts). The draws depend on the key alone, so
    repeated rows get equal results and rows without key share theirs. Other columns stay; one
    named as `put` is replaced. An empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    draw = draws(F.col(key), seed)
    data = whole.cast("binary")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | whole.contains(m)
    form = F.when((whole == "") | marked | (draw[2] % 100 >= share), "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")

    def assembled(c: Column) -> Column:
        # the bytes are cut between characters; text is only made of them once all are in place
        prefix, suffix = F.substring(data, F.lit(1), c["first"].cast("int")), F.substring(data, c["second"].cast("int") + 1, F.octet_length(data))
        middle = F.substring(data, c["first"].cast("int") + 1, (c["second"] - c["first"]).cast("int"))
        p, s, m = (F.lit(x).cast("binary") for x in MARKS)
        shown = F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(data)
        cut = form != "plain"
        return F.struct(
            c["n"].alias("n"), form.alias("form"), F.when(cut, c["first_units"]).alias("prefix_units"),
            F.when(cut, c["second_units"] - c["first_units"]).alias("middle_units"), shown.cast("string").alias("output"),
        )

    at = df.withColumn(put, cuts(unit)(whole, draw[0], draw[1]))
    return at.withColumn(put, assembled(F.col(put)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that was cut holds no mark, so each mark is there once."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
