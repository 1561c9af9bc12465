"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of all ways to end a prefix of a piece, exactly one token is the last of that prefix's
encoding. It is the one token t whose start has a last token that stays beside t when the
two are encoded together. The table of these last tokens is the encoding (read backwards), can
be appended to exactly, and after an edit only has to be filled anew until it agrees again for
as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.merges import merged
from tallyline.llm.pretokens import Bounded, Splitter


#: Lengths of prefixes whose last tokens are remembered, longest first, and how many prefixes and pairs of tokens are.
HEADS, REMEMBERED = (12, 8, 4), 100_000
#: Two tokens side by side are one number: the left one shifted by so many bits.
_PAIR = 20
#: Pieces of which a worker remembers the ids, and the last ones before: some 230 bytes each.
PIECES = 140_000
#: Ids whose bytes are gathered at a time.
_GATHERED = 1 << 18


class RankTable:
    """Tokens by rank, those that merging reaches, and which two stay beside each other."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = Splitter(pattern)
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.reached = {t: i for t, i in self.rank.items() if self.by_merges(t) == [i]}
        self.longest = max(map(len, self.reached))
        self.halves = {i: self._halves(t) for t, i in self.reached.items() if len(t) > 1}
        self.size = {i: len(t) for t, i in self.reached.items()}
        self._wake()

    def _wake(self) -> None:
        self._beside: dict[int, bool] = {}
        self._last: dict[bytes, tuple[int, ...]] = {}
        # finds all tokens that end at a byte, longest first; bytes are its characters
        self._ending = ahocorasick.Automaton()
        for t, i in self.reached.items():
            self._ending.add_word(t.decode("latin-1"), (len(t), i))
        self._ending.make_automaton()
        self._packed = Bounded(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes(), PIECES)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_beside", "_last", "_ending", "_packed")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._wake()

    def by_merges(self, data: bytes) -> list[int]:
        """The plain definition: neighbours of lowest joint rank merge first."""
        return [self.rank[t] for t in merged([data[i : i + 1] for i in range(len(data))], self.rank.get)]

    def _halves(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        apart = merged([token[i : i + 1] for i in range(len(token))], lambda t, never: never if t == token else self.rank.get(t, never))
        return tuple(self.rank[t] for t in apart)

    def stays(self, x: int, y: int) -> bool:
        """Whether two tokens beside each other are what their joint bytes encode to.

        Merges run in order of rank, so the symbols on both sides of the border are met again,
        latest first, by taking the younger of the two apart. A merge across the border would
        have come first if its rank is under that of the merge that took the left symbol, and
        not over that of the merge that took the right one.
        """
        rank, data, halves = self.rank.get, self.bytes_of, self.halves
        of_x = of_y = 1 << 62
        while True:
            across = rank(data[x] + data[y])
            if across is not None and across < of_x and across <= of_y:
                return False
            if x in halves and (y not in halves or x > y):
                of_x, x = x, halves[x][1]
            elif y in halves:
                of_y, y = y, halves[y][0]
            else:
                return True

    def _stay(self, pair: int) -> bool:
        if len(self._beside) >= REMEMBERED:
            self._beside.clear()
        stays = self._beside[pair] = self.stays(pair >> _PAIR, pair & (1 << _PAIR) - 1)
        return stays

    def fill(self, data: bytes, last: list[int]) -> None:
        """Adds the last tokens of the prefixes of data that have none yet (last[i] belongs to data[:i + 1]).

        A prefix has the same last tokens in whatever it begins, so those of some lengths are remembered.
        """
        known = self._last
        if not last:
            for n in HEADS:
                if len(data) >= n and (head := known.get(data[:n])):
                    last += head
                    break
        begun = len(last)
        # of the tokens that end behind the last byte filled, none is longer than this
        offset = max(0, begun - self.longest)
        self.fill_on(data[offset:], last, offset)
        if len(last) != len(data):
            raise ValueError("the ranks hold no token for a byte")
        if len(known) >= REMEMBERED:
            known.clear()
        for n in HEADS:
            if begun < n <= len(data):
                known[data[:n]] = tuple(last[:n])

    def fill_on(self, tail: bytes, last: list[int], offset: int) -> None:
        """Walks the tokens that end at each byte, longest first; tail begins at offset of the piece."""
        beside, stay = self._beside.get, self._stay
        done = len(last)
        for end, (n, token) in self._ending.iter(tail.decode("latin-1")):
            end += offset + 1
            if end <= done:
                continue  # filled, by a longer token or before
            start = end - n
            if start:
                if start < offset:
                    continue
                pair = last[start - 1] << _PAIR | token
                stays = beside(pair)
                if not (stay(pair) if stays is None else stays):
                    continue
            last.append(token)
            done = end

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)  # a piece that is a token is that token, whether merging reaches it or not
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.fill(data, last)
        return self.read_back(last)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as packed 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        """The bytes of ids; an unknown id is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pool(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens by id, and where each id's begin; ids without token have none."""
        sizes = np.zeros(max(self.bytes_of, default=-1) + 2, np.int64)
        for i, t in self.bytes_of.items():
            sizes[i + 1] = len(t)
        return np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8), np.cumsum(sizes)


class PrefixTable:
    """The last tokens of all prefixes of one piece."""

    def __init__(self, ranks: RankTable, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Longer by some bytes; no earlier entry changes."""
        self.data += data
        self.ranks.fill(self.data, self.last)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replaces data[start:stop]; returns how many entries had to be found anew."""
        old, self.data = self.last, self.data[:start] + data + self.data[stop:]
        shift, self.last = len(data) - (stop - start), old[:start]
        agreed, step = 0, self.ranks.longest
        for begin in range(start, len(self.data), step):  # so many at a time, seen from as far before
            end = min(begin + step, len(self.data))
            offset = max(0, begin - step)
            self.ranks.fill_on(self.data[offset:end], self.last, offset)
            for at in range(begin + 1, end + 1):
                before = at - shift
                agreed = agreed + 1 if before > stop and old[before - 1] == self.last[at - 1] else 0
                if agreed >= step:  # entries further on depend on these alone
                    self.last[at:] = old[before:]
                    return at - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        return self.ranks.read_back(self.last)


class EncodedText:
    """A text with its pieces' ids, to be appended to and edited without encoding all of it again."""

    def __init__(self, ranks: RankTable, text: str = ""):
        self.ranks, self.text = ranks, text
        self.pieces = [(a, b, ranks.encode_piece(text[a:b].encode())) for a, b in ranks.split.spans(text)]

    def edit(self, start: int, stop: int, put: str) -> int:
        """Replaces text[start:stop]; returns how many pieces were encoded."""
        shift = len(put) - (stop - start)
        kept = [p for p in self.pieces if p[1] < start]  # a match looks one character beyond its end
        self.text = self.text[:start] + put + self.text[stop:]
        later = {p[0] + shift: i for i, p in enumerate(self.pieces) if p[0] >= stop}
        done, at = 0, kept[-1][1] if kept else 0
        for a, b in self.ranks.split.spans(self.text, at):
            if a >= start + len(put) and a in later:
                kept += [(x + shift, y + shift, ids) for x, y, ids in self.pieces[later[a] :]]
                break
            kept.append((a, b, self.ranks.encode_piece(self.text[a:b].encode())))
            done += 1
        self.pieces = kept
        return done

    def append(self, put: str) -> int:
        return self.edit(len(self.text), len(self.text), put)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p[2]]


def encoder(spark: SparkSession, ranks: RankTable):
    """A function of a text column giving its ids. What is broadcast has the size of the rank file."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = shared.value.encode
        for texts in batches:
            packed = [encode(t.as_py()) for t in pc.fill_null(texts, "")]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return encoded


def decoder(spark: SparkSession, ranks: RankTable):
    """A function of an ids column giving the bytes."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        data, begin = shared.value.pool()
        for lists in batches:
            held, counts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            if len(held) and (held.min() < 0 or held.max() >= len(begin) - 1):
                raise ValueError("an id that the ranks do not have")
            sizes = begin[held + 1] - begin[held]
            if not sizes.all():
                raise ValueError("an id that the ranks do not have")
            out = [_gathered(data, begin[held[at : at + _GATHERED]], sizes[at : at + _GATHERED]) for at in range(0, len(held), _GATHERED)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            if ends[-1] >= 2**31:
                raise ValueError("more than 2 GiB of text in one batch")
            flat = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(out) if out else b"")])
            yield pc.if_else(lists.is_valid(), flat, pa.scalar(None, pa.binary())) if lists.null_count else flat

    return decoded


def _gathered(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of tokens one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])]


def encode(df: DataFrame, ranks: RankTable, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of the whole text (null text: no ids). A column of that name is replaced, others are kept."""
    return df.withColumn(ids, encoder(df.sparkSession, ranks)(F.col(text)))


def decode(df: DataFrame, ranks: RankTable, ids: str = "ids", data: str = "data") -> DataFrame:
    """Adds the bytes that the ids stand for (null ids: null; no ids: no bytes)."""
    return df.withColumn(data, decoder(df.sparkSession, ranks)(F.col(ids)))
