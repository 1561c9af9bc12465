"""Token counts by a whole-token shortcut.

Before any text is read, every vocabulary string is proved or not: it must come out of the
pattern as one piece and merge to one token. Pieces of a text that are proved count one by a
look-up; only the rest is merged, each distinct piece once while the bounded memory holds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.merges import merged
from tallyline.llm.pretokens import Bounded, Splitter

#: The printable stand-ins of bytes in vocabularies of this kind: printable Latin-1 stands for itself, the others follow from 256 on.
_PLAIN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
_STAND_IN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_BYTE = {c: b for b, c in _STAND_IN.items()}


class CountTable:
    """Merges, proved strings and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told.get("pre_tokenizer") or {}
        added = told.get("added_tokens", [])
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or told.get("normalizer") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix space or padded added tokens is counted here")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {a + b: i for i, (a, b) in enumerate(pairs)}
        if len(self.rank) < len(pairs):
            raise ValueError(f"{path}: two merges make the same token, so a rank does not follow from the token alone")
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.split = Splitter(pattern)
        self.whole = frozenset(s for s in map(self._text, model["vocab"]) if s is not None and self._proved(s))
        self._wake()

    def _wake(self) -> None:
        self._rest = Bounded(self.merged_count)
        self._added = re.compile("|".join(map(re.escape, self.added))) if self.added else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rest", "_added")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._wake()

    @staticmethod
    def _text(entry: str) -> str | None:
        try:
            return bytes(_BYTE[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            return None

    def _proved(self, text: str) -> bool:
        return self.split(text) == [text] and self.merged_count(text) == 1

    def merged_count(self, piece: str) -> int:
        return len(merged([_STAND_IN[b] for b in piece.encode()], self.rank.get))

    def count(self, text: str) -> int:
        """Tokens of a whole text; a string of an added token counts as that token, as is the library's default."""
        if self._added and (n := len(self._added.findall(text))):
            return n + sum(self._count(part) for part in self._added.split(text))
        return self._count(text)

    def _count(self, text: str) -> int:
        pieces = self.split(text)
        whole, rest = self.whole, self._rest
        left = [p for p in pieces if p not in whole]
        return len(pieces) - len(left) + sum(map(rest.__getitem__, left))


def count_column(spark: SparkSession, table: CountTable):
    """A function of a text column giving its number of tokens. The table's size is that of the vocabulary file."""
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = shared.value.count
        for texts in batches:
            yield pa.array([count(t.as_py()) for t in pc.fill_null(texts, "")], pa.int64())

    return counted


def token_counts(df: DataFrame, table: CountTable, text: str = "text", limit: int = 512, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over_limit: str = "over_limit") -> DataFrame:
    """Adds bytes, tokens and whether these exceed the limit.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Columns of
    the three names are replaced, all others are kept. An empty table gives an empty table.
    """
    count: Column = count_column(df.sparkSession, table)(F.col(text))
    return (
        df.withColumn(n_bytes, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")) if n_bytes != text else df
    ).withColumn(n_tokens, count).withColumn(over_limit, F.col(n_tokens) > limit)
