"""Token ids in Parquet: list columns, rows in order of their key, files that can be read in part.

A table is ranged by key; each task encodes its range in order and writes it with Spark's
Parquet writer. Ids are dictionary-encoded (a vocabulary's few ten thousand values fit the
dictionary page, so an id takes its index's bits); keys, counts and offsets, which rise or
repeat, are delta-encoded. Row groups and pages are small and all columns have page indexes, so
metadata is read without ids, and a few documents without the rest. How many ids come before a
range is kept in a small table beside the files.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.frames import shuffle_partitions
from tallyline.llm.pretokens import Bounded
from tallyline.llm.tokens import _STAND_IN

#: Bytes of a row group, bytes of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 64 << 10, 512
#: Longer words are encoded each time, so that what is remembered stays small.
_REMEMBERED = 40
#: Words that a worker remembers, and the last ones before: some 200 bytes each.
WORDS = 400_000
_SIGNS = ".,;:!?#$%&*"
_DELTA = ("key", "n_tokens", "offset", "range")


class _Words(Bounded):
    """Remembers words; longer ones are encoded each time."""

    def __missing__(self, word: str) -> bytes:
        if len(word) > _REMEMBERED:
            return self.function(word)
        if (out := self.older.get(word)) is None:
            out = self.function(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


class WordEncoder:
    """Ids of texts by a tokenizers file, as the library gives them.

    Where the file composes and lower-cases text, drops white space and splits letters from
    other signs before its merges (`by_words`), a text's ids are those of its words in turn, and
    a word's are those of its letters and of the signs after them. Each of these is merged by
    the library's model once while a bounded memory holds it, letters under the word that they are; words that are not of this form
    and files that are not go through the library whole. The file's text is kept, so the
    encoder can be sent to tasks.
    """

    def __init__(self, text: str):
        self.json = text
        self._wake()

    def _wake(self) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.json)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_words = self._splits_words()
        self.merge = self.library.model.tokenize
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.signs = "".join(c for c in _SIGNS if not any(c in t for t in added))
        self.ids_of = _Words(self._of_word, WORDS)
        self.ids_of_signs = _Words(self._merged, WORDS // 100)

    def _splits_words(self) -> bool:
        told = json.loads(self.json)
        norm, pre = (told.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
        return (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
            and not any(t.isspace() or " " in t or t[:1].isalpha() for t in (x["content"] for x in told["added_tokens"])) and told.get("post_processor") is None
        )

    def __getstate__(self):
        return self.json

    def __setstate__(self, state):
        self.json = state
        self._wake()

    def _encoded(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(_STAND_IN.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _of_word(self, word: str) -> bytes:
        stem = word.rstrip(self.signs)
        if stem.isalpha() and (low := stem.lower() if stem.isascii() else _lower(stem)):
            if low == word:
                return self._merged(word)
            ids = self.ids_of[low]
            return ids + self.ids_of_signs[word[len(stem) :]] if len(stem) < len(word) else ids
        return self._encoded(word) if word else b""

    def __call__(self, text: str) -> bytes:
        """The ids as packed unsigned 32-bit integers in this machine's order."""
        if not self.by_words:
            return self._encoded(text)
        return b"".join(map(self.ids_of.__getitem__, text.replace("\n", " ").split(" ")))


def _lower(stem: str) -> str:
    """Letters, not all ASCII, as the library lower-cases them; empty where it might not see the same, or turn one into a letter and a mark."""
    low = stem.lower()
    plain = max(stem) < "\u0530" and len(low) == len(stem) and low.isalpha() and "Σ" not in stem and normalize("NFC", stem) == stem
    return low if plain else ""


def _writing(shared: Broadcast, end: int | None) -> Callable:
    closing = b"" if end is None else array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value
        before = 0  # ids of the range so far
        for batch in batches:
            packed = [encode(t.as_py() or "") + closing for t in batch.column("text")]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("range"), batch.column("key"), pa.array(before + offsets[:-1].astype(np.int64)), pa.array(sizes), ids],
                ["range", "key", "offset", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    return run


def write_tokens(df: DataFrame, path: str, encode: Callable[[str], bytes], key: str = "doc_id", text: str = "text", end: int | None = None, ranges: int | None = None) -> None:
    """Writes the ids of all rows below path: `tokens` by range and key, `ranges` with what comes before each.

    encode is broadcast with what it holds, which has the size of a vocabulary. `end` closes each document. A null text is an
    empty one; rows without key come first; rows of equal keys are ordered by their text's hash,
    so a repeated row is written as often as it is there. Other columns are not written. An
    empty table gives files without rows.
    """
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), content.alias("text"), F.xxhash64(content).alias("tie"))
    ranged = rows.repartitionByRange(ranges or shuffle_partitions(spark), F.col("key").asc_nulls_first(), "tie")
    placed = ranged.withColumn("range", F.spark_partition_id()).sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
    kind = df.schema[key].dataType.simpleString()
    written = placed.select("range", "key", "text").mapInArrow(_writing(spark.sparkContext.broadcast(encode), end), f"range int, key {kind}, offset long, n_tokens long, ids array<int>")
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE),
        "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "true", "compression": "zstd",
    } | {f"parquet.enable.dictionary#{c}": "false" for c in _DELTA}
    written.write.options(**options).parquet(f"{path}/tokens")
    sums = spark.read.parquet(f"{path}/tokens").groupBy("range").agg(F.sum("n_tokens").alias("tokens")).orderBy("range").collect()  # a row for each range
    before = np.cumsum([0, *(r.tokens for r in sums)]).tolist()
    table = [(r["range"], at) for r, at in zip(sums, before)]
    spark.createDataFrame(table, "range int, before long").coalesce(1).write.parquet(f"{path}/ranges")


def metadata(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(key, start, n_tokens): start counts the ids of all rows before. Ids are only read if asked for."""
    read = spark.read.parquet(f"{path}/tokens").join(spark.read.parquet(f"{path}/ranges"), "range")
    return read.select("key", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def tokens_of(spark: SparkSession, path: str, keys: Column | None = None) -> DataFrame:
    """As metadata with ids; `keys`, a condition on key, reaches the files, which skip row groups and pages."""
    read = metadata(spark, path, ids=True)
    return read if keys is None else read.where(keys)


def ids_crc32(ids: Column) -> Column:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers; null ids: null."""

    @F.arrow_udf("long")
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_pylist()
            yield pa.array([zlib.crc32(flat[a:b]) if there else None for a, b, there in zip(ends, ends[1:], lists.is_valid().to_pylist())], pa.int64())

    return summed(ids)
