"""Document fingerprints by content-defined chunks.

A rolling gear hash over the bytes marks cuts: a strict mask before the usual length, a loose
one after it, so that lengths gather round it. A cut depends on the bytes before it alone, so
an edit changes the chunks around it and leaves the others. A fingerprint is the set of chunk
digests with their lengths; likeness is the share of a text's chunk bytes found in the other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import shuffle_partitions

LEAST, USUAL, MOST = 8, 32, 128
_STRICT, _LOOSE = np.uint32(0b11_111 << 27), np.uint32(0b111 << 29)
#: A random number for each byte, from a rule.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)
_WINDOW = 32


def gear(data: bytes) -> np.ndarray:
    """The hash at each byte: the numbers of it and of the 31 before, each older one shifted one further."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    n = 1
    while n < _WINDOW:  # sums over twice as many bytes each time
        h[n:] += h[:-n] << np.uint32(n)
        n *= 2
    return h


def cuts(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks from `start`, itself the end of a chunk, on."""
    at = max(0, start - _WINDOW)
    h = gear(data[at:])
    strict, loose = ((np.flatnonzero((h & m) == 0) + at + 1).tolist() for m in (_STRICT, _LOOSE))
    out, i, end = [], start, len(data)
    while i < end:
        k = bisect_left(strict, i + LEAST)
        cut = strict[k] if k < len(strict) and strict[k] < i + USUAL else 0
        if not cut:
            k = bisect_left(loose, i + USUAL)
            cut = min(loose[k] if k < len(loose) else end, i + MOST, end)
        i = min(cut, end)
        out.append(i)
    return out


def digests(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    """For each chunk 56 bits of digest and, in the last byte, its length."""
    out, hashed = [], xxhash.xxh3_64_intdigest
    for end in ends:
        out.append(hashed(data[start:end]) & ~0xFF | end - start)
        start = end
    return out


def as_set(found: list[int]) -> np.ndarray:
    return np.unique(np.array(found, np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's chunk bytes that are chunks of b too; two empty sets are alike."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    low = np.uint64(0xFF)
    return float((np.intersect1d(a, b, assume_unique=True) & low).sum() / (a & low).sum())


def written(chunks: np.ndarray) -> str:
    """A fingerprint as text: 16 hexadecimal digits for each chunk, in order of digest."""
    return chunks.astype(">u8").tobytes().hex()


class Chunked:
    """A text with its chunks, and those of its edited form."""

    __slots__ = ("text", "data", "ends", "found", "chunks")

    def __init__(self, text: str):
        self.text, self.data = text, text.encode()
        self.ends = cuts(self.data)
        self.found = digests(self.data, self.ends)
        self.chunks = as_set(self.found)

    def edited(self, following: str) -> tuple[bytes, np.ndarray]:
        """With the last quarter of its characters replaced by the first as many of the following text."""
        k = len(self.text) // 4
        kept = self.text[: len(self.text) - k].encode()
        data = kept + following[:k].encode()
        # cuts up to the edit stay, except one that only the end of the text made
        whole = bisect_left(self.ends, len(kept)) if k else len(self.ends)
        start = self.ends[whole - 1] if whole else 0
        return data, as_set(self.found[:whole] + digests(data, cuts(data, start), start))


_RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(at: int | None, doc: Chunked, following: Chunked) -> tuple:
    data, chunks = doc.edited(following.text)
    return (at, len(doc.text), hashlib.sha256(data).hexdigest(), written(doc.chunks), written(chunks), likeness(doc.chunks, chunks), likeness(doc.chunks, following.chunks))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of range and id; each is compared with the next of its range. A row that only follows gives no row."""
    waiting = None
    for batch in batches:
        rows = []
        for part, follows, at, text in zip(*(batch.column(c) for c in ("part", "follows", "id", "text"))):
            part, follows, at, doc = part.as_py(), follows.as_py(), at.as_py(), Chunked(text.as_py() or "")
            if at is None:
                rows.append(_row(at, doc, doc))
                continue
            if waiting and waiting[0] == part and not waiting[1]:
                rows.append(_row(waiting[2], waiting[3], doc))
            waiting = (part, follows, at, doc)
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def document_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document with its fingerprint and how like it is to its edited text and to the next document.

    Documents follow each other by their integer doc_id, the first after the last; rows of one
    id follow in order of their text. A row without id has no place in that order and follows
    itself, as does a single document. A null text counts as empty; an empty text has an empty
    fingerprint, alike to another empty one only. Repeated rows come back as often as given, an
    empty table gives an empty result, other columns play no part.

    The texts move once, into ranges of ids within which neighbours meet in a stream. The rows
    of a range's first id are sent to the range before it too.
    """
    spark = df.sparkSession
    parts = parts or 3 * shuffle_partitions(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    about = sorted(set(docs.select("id").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    # the ids that begin a range: at most `parts` numbers
    first = sorted(r["least"] for r in docs.where("id is not null").groupBy(_range(F.col("id"), about, "double").alias("part")).agg(F.min("id").alias("least")).collect())
    part = _range(F.col("id"), first[1:], "long")
    begins = F.array_contains(F.array(*map(F.lit, first)).cast("array<long>"), F.col("id"))
    own = F.struct(part.alias("part"), F.lit(0).alias("follows"))
    before = F.struct(F.when(part == 0, len(first) - 1).otherwise(part - 1).alias("part"), F.when(part == 0, 2).otherwise(1).alias("follows"))
    nowhere = F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int").alias("part"), F.lit(0).alias("follows"))
    sent = docs.withColumn("to", F.explode(F.when(F.col("id").isNull(), F.array(nowhere)).when(begins, F.array(own, before)).otherwise(F.array(own))))
    ordered = sent.select("to.part", "to.follows", "id", "text").repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "follows", "id", "text")
    return ordered.mapInArrow(_compare, _RESULT).withColumnRenamed("id", doc_id)


def _range(value: Column, begins: list, kind: str) -> Column:
    """How many of the sorted numbers are not above the value."""
    bounds = F.array(*map(F.lit, begins)).cast(f"array<{kind}>")
    return F.size(F.filter(bounds, lambda b: b <= value)).cast("int")
