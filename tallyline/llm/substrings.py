"""Substring dedup: words inside repeated 13-word windows go, except from the first document that has them.

A count-min sketch counts all windows: each task fills its own, and the sketches are merged
cell by cell. A cell only has to tell none, one and more, so a sketch is two bit maps. Its
estimates are never too low; windows estimated to occur once are settled, and only the others
are grouped exactly by 96 bits of hash. What is grouped has been combined before it moves: a
task asks about a window for the smallest of its documents only, as its others are certain to
go. A window that a third of all documents share therefore gives one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import shuffle_partitions
from tallyline.llm.pretokens import Bounded

#: Windows that a task holds before it puts them into its sketch, and before it combines what it asks.
_SKETCHED, _HELD = 1 << 17, 1 << 19
_SLICES = 64
_A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_NONE = np.empty(0, np.uint64)


class Windows:
    """96-bit hashes of all windows of a text: 64 bits, and 32 more."""

    def __init__(self, size: int):
        self.size = size
        self.word = Bounded(xxhash.xxh3_128_digest, 50_000)

    def of(self, words: list[bytes], halves: int = 2) -> list[np.ndarray]:
        n = len(words) - self.size + 1
        if n < 1:
            return [_NONE, _NONE.astype(np.uint32)][:halves]
        each = np.frombuffer(b"".join(map(self.word.__getitem__, words)), np.uint64).reshape(-1, 2)
        out = []
        for half, factor in ((each[:, 0], _A), (each[:, 1], _B))[:halves]:
            h = half[:n].copy()
            for i in range(1, self.size):
                h *= factor
                h += half[i : i + n]
            out.append(h ^ (h >> np.uint64(29)))
        return out if halves < 2 else [out[0], (out[1] >> np.uint64(32)).astype(np.uint32)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes: white space is ASCII only


class Sketch:
    """A count-min sketch of `rows` rows that share 2**bits cells, each counting 0, 1 or more."""

    def __init__(self, bits: int, rows: int):
        self.bits, self.rows, self.per_row = bits, rows, (1 << bits) // rows
        self.one = np.zeros(1 << (bits - 3), np.uint8)
        self.more = np.zeros(1 << (bits - 3), np.uint8)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        x = (h ^ np.uint64(row * int(_B) & (2**64 - 1))) * _A
        x ^= x >> np.uint64(32)
        return (x * _B >> np.uint64(32)) * np.uint64(self.per_row) // np.uint64(1 << 32) + np.uint64(row * self.per_row)

    def add(self, h: np.ndarray) -> None:
        for row in range(self.rows):
            c = np.sort(self.cells(h, row))
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            self._set(self.more, np.unique(c[~new]))
            c = c[new]
            at, bit = (c >> np.uint64(3)).astype(np.int64), np.uint8(1) << (c & np.uint64(7)).astype(np.uint8)
            self._set(self.more, c[self.one[at] & bit != 0])
            self._set(self.one, c)

    @staticmethod
    def _set(bitmap: np.ndarray, cells: np.ndarray) -> None:
        """cells: sorted, each once."""
        if len(cells):
            at = (cells >> np.uint64(3)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            bitmap[at[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8), first)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether the estimate of each is over one; true for all that are."""
        out = np.ones(len(h), bool)
        for row in range(self.rows):
            left = np.flatnonzero(out)
            c = self.cells(h[left], row)
            out[left] = self.more[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8) & 1 != 0
        return out


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            yield i.as_py(), t.as_py()


def _sketching(size: int, bits: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, sketch, held, n = Windows(size), None, [], 0
        for _, text in _texts(batches):
            (h,) = windows.of(words_of(text), 1)
            held.append(h)
            n += len(h)
            if n >= _SKETCHED:
                sketch = sketch or Sketch(bits, rows)
                sketch.add(np.concatenate(held))
                held, n = [], 0
        if n:
            sketch = sketch or Sketch(bits, rows)
            sketch.add(np.concatenate(held))
        if sketch:
            for i, (one, more) in enumerate(zip(np.split(sketch.one, _SLICES), np.split(sketch.more, _SLICES))):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "one": [_pack(one)], "more": [_pack(more)]})

    return run


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of a partition, one held at a time as they come in order."""
    now, one, more = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            a, b = _unpack(row["one"]), _unpack(row["more"])
            if row["slice"] != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "more": [_pack(more)]})
                now, one, more = row["slice"], a.copy(), b.copy()
            else:
                more |= b | (one & a)
                one |= a
    if now is not None:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "more": [_pack(more)]})


def window_sketch(docs: DataFrame, size: int, bits: int, rows: int) -> Sketch:
    """The merged sketch of docs (id, text). It has 2**(bits - 3) bytes at any size of input."""
    spark = docs.sparkSession
    parts = docs.mapInArrow(_sketching(size, bits, rows), "slice int, one binary, more binary")
    merged = parts.repartition(min(_SLICES, shuffle_partitions(spark)), "slice").sortWithinPartitions("slice").mapInArrow(_merging, "slice int, more binary")
    out = Sketch(bits, rows)
    step = len(out.more) // _SLICES
    for row in merged.toLocalIterator():
        out.more[row["slice"] * step : (row["slice"] + 1) * step] = _unpack(bytes(row["more"]))
    out.one = out.one[:0]
    return out


def _asking(shared, size: int, buckets: int):
    """Rows (bucket, kind, id, a, b): kind 0 asks for windows a, b whether id has them first; kind 1 says that id loses windows a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, sketch = Windows(size), shared.value
        ids, lows, highs, n = [], [], [], 0
        for i, text in _texts(batches):
            if i is None:
                continue
            low, high = windows.of(words_of(text))
            some = np.flatnonzero(sketch.repeated(low))
            if len(some):
                ids.append(np.full(len(some), i, np.int64))
                lows.append(low[some])
                highs.append(high[some])
                n += len(some)
            if n >= _HELD:
                yield from _combined(np.concatenate(ids), np.concatenate(lows), np.concatenate(highs), buckets)
                ids, lows, highs, n = [], [], [], 0
        if n:
            yield from _combined(np.concatenate(ids), np.concatenate(lows), np.concatenate(highs), buckets)

    return run


_ASKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("id", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _bucket(low: np.ndarray, buckets: int) -> np.ndarray:
    return ((low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _firsts(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each window of a document once, in order of window, and the smallest id of its window."""
    order = np.argsort(low)
    ids, low, high = ids[order], low[order], high[order]
    same = low[1:] == low[:-1]
    several = np.flatnonzero(np.r_[False, same] | np.r_[same, False])  # in order by low; the others are alone
    inner = several[np.lexsort((ids[several], high[several], low[several]))]
    ids[several], high[several] = ids[inner], high[inner]
    new = np.r_[True, ~same | (high[1:] != high[:-1])]
    keep = new | np.r_[True, ids[1:] != ids[:-1]]
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    return ids[keep], low[keep], high[keep], least[keep]


def _losers(ids: np.ndarray, low: np.ndarray, partitions: int) -> Iterator[dict]:
    """Rows of kind 1, one for each document."""
    order = np.argsort(ids, kind="stable")
    ids, low = ids[order], low[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        i = int(ids[a])
        yield {"bucket": xxhash.xxh32_intdigest(i.to_bytes(8, "little", signed=True)) % partitions, "kind": 1, "id": i.to_bytes(8, "little", signed=True), "a": low[a:b].tobytes(), "b": b""}


def _combined(ids: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    ids, low, high, least = _firsts(ids, low, high)
    lost = ids > least
    rows = list(_losers(ids[lost], low[lost], buckets))
    ids, low, high = ids[~lost], low[~lost], high[~lost]
    at = np.searchsorted(_bucket(low, buckets), np.arange(buckets + 1))  # sorted by the high bits of low
    for k in np.flatnonzero(at[1:] > at[:-1]):
        a, b = at[k], at[k + 1]
        rows.append({"bucket": int(k), "kind": 0, "id": _pack(ids[a:b]), "a": low[a:b].tobytes(), "b": high[a:b].tobytes()})
    for i in range(0, len(rows), 4000):
        yield pa.RecordBatch.from_pylist(rows[i : i + 4000], schema=_ASKED)


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lost) for each window that a document loses. One bucket is held at a time: in it each asking document but the first loses."""
    now, held = None, []

    def answers() -> pa.RecordBatch:
        ids = np.concatenate([_unpack(r["id"], np.int64) for r in held])
        low, high = (np.concatenate([np.frombuffer(r[c], kind) for r in held]) for c, kind in (("a", np.uint64), ("b", np.uint32)))
        ids, low, _, least = _firsts(ids, low, high)
        return told(ids[ids > least], low[ids > least])

    def told(ids: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(ids), "lost": pa.array(low.view(np.int64))})

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if held:
                    yield answers()
                now, held = row["bucket"], []
            if row["kind"]:
                low = np.frombuffer(row["a"], np.uint64)
                yield told(np.full(len(low), int.from_bytes(row["id"], "little", signed=True), np.int64), low)
            else:
                held.append(row)
    if held:
        yield answers()


def _kept(size: int):
    """A function of a text and the windows it loses: its words, removed words and kept words."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = Windows(size)
        for texts, losses in batches:
            yield pa.array([one(windows, t.as_py(), x.values.to_numpy().view(np.uint64) if x.is_valid else _NONE) for t, x in zip(texts, losses)], kind)

    def one(windows: Windows, text: str | None, lost: np.ndarray) -> dict:
        words = words_of(text)
        total, n = len(words), 0
        if len(lost) and total >= size:
            (low,) = windows.of(words, 1)
            at = np.flatnonzero(np.isin(low, lost))
            edge = np.zeros(total + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            keep = np.cumsum(edge[:-1]) == 0
            n = total - int(keep.sum())
            words = [w for w, k in zip(words, keep.tolist()) if k]
        return {"n_words": total, "n_removed": n, "kept": b" ".join(words).decode()}

    return cut


def windows_lost(docs: DataFrame, size: int = 13, bits: int = 29, rows: int = 2) -> DataFrame:
    """(id, lost) for docs (id, text): hashes of the windows that start in a document of smaller id, for each that has any."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(window_sketch(docs, size, bits, rows))
    buckets = 8 * shuffle_partitions(spark)
    asked = docs.mapInArrow(_asking(shared, size, buckets), "bucket int, kind int, id binary, a binary, b binary")
    told = asked.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_answering, "id long, lost long")
    return told.groupBy("id").agg(F.collect_list("lost").alias("lost"))


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 13, **sketch) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): words covered by a window that starts in a document of smaller id are removed.

    A null text has no words. A text shorter than the window keeps all. Rows of one id are one
    document to each other: none has a smaller id. A row without id neither loses words nor
    takes any. Repeated rows come back as often as given, an empty table gives an empty result,
    other columns play no part. bits and rows are the sketch's; too small a sketch makes more
    windows go through the exact grouping, up to all, and changes no result.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    joined = docs.join(windows_lost(docs, size, **sketch), "id", "left")
    return joined.select(F.col("id").alias(doc_id), _kept(size)("text", "lost").alias("cut")).select(doc_id, "cut.*")


def cut(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", size: int = 13, **sketch) -> DataFrame:
    """The rows of df with all their columns, repeated passages cut out of the texts.

    A text that loses words becomes its kept words joined by one space, and n_chars, where df
    has it, their length; other texts stay to the character. No row is dropped.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    joined = df.select(F.col(doc_id).cast("long").alias("id"), whole.alias("row")).join(windows_lost(docs, size, **sketch), "id", "left")
    losing = F.when(F.col("lost").isNotNull(), F.col(f"row.`{text}`"))  # only these texts are read again
    done = joined.select("row", _kept(size)(losing, "lost").alias("cut"))
    lost = F.col("cut.n_removed") > 0
    new = {text: F.when(lost, F.col("cut.kept")).otherwise(F.col(f"row.`{text}`"))}
    if n_chars in df.columns:
        new[n_chars] = F.when(lost, F.length("cut.kept").cast(df.schema[n_chars].dataType)).otherwise(F.col(f"row.`{n_chars}`"))
    return done.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
