"""Benchmark decontamination by shared word pairs and local alignment.

The Smith-Waterman score in parts of the item's own decides. A score that is enough bounds the
words that differ, are missing or added, so it bounds from below how many of the item's n-grams
the place keeps, and how long it is. Places with that many are aligned, all others can't reach
the score: nothing is ranked, sampled or left to chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.aligning import Vocabulary, grams, local, spans_of

#: Bytes of items that are sent to all tasks at once; more items go in rounds of so many.
ROUND_BYTES = 8 << 20
_HITS = "array<struct<item_id:long,score:double,matched_words:int,item_words:int,start:int,end:int>>"


def _least_score(words: int, least: float) -> int:
    """The smallest whole score that is `least` of the item's own."""
    score = max(1, math.ceil(2 * words * least) - 1)
    while score / (2 * words) < least:
        score += 1
    return score


def _gram(words: int, score: int, n: int) -> tuple[int, int]:
    """The longest gram, up to n, of which a place with the score has some of the item's; how many at least.

    With m matched words the others number e <= 2 m - score; they part the matches in at most
    e + 1 runs, and a run of r words has r - size + 1 grams. Single words: m >= score / 2.
    """
    for size in range(min(n, words), 1, -1):
        kept = (size - 1) * (score - 1) - (2 * size - 3) * words
        if kept > 0:
            return size, kept
    return 1, -(-score // 2)


class Items:
    """The items of a round as numbers, with their n-grams; items without a word are left out."""

    def __init__(self, items: list[tuple[int, str]], n: int, least: float):
        self.vocabulary = Vocabulary()
        words = [(i, self.vocabulary.learn(t)) for i, t in items]
        self.items = [(i, w) for i, w in words if len(w)]
        self.base = len(self.vocabulary.number) + 1
        if self.base**n >= 2**64:
            raise ValueError("too many words in a round for n-grams as 64-bit numbers")
        self.score = [_least_score(len(w), least) for _, w in self.items]
        self.reach = np.array([3 * len(w) - s for (_, w), s in zip(self.items, self.score)], np.int64)  # words of a place at most
        kinds = [_gram(len(w), s, n) for (_, w), s in zip(self.items, self.score)]
        self.kept = np.array([kept for _, kept in kinds], np.int64)
        seeds: dict[int, dict[int, set[int]]] = {}
        for k, (_, w) in enumerate(self.items):
            if self.score[k] <= 2 * len(w):
                for gram in grams(w, kinds[k][0], self.base)[1].tolist():
                    seeds.setdefault(kinds[k][0], {}).setdefault(gram, set()).add(k)
        #: By size: the grams in order, where the items of each begin, the items.
        self.seeds = {}
        for size, of_gram in seeds.items():
            order = sorted(of_gram)
            begins = np.cumsum([0, *(len(of_gram[g]) for g in order)])
            self.seeds[size] = np.array(order, np.uint64), begins, np.array([k for g in order for k in sorted(of_gram[g])], np.int64)

    def places(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of all stretches of a document that keep enough grams of an item; those of an item are apart, in order."""
        for size, (wanted, begins, owners) in self.seeds.items():
            at, gram = grams(words, size, self.base)
            if not len(at):
                continue
            g = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
            some = np.flatnonzero(wanted[g] == gram)
            at, first, many = at[some], begins[g[some]], begins[g[some] + 1] - begins[g[some]]
            k = owners[np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)]
            order = np.argsort(k, kind="stable")
            k, at = k[order], np.repeat(at, many)[order]
            last = np.arange(len(k)) + self.kept[k] - 1
            begin = np.flatnonzero(last < len(k))
            last = last[begin]
            enough = (k[last] == k[begin]) & (at[last] - at[begin] <= self.reach[k[begin]] - size)
            now = None
            for i, a, b in zip(*(x[enough].tolist() for x in (k[begin], at[last] + size - self.reach[k[begin]], at[begin] + self.reach[k[begin]]))):
                if now and now[0] == i and a <= now[2]:
                    now = i, now[1], b
                    continue
                if now:
                    yield now
                now = i, max(0, a), b
            if now:
                yield now

    def hits(self, text: str, least: float) -> list[dict]:
        """For each item that a document holds, the best place: spans are characters of the text."""
        words = self.vocabulary.read(text)
        found: dict[int, tuple[int, int, int, int]] = {}
        for k, start, end in self.places(words):
            item, reach = self.items[k][1], int(self.reach[k])
            end = min(end, len(words))
            for a in range(start, max(start + 1, end - reach), 3 * reach):  # parts overlap by the longest place
                part = words[a : min(end, a + 4 * reach)]
                if 2 * np.isin(item, part).sum() < self.score[k]:
                    continue
                score, _, _, x, y, same = local(item, part)
                if score >= self.score[k] and (k not in found or score > found[k][0]):
                    found[k] = score, a + x, a + y, same
        if not found:
            return []
        spans = spans_of(text)
        out = [
            {"item_id": self.items[k][0], "score": score / (2 * len(self.items[k][1])), "matched_words": same, "item_words": len(self.items[k][1]), "start": spans[a][0], "end": spans[b - 1][1]}
            for k, (score, a, b, same) in found.items()
        ]
        return sorted(out, key=lambda h: h["item_id"])


def _rounds(benchmark: DataFrame, item_id: str, text: str) -> list[list[tuple[int, str]]]:
    """The stated query set in parts of a bounded size."""
    out, size = [[]], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct().toLocalIterator():
        size += len(r["t"])
        if size > ROUND_BYTES:
            out.append([])
            size = len(r["t"])
        out[-1].append((r["i"], r["t"]))
    return [sorted(part) for part in out if part]


def hits_column(docs: DataFrame, items: list[tuple[int, str]], text: str, n: int, least: float):
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Items(items, n, least))

    @F.arrow_udf(_HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([shared.value.hits(t.as_py(), least) for t in pc.fill_null(texts, "")], kind)

    return hits(F.col(text))


def with_hits(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", hits: str = "hits", n: int = 3, least: float = 0.6) -> DataFrame:
    """Adds the items that a document holds, each once at its best place, in order of item_id.

    least: the alignment score in parts of the item's score with itself; words that differ, are
    missing or added lower it. Documents or items that are null or without words hold nothing;
    n is the longest gram by which places are looked for and changes no result. Items that come twice under one id are taken
    once if their texts are equal. Without items or documents nothing is held. Other columns
    are kept; one named as `hits` is replaced.
    """
    parts = _rounds(benchmark, item_id, item_text)
    if not parts:
        return df.withColumn(hits, F.array().cast(_HITS))
    return df.withColumn(hits, F.sort_array(F.concat(*(hits_column(df, part, text, n, least) for part in parts))))


def contamination(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, score, matched and item words, character span."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_hits(narrow, benchmark, "text", hits="hits", **more).select(F.col("doc_id").alias(doc_id), F.explode("hits").alias("hit")).select(doc_id, "hit.*")


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The documents that hold no item, with df's columns, whatever these are called."""
    packed = df.select(F.col(text).alias("text"), F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"))
    return with_hits(packed, benchmark, "text", hits="hits", **more).where(F.size("hits") == 0).select("row.*")
