"""A quality classifier: gradient-boosted trees over document statistics.

The trees are grown on histograms of binned statistics and kept as arrays, one row of split
columns, thresholds and leaf values for each full binary tree, so a batch of documents goes
down a level of a tree with two numpy look-ups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import settled

_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASSES[list(_chars)] = _k + 1
_CLASSES[128:] = 10
_CLASS_NAMES = ("control", "lower", "upper", "digit", "space", "line", "stop", "shout", "quote", "sign", "high")

#: What is known of a document; nothing of its label, language, source or id is.
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "commonest_word", "repeated_neighbour", "repeated_pair",
    "upper_words", "title_words", "odd_endings", "bare_signs", "lines", "distinct_lines", "line_length", "shortest_line_share",
    *(f"share_{c}" for c in _CLASS_NAMES),
)
_USUAL_END = frozenset(".,;:!?\"')")


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all zero for an empty one."""
    data = text.encode()
    if not data:
        return [0.0] * len(STATISTICS)
    shares = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=len(_CLASS_NAMES)) / len(data)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counted = Counter(words)
    lengths = list(map(len, words)) or [0]
    ends = Counter(w[-1] for w in words)
    per_line = list(map(len, lines))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / n, float(max(lengths)), len(counted) / n, max(counted.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if len(words) > 1 else 0.0,
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, sum(c for e, c in ends.items() if not e.isalnum() and e not in _USUAL_END) / n,
        sum(c for w, c in counted.items() if not any(map(str.isalnum, w))) / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), sum(per_line) / len(lines), min(per_line) / max(1, max(per_line)), *shares,
    ]


def statistics_of():
    """A function of a text column giving its statistics."""

    @F.arrow_udf("array<double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            flat = np.array([statistics(t.as_py()) for t in pc.fill_null(texts, "")], float).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)), pa.array(flat))

    return found


@dataclass
class Trees:
    """Full binary trees: row t of `column` and `threshold` holds tree t's inner nodes in breadth-first order, of `leaf` its leaves."""

    start: float
    column: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.column.shape[1]
        for column, threshold, leaf in zip(self.column, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, column[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1, from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Trees for labels 0 and 1. Without rows, or with one label only, the score is a constant."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    out = Trees(start, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if len(set(y.tolist())) < 2:
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # c <= e[k] for bin k
    margin = np.full(len(y), start)
    columns = np.arange(x.shape[1])
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = ((node - first)[:, None] * len(columns) + columns) * bins + binned
            g, h = (np.bincount(at.ravel(), np.repeat(v, len(columns)), n * len(columns) * bins).reshape(n, len(columns), bins).cumsum(axis=2) for v in (gradient, weight))
            whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
            gain[(h < least) | (whole_h - h < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in range(n):
                column, cut = divmod(int(best[k]), bins)
                if gain[k, column, cut] > 1e-9 and cut < len(edges[column]):
                    out.column[t, first + k], out.threshold[t, first + k] = column, edges[column][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.column[t, node]] > out.threshold[t, node])
        leaf = node - inner
        g, h = (np.bincount(leaf, v, inner + 1) for v in (gradient, weight))
        out.leaf[t] = -rate * g / (h + ridge)
        margin += out.leaf[t, leaf]
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a row without id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(known: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most: int = 20_000) -> Trees:
    """Trees from rows (doc_id, statistics) and labels.

    At most about `most` labelled rows are learned from, chosen by a hash of their id over the
    whole table; all are where there are fewer. Labels other than 0 and 1, labels of held-out
    rows and rows without id are left out; a row labelled twice counts twice.
    """
    usable = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    total = usable.count()
    within = min(1.0, most / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(within * (1 << 30)))
    rows = known.select(F.col(doc_id).alias("id"), "statistics").join(chosen, "id").select("id", "statistics", "label").toPandas()
    rows = rows.sort_values("id", kind="stable")
    x = np.array(rows["statistics"].tolist(), float).reshape(-1, len(STATISTICS))
    return grow(x, rows["label"].to_numpy(float))


def scored(trees: Trees, spark):
    """A function of a statistics column giving the score."""
    shared = spark.sparkContext.broadcast(trees)  # 80 trees of 15 nodes

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return pa.array(shared.value.score(x) if len(rows) else [], pa.float64())

    return score


def scored_texts(trees: Trees, spark):
    """A function of a text column giving the score at once."""
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([statistics(t.as_py()) for t in pc.fill_null(texts, "")], float).reshape(len(texts), len(STATISTICS))
            yield pa.array(shared.value.score(x) if len(x) else [], pa.float64())

    return score


def with_statistics(df: DataFrame, text: str = "text", statistics: str = "statistics") -> DataFrame:
    return df.withColumn(statistics, statistics_of()(F.col(text)))


def quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, most: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of df.

    A null text counts as empty; empty texts get the score that their all-zero statistics give.
    A row without id is scored and never learned from. Repeated rows come back as often as
    given. Without usable labels all scores are 0.5; an empty table gives an empty result.
    """
    known = settled(with_statistics(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "statistics"))
    trees = learn(known, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")), "doc_id", "label", most)
    score = scored(trees, df.sparkSession)(F.col("statistics"))
    out = known.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.select(F.col("doc_id").alias(doc_id), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, most: int = 20_000) -> DataFrame:
    """The rows of df that score at least the threshold, with df's columns.

    Statistics are taken once more, beside the rows, so that no text has to move.
    """
    known = with_statistics(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "statistics")
    trees = learn(known, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")), "doc_id", "label", most)
    return df.where(scored_texts(trees, df.sparkSession)(F.col(text)) >= threshold)
